"""Sales, customer leaderboard and loyalty on small hand-made tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizpanel.operators.period import Period
from bizpanel.plans import loyalty, sales

AS_OF = dt.date(2000, 6, 15)
Q2 = Period.from_quarters(2000, [2])


def invoice(key, date, amount, person, customer, year=None):
    return {
        "internal_id": key,
        "invoice_year": year or int(date[:4]),
        "invoice_date": date,
        "customer_number": customer,
        "sales_person_number": person,
        "total_taxable_amount": amount,
        "exchange_rate": 1,
        "total_final_amount_base": amount + 1,
    }


def line(key, date, weight, quantity=1, item=1):
    return {
        "int_id": key,
        "item_id": item,
        "invoice_date": date,
        "line_weight": weight,
        "invoiced_quantity": quantity,
    }


@pytest.fixture(scope="module")
def shop(make_tables):
    return make_tables(
        sales_header=[
            invoice(1, "2000-04-10", 100, "1A", "600"),
            invoice(2, "2000-05-10", 50, "2A", "500"),
            invoice(3, "2000-06-20", 30, "9Z", "501"),
            invoice(4, "1999-06-20", 20, None, "601"),
            invoice(5, "1999-04-01", 10, "1A", "502"),
        ],
        sales_line=[
            line(1, "2000-04-10", 5),
            line(2, "2000-05-10", 7, quantity=3),
            line(2, "2000-05-10", None, quantity=2, item=2),
            line(2, "1999-05-10", 2, quantity=4),
            line(3, "2000-06-20", 1),
            line(99, "2000-04-10", 1000),
        ],
        item_master=[{"item_id": 1, "volume": 10}, {"item_id": 2}],
    )


def test_export_overlaps_the_channels(shop, only):
    row = only(sales.sales_period(shop, Q2, AS_OF))
    assert row["total_sales_amount"] == 180
    assert (row["white_sales"], row["color_center_sales"], row["export_sales"]) == (100, 50, 100)
    assert row["project_sales"] is None
    assert row["total_final_amount"] == 183
    assert (row["sales_ytd"], row["sales_ytd_prior"]) == (150, 10)
    assert (row["export_ytd"], row["export_ytd_prior"]) == (100, None)


def test_lines_without_header_count_in_the_total_only(shop, only):
    row = only(sales.sales_period(shop, Q2, AS_OF))
    assert row["total_weight_period"] == 1013
    assert row["white_weight_period"] == 5 and row["export_weight_period"] == 5
    assert row["color_center_weight_period"] == 7 and row["color_center_weight_prior"] == 2
    assert row["total_weight_ytd"] == 1012
    # Items without a volume add nothing.
    assert (row["color_center_volume_period"], row["color_center_volume_prior"]) == (30, 40)
    assert row["project_weight_period"] == 0


def test_month_and_period_agree(shop, only):
    month = only(sales.sales_month(shop, 2000, 5, AS_OF))
    period = only(sales.sales_period(shop, Period.monthly(2000, [5]), AS_OF))
    assert {k: period[k] for k in month} == month


def test_mix_and_weight_rows(shop, only):
    figures = sales.sales_period(shop, Q2, AS_OF)
    mix = only(sales.sales_mix(figures))
    assert (mix["local_sales"], mix["other_sales"]) == (80, 0)
    assert mix["export_pct"] == 55.6
    rows = {r.label: r for r in sales.weight_comparison(figures).collect()}
    assert rows["Other"].current_weight == 1013 - 5 - (5 + 7)
    assert rows["Color Centers"].growth_pct == 250.0
    assert rows["Projects"].growth_pct is None
    assert rows["Total Weight"].position == 6


def test_february_29_in_the_prior_window(make_tables, only):
    tables = make_tables(
        sales_header=[
            invoice(1, "2023-02-28", 1, "1", "5"),
            invoice(2, "2023-03-01", 10, "1", "5"),
            invoice(3, "2024-02-29", 100, "1", "5"),
        ]
    )
    row = only(sales.sales_month(tables, 2024, 2, dt.date(2024, 2, 29)))
    assert (row["sales_ytd"], row["sales_ytd_prior"]) == (100, 1)


def month_row(customer, year, month, amount, name="n"):
    return {
        "customer_no": customer,
        "customer_name": name,
        "summary_year": year,
        "summary_month": month,
        "total_amount": amount,
        "total_weight": amount,
        "total_volume": 1,
    }


def test_leaderboard(make_tables):
    """Ties settle by customer number; customers without a sales person are in no type."""
    tied = [month_row(f"{n:03d}", 2000, 1, 5) for n in range(100, 130)]
    tables = make_tables(
        customer_monthly_summary=[
            *tied,
            month_row("200", 1999, 1, 50, None),
            month_row("100", 2000, 7, 999),
            month_row("300", 2000, 1, 77),
            month_row("400", 2000, 1, 78),
        ],
        customer_master=[
            *[{"customer_no": f"{n:03d}", "customer_sales_person": "1"} for n in range(100, 130)],
            {"customer_no": "200", "customer_sales_person": "1"},
            {"customer_no": "300"},
        ],
    )
    leaders = sales.customer_breakdown(tables, "White Customers", 2000, AS_OF).collect()
    assert [r.customer_number for r in leaders] == [f"{n:03d}" for n in range(100, 125)]
    assert {int(r.amount_ytd) for r in leaders} == {5}
    everyone = sales.customer_breakdown(tables, "White Customers", 2000, AS_OF, k=99).collect()
    prior_only = {r.customer_number: r for r in everyone}["200"]
    assert (prior_only.amount_ytd, prior_only.amount_ytd_prior) == (0, 50)
    assert prior_only.customer_name == "Unknown Customer"
    assert sales.customer_breakdown(tables, None, 2000, AS_OF).count() == 0
    assert sales.max_month(1999, AS_OF) == 12


def test_monthly_summary_is_rebuilt(shop):
    found = {
        (r.customer_no, r.summary_year, r.summary_month): tuple(
            map(float, (r.total_amount, r.total_weight, r.total_volume))
        )
        for r in sales.customer_monthly_summary(shop).collect()
    }
    assert found[("500", 2000, 5)] == (50.0, 7.0, 30.0)
    assert found[("500", 1999, 5)] == (0.0, 2.0, 40.0)
    assert found[("601", 1999, 6)] == (20.0, 0.0, 0.0)


# --- loyalty ---------------------------------------------------------------


def charge(client, month, points=10, year=2000, kind="A"):
    return {
        "client_id": client,
        "charging_year": year,
        "charging_month": month,
        "card_type": kind,
        "total_cards": 1,
        "total_points": points,
    }


def redeem(client, month, points=4, source="NOVA", gift="cup", year=2000):
    return {
        "client_id": client,
        "redemption_year": year,
        "redemption_month": month,
        "gift_name": gift,
        "gift_point": points,
        "offer_value": 1,
        "source": source,
    }


@pytest.fixture(scope="module")
def club(make_tables):
    return make_tables(
        charging=[
            charge(1, 4),
            charge(1, 5),
            charge(2, 5, 30, kind="B"),
            charge(1, 1),
            charge(3, 4, 7, year=1999),
            charge(None, 6, 3),
        ],
        activation=[
            {"activation_year": 2000, "activation_month": 5, "card_type": "C",
             "total_cards": 2, "total_points": 8}
        ],
        redemption=[redeem(1, 4), redeem(9, 6, source="CCALL"), redeem(9, 6, source="SHOP", gift=None)],
        client_master=[
            {"glcid": 1, "name": "One", "created_date": "2000-05-01", "is_painter": 1, "governorate_id": 7},
            {"glcid": 1, "name": "One again", "created_date": "1999-05-01", "is_painter": 1, "governorate_id": 7},
            {"glcid": 2, "created_date": "2000-07-01", "is_painter": 0, "governorate_id": 99},
        ],
        governorate=[{"governorate_id": 7, "name": "North"}],
    )


def test_summary_ignores_months(club, only):
    row = only(loyalty.summary(club, 2000))
    assert (row["cy_charging_cards"], row["py_charging_cards"]) == (5, 1)
    assert row["cy_charging_points"] == 63
    # A NULL client is not counted as a client.
    assert (row["cy_active_clients"], row["py_active_clients"]) == (2, 1)
    assert (row["cy_redeem_requests"], row["cy_active_cards"]) == (3, 2)
    empty = only(loyalty.summary(club, 1980))
    assert set(empty.values()) == {0}


def test_trend_has_every_month_of_the_period(club):
    rows = {r.month: r for r in loyalty.trend(club, Q2).collect()}
    assert list(rows) == [4, 5, 6]
    assert (rows[5].cy_charging_cards, rows[5].cy_active_clients) == (2, 2)
    assert (rows[5].cy_joined_clients, rows[5].py_joined_clients) == (1, 1)
    assert (rows[6].cy_charging_cards, rows[6].cy_active_clients) == (1, 0)
    assert rows[4].py_charging_points == 7


def test_quarters_add_monthly_client_counts(club):
    quarter = {r.quarter: r for r in loyalty.quarterly_trend(loyalty.trend(club, Q2)).collect()}[2]
    assert quarter.cy_active_clients == 3
    exact = {r.quarter: r for r in loyalty.distinct_clients_by_quarter(club, 2000).collect()}
    assert exact[2].cy_active_clients == 2


def test_additive_measures_agree_over_quarters_and_year(club):
    year = Period.yearly(2000)
    monthly = loyalty.trend(club, year)
    quarters = loyalty.quarterly_trend(monthly).agg(F.sum("cy_charging_points")).first()[0]
    assert quarters == loyalty.summary(club, 2000).first().cy_charging_points


def test_card_types_from_either_side(club):
    rows = [
        (r.card_type, r.total_cards_charged, r.total_cards_activated)
        for r in loyalty.card_types(club, Q2).collect()
    ]
    assert rows == [("B", 1, 0), ("A", 3, 0), ("C", 0, 2)]


def test_clients_repeat_with_their_master_rows(club):
    rows = [
        (r.client_id, r.client_name, float(r.total_charged_points), r.total_redeem_requests)
        for r in loyalty.clients(club, Q2).collect()
    ]
    assert rows == [
        (2, "Client #2", 30.0, 0),
        (1, "One", 20.0, 1),
        (1, "One again", 20.0, 1),
        (None, None, 0.0, 0),
        (9, "Client #9", 0.0, 2),
    ]
    assert len(loyalty.clients(club, Q2, k=2).collect()) == 2


def test_governorates_count_clients_once_and_painters_per_row(club):
    rows = {
        r.governorate: (r.total_clients, r.total_painters, r.total_non_painters)
        for r in loyalty.governorates(club, Q2).collect()
    }
    assert rows == {"North": (1, 2, 0), "Other": (2, 0, 1)}


def test_redemptions_by_source(club):
    rows = [(r.month, r.total_requests) for r in loyalty.redemptions(club, Q2, "CCALL").collect()]
    assert rows == [(4, 0), (5, 0), (6, 1)]


def test_empty_month_list_gives_no_rows(club):
    nothing = Period.from_loyalty_request({"Period": "monthly", "Months": "", "Year": 2000}, AS_OF)
    assert loyalty.trend(club, nothing).count() == 0
    assert loyalty.gifts(club, nothing).count() == 0


def test_client_history(club):
    lists = loyalty.client_detail(club, 1)
    assert [r.charging_month for r in lists["charging"].collect()] == [5, 4, 1]
    assert [(r.gift_name, r.total_request) for r in lists["redemption"].collect()] == [("cup", 1)]


def test_ratios(club, only):
    report = loyalty.loyalty_details(club, Q2)
    ratios = loyalty.loyalty_ratios(report)
    assert only(ratios["summary"])["cy_charging_avg"] == 13.0
    assert only(ratios["summary"])["py_activation_pct"] == 0.0
    assert only(ratios["footer"])["cy_charging_cards"] == 4
    assert {r.governorate: r.painter_pct for r in ratios["governorates"].collect()}["North"] == 200.0
