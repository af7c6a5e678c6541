"""Cash, control, expenses and purchasing on small hand-made ledgers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bizpanel.operators.period import Period
from bizpanel.plans import cash, control, expenses, ledger, purchasing
from bizpanel.plans.stock import stock_valuation

APRIL = Period.monthly(2000, [4])


def entry(account, date, debit=0, credit=0, currency="EGP", **more):
    row = {
        "account": account,
        "journal_date": date,
        "debit_book": debit,
        "credit_book": credit,
        "debit_txn": debit * 10,
        "credit_txn": credit * 10,
        "line_currency": currency,
        "journal_no": "JV1",
    }
    return row | more


def rows(df, *columns):
    return [tuple(_plain(r[c]) for c in columns) for r in df.collect()]


def _plain(value):
    return float(value) if value is not None and not isinstance(value, (str, int)) else value


@pytest.fixture(scope="module")
def books(make_tables):
    return make_tables(
        journal_line=[
            entry("1261", "1999-12-31", debit=100),
            entry("1261", "2000-02-10", debit=20),
            entry("1261", "2000-04-30", credit=5),
            entry("1261", "2000-05-01", debit=1000),
            entry("1261", "1999-06-01", debit=7, currency="USD"),
            entry("1261", "2000-04-02", debit=1, currency="USD"),
            entry("1262", "1999-06-01", debit=50),
            entry("1263", "1999-06-01", debit=3, currency=None),
            entry("1263", "2000-04-03", debit=4, currency=None),
            entry("1271", "2000-04-04", debit=8, bank="B1"),
            entry("1278", "2000-04-04", debit=600, bank="B1"),
            entry("1271", "2000-04-04", debit=9, bank=""),
            entry("1271", "2001-01-01", debit=2, bank="B2", currency="EUR"),
            entry("1271", "2000-04-05", debit=6, bank="B3", currency=None),
            entry("5111", "2000-04-05", debit=77),
        ],
        accounts_master=[{"account_number": "1261", "account_description": "Safe"}],
        bank_accounts_master=[{"bank_account_number": "B1", "bank_account_name": "First"}],
    )


def test_summary_opening_and_closing(books):
    base = cash.cash_base(books.journal_line, APRIL)
    found = rows(
        cash.cash_summary(base), "account_group", "line_currency", "balance", "opening_balance"
    )
    assert sorted(found, key=str) == sorted(
        [
            ("126", "EGP", 165.0, 150.0),
            ("126", "USD", 80.0, 70.0),
            # A NULL currency matches nothing: closing and opening are two rows.
            ("126", None, 70.0, 0.0),
            ("126", None, 0.0, 30.0),
            ("127", "EGP", 17.0, 0.0),
            ("127", None, 60.0, 0.0),
        ],
        key=str,
    )


def test_summary_equals_the_full_outer_join(books):
    """The single grouping gives what a full join of closing and opening gives."""
    from bizpanel.operators.joins import full_merge

    base = cash.cash_base(books.journal_line, APRIL)
    group = F.substring("account", 1, 3).alias("account_group")
    cash_rows = base.filter(ledger.is_cash_account())
    keys = [group, "line_currency"]
    closing = cash_rows.filter("window <= 2").groupBy(*keys).agg(F.sum("native").alias("c"))
    opening = cash_rows.filter("window = 0").groupBy(*keys).agg(F.sum("native").alias("o"))
    joined = full_merge(closing, opening, ["account_group", "line_currency"]).select(
        "account_group", "line_currency", F.coalesce("c", F.lit(0)), F.coalesce("o", F.lit(0))
    )
    single = cash.cash_summary(base).select(
        "account_group", "line_currency", "balance", "opening_balance"
    )
    assert sorted(map(str, map(tuple, joined.toDF("a", "b", "c", "d").select(
        "a", "b", F.col("c").cast("double"), F.col("d").cast("double")).collect()))) == sorted(
        map(str, map(tuple, single.toDF("a", "b", "c", "d").select(
            "a", "b", F.col("c").cast("double"), F.col("d").cast("double")).collect()))
    )


def test_accounts_list_only_what_moves(books):
    found = cash.cash_accounts(cash.cash_base(books.journal_line, APRIL), books.accounts_master)
    data = rows(
        found,
        "account",
        "account_description",
        "line_currency",
        "opening_balance",
        "movement",
        "closing_balance",
        "cash_state",
    )
    assert sorted(data, key=str) == sorted(
        [
            ("1261", "Safe", "EGP", 120.0, -5.0, 115.0, "Inflow"),
            ("1261", "Safe", "USD", 70.0, 10.0, 80.0, "Outflow"),
            ("1263", None, None, 0.0, 40.0, 40.0, "Outflow"),
            ("1271", None, "EGP", 0.0, 17.0, 17.0, "Outflow"),
            ("1271", None, None, 0.0, 60.0, 60.0, "Outflow"),
        ],
        key=str,
    )


def test_strict_parity_repeats_a_line_per_opening_currency(books):
    found = cash.cash_accounts(
        cash.cash_base(books.journal_line, APRIL), books.accounts_master, strict_parity=True
    )
    data = rows(found.filter("account = '1261'"), "line_currency", "opening_balance")
    assert sorted(data) == [("EGP", 70.0), ("EGP", 120.0), ("USD", 70.0), ("USD", 120.0)]


def test_banks_cover_all_dates_and_excluded_accounts(books):
    found = cash.bank_balances(
        cash.cash_base(books.journal_line, APRIL), books.bank_accounts_master
    )
    data = rows(found, "bank", "bank_account_name", "line_currency", "total_debit", "closing_balance")
    assert sorted(data, key=str) == sorted(
        [
            ("B1", "First", "EGP", 608.0, 608.0),
            ("B2", None, "EUR", 0.0, 0.0),
            ("B3", None, None, 0.0, 0.0),
        ],
        key=str,
    )


def test_opening_and_movement_add_up(books):
    for name in ("accounts", "banks"):
        report = cash.cash_period(books, Period.monthly(2000, [2, 4]))[name]
        wrong = report.filter("closing_balance <> opening_balance + movement")
        assert wrong.count() == 0


def test_compacted_history_gives_the_same_report(books):
    compacted = ledger.compact_years(books.journal_line)
    short = ledger.with_compacted_years(books.journal_line, compacted, 2000)
    assert short.filter("journal_date < '2000-01-01'").count() < books.journal_line.filter(
        "journal_date < '2000-01-01'"
    ).count() + 1
    for name in cash.LISTS:
        full = cash.cash_period(books, APRIL)[name]
        less = cash.cash_period(books.replace(journal_line=short), APRIL)[name]
        assert sorted(map(str, full.collect())) == sorted(map(str, less.collect()))


def test_cash_cards_and_totals(books):
    report = cash.cash_period(books, APRIL)
    cards = rows(cash.cash_cards(report["summary"], "EGP"), "account_group", "opening", "current", "difference")
    # Base currency and missing currency count; absolute values are added.
    assert cards == [("126", 180.0, 235.0, 55.0), ("127", 0.0, 77.0, 77.0)]
    assert rows(cash.cash_totals(report["summary"]), "total_treasury", "total_bank", "grand_total") == [
        (315.0, 77.0, 392.0)
    ]


def test_bank_totals_need_an_agreeing_currency(make_tables):
    tables = make_tables(
        journal_line=[
            entry("1271", "2000-04-01", debit=5, bank="1EG"),
            entry("1271", "2000-04-01", debit=5, bank="1EG", currency="USD"),
            entry("1271", "2000-04-01", credit=2, bank="2", currency="USD"),
        ]
    )
    totals = cash.bank_totals(cash.cash_period(tables, APRIL)["banks"])
    assert sorted(rows(totals, "currency", "banks", "total")) == [("EGP", 1, 5.0), ("USD", 1, 20.0)]


def test_control_sums_are_null_without_rows(make_tables, only):
    """A sum over no rows stays NULL; only defaulted figures read 0."""
    tables = make_tables()
    kpis = only(control.control_month(tables, 2000, 4))
    assert set(kpis.values()) == {None}
    assert only(expenses.total_sales(tables.sales_header, APRIL))["total_sales_amount"] == 0


def test_control_balances_at_period_end_or_all_time(make_tables, only):
    tables = make_tables(
        journal_line=[
            entry("1241", "2000-04-10", debit=100),
            entry("1241", "2000-04-30", credit=30, journal_no="GR9"),
            entry("1242", "2000-04-30", credit=7, journal_no="ZZ9"),
            entry("1241", "2000-05-01", credit=11, journal_no="BT9"),
            entry("2321", "2000-04-11", debit=40, journal_no="NP1"),
            entry("2322", "2000-06-11", credit=90),
        ]
    )
    month = only(control.control_month(tables, 2000, 4))
    period = only(control.control_period(tables, APRIL)["kpis"])
    assert month["total_collection"] == period["total_collection"] == 30
    assert (month["customer_balance"], period["customer_balance"]) == (52, 63)
    assert month["total_paid"] == period["total_paid"] == 40
    assert (month["vendor_balance"], period["vendor_balance"]) == (-50, 40)


def test_stored_year_against_invoice_date(make_tables, only):
    tables = make_tables(
        sales_header=[
            {"internal_id": 1, "invoice_year": 2000, "invoice_date": "1999-04-30",
             "total_taxable_amount": 10, "exchange_rate": 1},
            {"internal_id": 2, "invoice_year": 1999, "invoice_date": "2000-04-01",
             "total_taxable_amount": 5, "exchange_rate": 2},
        ]
    )
    assert only(control.control_month(tables, 2000, 4))["total_sales_amount"] == 10
    assert only(expenses.total_sales(tables.sales_header, APRIL))["total_sales_amount"] == 10
    may = Period.monthly(2000, [5])
    assert only(control.control_month(tables, 2000, 5))["total_sales_amount"] is None
    assert only(expenses.total_sales(tables.sales_header, may))["total_sales_amount"] == 0


def test_expense_parents_and_missing_dimensions(make_tables):
    tables = make_tables(
        journal_line=[
            entry("4211", "2000-04-01", debit=60, segment9="a"),
            entry("4211", "2000-04-02", debit=40, segment9="zz"),
            entry("4212", "2000-04-02", debit=10, segment9="a"),
            entry("4212", "2000-05-02", debit=999, segment9="a"),
            entry("5111", "2000-04-02", debit=999, segment9="a"),
        ],
        accounts_master=[{"account_number": "4211", "account_description": "Wages"}],
        segments_master=[
            {"segment_id": 9, "segment_value": "a", "value_description": "Site A", "parent_value": "p"},
            {"segment_id": 8, "segment_value": "a", "value_description": "Wrong", "parent_value": "p"},
            {"segment_id": 9, "segment_value": "p", "value_description": "Sites"},
        ],
    )
    report = expenses.expenses_period(tables, APRIL)
    assert rows(report["parents"], "parent_description", "total_amount") == [
        ("Sites", 70.0),
        (None, 40.0),
    ]
    assert sorted(rows(report["accounts"], "account", "account_description", "total_amount")) == [
        ("4211", "Wages", 100.0),
        ("4212", None, 10.0),
    ]
    shares = expenses.expense_share(report)
    assert sorted(rows(shares["parents"], "account", "parent", "share_pct")) == [
        ("4211", "Other", 40.0),
        ("4211", "Sites", 60.0),
        ("4212", "Sites", 100.0),
    ]
    # No sales: the ratio has no value, and the badge neither.
    assert set(rows(shares["accounts"], "expense_sales_pct", "badge")) == {(None, None)}


def purchase(key, amount, vendor="v1", kind="NL", rate=1, date="2000-04-10", year=2000):
    return {
        "internal_id": key,
        "invoice_year": year,
        "invoice_date": date,
        "vendor_number": vendor,
        "vendor_type": kind,
        "total_lines_amount": amount,
        "total_discount": 0,
        "invoice_exchange_rate": rate,
        "invoice_currency": "EGP",
    }


def test_purchasing_differences_stay_null(make_tables, only):
    """Without a local purchase the local sum is NULL, and so is the import difference."""
    tables = make_tables(purchase_header=[purchase(1, 100, kind="IM"), purchase(2, 50, kind=None)])
    kpis = only(purchasing.purchasing_period(tables, APRIL)["kpis"])
    assert kpis["total_purchasing_amount"] == 150
    assert kpis["local_purchasing"] is None and kpis["import_purchasing"] is None
    assert kpis["raw_purchasing"] is None and kpis["other_purchasing"] is None


def test_raw_purchasing_uses_line_year_and_header_month(make_tables, only):
    def line(key, kind, amount, year=2000):
        return {"int_id": key, "inv_year": year, "item_type": kind, "line_amount": amount, "line_discount": 1}

    tables = make_tables(
        purchase_header=[purchase(1, 100, rate=3), purchase(2, 70, date="2000-05-01")],
        purchase_line=[
            line(1, "R", 11),
            line(1, "P", 21),
            line(1, "F", 500),
            line(1, "R", 500, year=1999),
            line(2, "R", 500),
            line(9, "R", 500),
        ],
    )
    kpis = only(purchasing.purchasing_month(tables, 2000, 4)["kpis"])
    assert kpis["raw_purchasing"] == 90
    assert kpis["other_purchasing"] == 210


def test_vendor_lists(make_tables):
    """Purchases group by vendor number, balances by vendor name; NULL is one name."""
    tables = make_tables(
        purchase_header=[purchase(1, 10, "v1"), purchase(2, 10, "v2"), purchase(3, 5, "v3")],
        vendor_master=[
            {"vendor_number": "v1", "vendor_extra_name": "Same"},
            {"vendor_number": "v2", "vendor_extra_name": "Same"},
            {"vendor_number": "v4"},
        ],
        journal_line=[
            entry("2321", "1990-01-01", credit=4, vendor="v1"),
            entry("2322", "2030-01-01", credit=6, vendor="v2"),
            entry("2322", "2000-01-01", debit=1, vendor="v3"),
            entry("2322", "2000-01-01", debit=2, vendor="v4"),
            entry("2322", "2000-01-01", debit=3),
        ],
    )
    report = purchasing.purchasing_period(tables, APRIL)
    assert rows(report["vendors"], "vendor_number", "vendor_name", "total_amount") == [
        ("v1", "Same", 10.0),
        ("v2", "Same", 10.0),
        ("v3", None, 5.0),
    ]
    assert rows(report["balances"], "vendor_name", "vendor_balance") == [("Same", -10.0), (None, 6.0)]
    shares = purchasing.purchasing_mix(report)
    # Bars divide absolute values by the largest signed balance.
    assert sorted(rows(shares["balances"], "bar_pct")) == [(100.0,), (pytest.approx(166.6667, abs=1e-3),)]


def test_stock_valuation(make_tables):
    def line(key, code, price):
        return {"int_id": key, "item_code": code, "price": price}

    tables = make_tables(
        purchase_header=[
            purchase(1, 0, rate=2, date="2000-04-10"),
            purchase(2, 0, rate=3, date="2000-04-10"),
            purchase(3, 0, rate=9, date="2000-04-01"),
        ],
        purchase_line=[
            line(1, "A", 10),
            line(2, "A", 20),
            line(2, "A", 19),
            line(3, "A", 99),
            line(1, "", 5),
            line(1, None, 5),
        ],
        item_balance=[
            {"item_id": 1, "item_code": "A", "item_balance": 4},
            {"item_id": 1, "item_code": "A", "item_balance": -1},
            {"item_id": 2, "item_code": "ZERO", "item_balance": 4},
            {"item_id": 2, "item_code": "ZERO", "item_balance": -4},
            {"item_id": 3, "item_code": "FIN", "item_balance": 4},
            {"item_id": 4, "item_code": "NEW", "item_balance": -2},
        ],
        item_master=[{"item_id": 1, "item_type": "R"}, {"item_id": 3, "item_type": "F"}],
    )
    found = rows(
        stock_valuation(tables),
        "item_code",
        "item_type",
        "item_balance",
        "last_price",
        "last_exchange_rate",
        "item_amount_base",
    )
    assert found == [("A", "R", 3.0, 20.0, 3.0, 180.0), ("NEW", "N/A", -2.0, 0.0, 1.0, 0.0)]
