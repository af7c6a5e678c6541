"""Loyalty cards: key figures, year-on-year summary and trend, leaderboards, clients."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.numbers import (
    average_or,
    count_if,
    or_zero,
    share_pct,
    sum_if,
    sum_where,
    yoy_pct_loyalty,
)
from bizpanel.operators.aggregates import footer_totals, quarterly, top_k
from bizpanel.operators.joins import full_merge, left_dim, months_df, on_month_spine, one_row
from bizpanel.operators.lists import Lists
from bizpanel.operators.period import Period, in_year, in_years
from bizpanel.sources.tables import Tables

TREND_MEASURES = tuple(
    f"{side}_{measure}"
    for measure in (
        "charging_cards",
        "charging_points",
        "active_cards",
        "active_points",
        "active_clients",
        "joined_clients",
    )
    for side in ("cy", "py")
)


def cards() -> Column:
    return F.col("total_cards").cast("bigint")


def points() -> Column:
    return F.col("total_points").cast("decimal(18,2)")


def cy_py(year: Column, chosen: int, measures: dict[str, Column]) -> list[Column]:
    """Each measure summed for the chosen year (``cy_``) and the year before (``py_``)."""
    return [
        or_zero(sum_where(year == y, value)).alias(f"{side}_{name}")
        for name, value in measures.items()
        for side, y in (("cy", chosen), ("py", chosen - 1))
    ]


def two_years(year: Column, chosen: int) -> Column:
    return year.isin(chosen, chosen - 1)


def loyalty_control(tables: Tables, year: int) -> DataFrame:
    """Cards and points charged and activated in a year."""
    def totals(df: DataFrame, year_column: str, kind: str) -> DataFrame:
        return df.filter(F.col(year_column) == year).agg(
            or_zero(F.sum(cards())).alias(f"total_{kind}_cards"),
            or_zero(F.sum(points())).alias(f"total_{kind}_points"),
        )

    return one_row(
        totals(tables.charging, "charging_year", "charging"),
        totals(tables.activation, "activation_year", "active"),
    )


def charging_clients(charging: DataFrame, year: int, *keys: str) -> DataFrame:
    """Charging of two years per client and ``keys``.

    Distinct clients are then counted as groups, which takes one shuffle for both
    years and spreads by client however many rows one month or client holds.
    """
    return (
        charging.filter(two_years(F.col("charging_year"), year))
        .groupBy("charging_year", *keys, "client_id")
        .agg(F.sum(cards()).alias("total_cards"), F.sum(points()).alias("total_points"))
    )


def _distinct_clients(year: int) -> list[Column]:
    return [
        count_if((F.col("charging_year") == y) & F.col("client_id").isNotNull()).alias(
            f"{side}_active_clients"
        )
        for side, y in (("cy", year), ("py", year - 1))
    ]


def summary(tables: Tables, year: int) -> DataFrame:
    """Whole-year figures of the year and the year before; the months play no part."""
    charging = charging_clients(tables.charging, year).agg(
        *cy_py(
            F.col("charging_year"),
            year,
            {"charging_cards": F.col("total_cards"), "charging_points": F.col("total_points")},
        ),
        *_distinct_clients(year),
    )
    activation = tables.activation.filter(two_years(F.col("activation_year"), year)).agg(
        *cy_py(F.col("activation_year"), year, {"active_cards": cards(), "active_points": points()})
    )
    redeemed = F.col("redemption_year")
    redemption = tables.redemption.filter(two_years(redeemed, year)).agg(
        *cy_py(
            redeemed,
            year,
            {
                "redeem_requests": F.lit(1),
                "redeem_points": F.col("gift_point"),
                "redeem_amount": F.col("offer_value"),
            },
        )
    )
    whole_year = {
        f"{side}_year_{kind}_cards": F.col(f"{side}_{kind}_cards")
        for side in ("cy", "py")
        for kind in ("charging", "active")
    }
    return one_row(charging, activation, redemption).withColumns(whole_year)


def trend(tables: Tables, period: Period) -> DataFrame:
    """Monthly comparison with the year before, every month of the period present."""
    year = period.year
    charging = (
        charging_clients(tables.charging, year, "charging_month")
        .groupBy(F.col("charging_month").alias("month"))
        .agg(
            *cy_py(
                F.col("charging_year"),
                year,
                {
                    "charging_cards": F.col("total_cards"),
                    "charging_points": F.col("total_points"),
                },
            ),
            *_distinct_clients(year),
        )
    )
    activation = (
        tables.activation.filter(two_years(F.col("activation_year"), year))
        .groupBy(F.col("activation_month").alias("month"))
        .agg(
            *cy_py(
                F.col("activation_year"), year, {"active_cards": cards(), "active_points": points()}
            )
        )
    )
    created = F.col("created_date")
    joined = (
        tables.client_master.filter(in_years(created, year - 1, year))
        .groupBy(F.month(created).alias("month"))
        .agg(
            count_if(in_year(created, year)).alias("cy_joined_clients"),
            count_if(in_year(created, year - 1)).alias("py_joined_clients"),
        )
    )
    return by_month(tables, period, [charging, activation, joined], TREND_MEASURES)


def by_month(
    tables: Tables, period: Period, parts: list[DataFrame], measures: tuple[str, ...]
) -> DataFrame:
    """Stack monthly aggregates on the month spine and fold them: one small shuffle."""
    spine = months_df(tables.spark)
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [spine, *parts]
    )
    month = F.col("month")
    return (
        stacked.filter(month.between(1, 12) & period.month_number_filter(month))
        .groupBy("month")
        .agg(*[or_zero(F.sum(m)).alias(m) for m in measures])
        .orderBy("month")
    )


def _redeemed(redemption: DataFrame, period: Period) -> DataFrame:
    return redemption.filter(
        (F.col("redemption_year") == period.year)
        & period.month_number_filter(F.col("redemption_month"))
    )


def _charged(charging: DataFrame, period: Period) -> DataFrame:
    return charging.filter(
        (F.col("charging_year") == period.year)
        & period.month_number_filter(F.col("charging_month"))
    )


def gifts(tables: Tables, period: Period, k: int = fixed.LEADERBOARD_SIZE) -> DataFrame:
    """Gifts by redeemed points."""
    totals = (
        _redeemed(tables.redemption, period)
        .groupBy("gift_name")
        .agg(
            F.sum("offer_value").alias("total_gift_amount"),
            F.count(F.lit(1)).alias("total_requests"),
            F.sum("gift_point").alias("total_points"),
        )
    )
    order = [F.col("total_points").desc_nulls_last(), F.col("gift_name").asc_nulls_first()]
    return top_k(totals, k, order)


def card_types(tables: Tables, period: Period) -> DataFrame:
    """Charged against activated cards and points per card type, from either side."""
    charged = (
        _charged(tables.charging, period)
        .groupBy("card_type")
        .agg(
            F.sum(cards()).alias("total_cards_charged"),
            F.sum(points()).alias("total_points_charged"),
        )
    )
    activated = (
        tables.activation.filter(
            (F.col("activation_year") == period.year)
            & period.month_number_filter(F.col("activation_month"))
        )
        .groupBy("card_type")
        .agg(
            F.sum(cards()).alias("total_cards_activated"),
            F.sum(points()).alias("total_points_activated"),
        )
    )
    merged = full_merge(charged, activated, ["card_type"])
    return merged.select(
        "card_type", *[or_zero(F.col(c)).alias(c) for c in merged.columns if c != "card_type"]
    ).orderBy(F.col("total_points_charged").desc(), F.col("card_type").asc_nulls_first())


def active_client_ids(tables: Tables, period: Period) -> DataFrame:
    """Distinct clients who charged or redeemed in the period."""
    return (
        _charged(tables.charging, period)
        .select("client_id")
        .union(_redeemed(tables.redemption, period).select("client_id"))
        .distinct()
    )


def client_activity(tables: Tables, period: Period) -> DataFrame:
    """Charged and redeemed totals per client in one shuffle; a NULL client keeps zeros."""
    zero = F.lit(0)
    charged = _charged(tables.charging, period).select(
        "client_id",
        points().alias("charged_points"),
        cards().alias("charged_cards"),
        zero.cast("decimal(18,2)").alias("redeemed_points"),
        zero.cast("bigint").alias("redeem_requests"),
    )
    redeemed = _redeemed(tables.redemption, period).select(
        "client_id",
        zero.cast("decimal(18,2)").alias("charged_points"),
        zero.cast("bigint").alias("charged_cards"),
        F.col("gift_point").alias("redeemed_points"),
        F.lit(1).cast("bigint").alias("redeem_requests"),
    )
    measures = ("charged_points", "charged_cards", "redeemed_points", "redeem_requests")
    known = F.col("client_id").isNotNull()
    return (
        charged.unionByName(redeemed)
        .groupBy("client_id")
        .agg(*[or_zero(F.sum(F.when(known, F.col(m)))).alias(f"total_{m}") for m in measures])
    )


def clients(tables: Tables, period: Period, k: int = fixed.LEADERBOARD_SIZE) -> DataFrame:
    """Clients by charged points.

    The leaders are found before the master is joined, and the master is read against
    these few rows. They meet by a union of leaders with and without a master row, both
    made of the same columns, so that Spark computes the leaders once. A client with
    several master rows takes several places.
    """
    order = [F.col("total_charged_points").desc(), F.col("client_id").asc_nulls_first()]
    leaders = top_k(client_activity(tables, period), k, order)
    names = tables.client_master.select(F.col("glcid").alias("client_id"), "name")
    found = names.join(F.broadcast(leaders), "client_id").withColumn("in_master", F.lit(1))
    bare = leaders.withColumns(
        {"name": F.lit(None).cast("string"), "in_master": F.lit(0)}
    )
    known = F.max("in_master").over(Window.partitionBy("client_id"))
    rows = found.unionByName(bare).withColumn("known", known)
    fallback = F.concat(F.lit("Client #"), F.col("client_id").cast("string"))
    named = rows.filter(F.col("in_master") == F.col("known")).select(
        "client_id",
        F.coalesce(F.col("name"), fallback).alias("client_name"),
        *[c for c in leaders.columns if c != "client_id"],
    )
    return top_k(named, k, [*order, F.col("client_name").asc_nulls_first()])


def governorates(tables: Tables, period: Period) -> DataFrame:
    """Active clients, painters and others per governorate.

    Clients are counted once; painters once per master row, so repeated master rows
    inflate them.
    """
    master = tables.client_master.select(
        F.col("glcid").alias("client_id"), "is_painter", "governorate_id"
    )
    names = tables.governorate.select("governorate_id", F.col("name").alias("governorate"))
    painter = F.col("is_painter")
    per_client = (
        left_dim(
            left_dim(active_client_ids(tables, period), master, "client_id"),
            names,
            "governorate_id",
        )
        .groupBy("client_id", "governorate")
        .agg(
            sum_if(painter == 1, F.lit(1)).alias("painters"),
            sum_if(painter == 0, F.lit(1)).alias("non_painters"),
        )
    )
    return (
        per_client.groupBy("governorate")
        .agg(
            F.count("client_id").alias("total_clients"),
            F.sum("painters").alias("total_painters"),
            F.sum("non_painters").alias("total_non_painters"),
        )
        .select(
            F.coalesce(F.col("governorate"), F.lit("Other")).alias("governorate"),
            "total_clients",
            "total_painters",
            "total_non_painters",
        )
        .orderBy(F.col("total_clients").desc(), "governorate")
    )


def redemptions(tables: Tables, period: Period, source: str) -> DataFrame:
    """Monthly redemptions of one source, every month of the period present."""
    monthly = (
        tables.redemption.filter(
            (F.col("redemption_year") == period.year) & (F.col("source") == source)
        )
        .groupBy(F.col("redemption_month").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.sum("gift_point").alias("total_points"),
            F.sum("offer_value").alias("total_amount"),
        )
    )
    return (
        on_month_spine(tables.spark, monthly)
        .filter(period.month_number_filter(F.col("month")))
        .orderBy("month")
    )


def loyalty_details(tables: Tables, period: Period) -> Lists:
    """The full loyalty report, eight lists."""
    return Lists(
        {
            "summary": lambda: summary(tables, period.year),
            "trend": lambda: trend(tables, period),
            "gifts": lambda: gifts(tables, period),
            "card_types": lambda: card_types(tables, period),
            "clients": lambda: clients(tables, period),
            "governorates": lambda: governorates(tables, period),
            "vouchers": lambda: redemptions(tables, period, fixed.VOUCHER_SOURCE),
            "cash_calls": lambda: redemptions(tables, period, fixed.CASH_CALL_SOURCE),
        }
    )


def client_detail(tables: Tables, client_id: int) -> dict[str, DataFrame]:
    """Charging rows and redemptions per gift and month of one client, latest first."""
    charging = tables.charging.filter(F.col("client_id") == client_id).select(
        "charging_year", "charging_month", "card_type", "total_cards", "total_points"
    )
    redemption = (
        tables.redemption.filter(F.col("client_id") == client_id)
        .groupBy("redemption_year", "redemption_month", "gift_name")
        .agg(
            F.sum("offer_value").alias("gift_amount"),
            F.count(F.lit(1)).alias("total_request"),
            F.sum("gift_point").alias("total_point"),
        )
    )
    return {
        "charging": charging.orderBy(
            F.col("charging_year").desc(),
            F.col("charging_month").desc(),
            F.col("card_type").asc_nulls_first(),
            F.col("total_points").desc(),
        ),
        "redemption": redemption.orderBy(
            F.col("redemption_year").desc(),
            F.col("redemption_month").desc(),
            F.col("gift_name").asc_nulls_first(),
        ),
    }


def quarterly_trend(monthly: DataFrame) -> DataFrame:
    """The trend per quarter; client counts add up monthly counts."""
    return quarterly(monthly, TREND_MEASURES).orderBy("quarter")


def distinct_clients_by_quarter(tables: Tables, year: int) -> DataFrame:
    """Clients who charged, counted once per quarter."""
    quarter = F.ceil(F.col("charging_month") / F.lit(3)).cast("int").alias("quarter")
    return (
        tables.charging.filter(two_years(F.col("charging_year"), year))
        .select("charging_year", quarter, "client_id")
        .distinct()
        .groupBy("quarter")
        .agg(*_distinct_clients(year))
    )


def _yoy(kind: str) -> Column:
    return yoy_pct_loyalty(F.col(f"cy_{kind}"), F.col(f"py_{kind}"))


def summary_ratios(totals: DataFrame) -> DataFrame:
    """Average points per card, activation ratios and year-on-year changes of the summary."""
    def average(side: str) -> Column:
        return F.round(
            average_or(F.col(f"{side}_charging_points"), F.col(f"{side}_charging_cards")), 0
        )

    def activation(side: str) -> Column:
        charged = F.col(f"{side}_year_charging_cards")
        return F.when(charged > 0, share_pct(F.col(f"{side}_year_active_cards"), charged))

    return totals.select(
        average("cy").alias("cy_charging_avg"),
        average("py").alias("py_charging_avg"),
        activation("cy").alias("cy_activation_pct"),
        activation("py").alias("py_activation_pct"),
        _yoy("charging_cards").alias("charging_yoy"),
        _yoy("active_cards").alias("activation_yoy"),
        _yoy("redeem_amount").alias("redeem_yoy"),
        _yoy("active_clients").alias("clients_yoy"),
    )


def trend_ratios(trend_rows: DataFrame) -> DataFrame:
    """Year-on-year change and average points per card of each trend row."""
    def average(side: str, kind: str) -> Column:
        return average_or(F.col(f"{side}_{kind}_points"), F.col(f"{side}_{kind}_cards"), 0.0)

    return trend_rows.withColumns(
        {
            "charging_yoy": _yoy("charging_cards"),
            "activation_yoy": _yoy("active_cards"),
            "clients_yoy": _yoy("active_clients"),
            "joined_yoy": _yoy("joined_clients"),
            **{
                f"{side}_{kind}_avg": average(side, kind)
                for side in ("cy", "py")
                for kind in ("charging", "active")
            },
        }
    )


def trend_footer(trend_rows: DataFrame) -> DataFrame:
    """Column totals of the trend with their ratios."""
    return trend_ratios(footer_totals(trend_rows, TREND_MEASURES))


def card_type_averages(types: DataFrame) -> DataFrame:
    return types.withColumn(
        "card_average",
        average_or(F.col("total_points_charged"), F.col("total_cards_charged"), 0.0),
    )


def painter_ratio(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "painter_pct", share_pct(F.col("total_painters"), F.col("total_clients"))
    )


def loyalty_ratios(report: Mapping[str, DataFrame]) -> Lists:
    """Everything the loyalty page derives from its report."""
    return Lists(
        {
            "summary": lambda: summary_ratios(report["summary"]),
            "trend": lambda: trend_ratios(report["trend"]),
            "quarters": lambda: trend_ratios(quarterly_trend(report["trend"])),
            "footer": lambda: trend_footer(report["trend"]),
            "card_types": lambda: card_type_averages(report["card_types"]),
            "governorates": lambda: painter_ratio(report["governorates"]),
        }
    )
