"""Sales: one month, by period with weights and volumes, customer leaderboard, mix."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.functions import fixed_values as fixed
from bizpanel.functions.classify import (
    any_of,
    channel_predicates,
    customer_type_filter,
    target_badge,
)
from bizpanel.functions.numbers import (
    clamp_zero,
    growth_pct,
    max_or,
    or_zero,
    pct_of,
    ratio_pct,
    sum_if,
    sum_where,
)
from bizpanel.operators.aggregates import metrics, top_k
from bizpanel.operators.joins import bounded_by, left_dim, one_row, semi
from bizpanel.operators.lineage import cut
from bizpanel.operators.period import Period, in_years, prune_years, ytd, ytd_prior
from bizpanel.plans import ledger
from bizpanel.sources.schema import HEADER_YEAR, YEAR_PARTITIONS
from bizpanel.sources.tables import Tables

CHANNELS = ("white", "color_center", "project", "export")
WINDOWS = ("period", "prior", "ytd", "ytd_prior")
LABELS = {
    "white": "White Customers",
    "color_center": "Color Centers",
    "project": "Projects",
    "export": "Export",
}


def taxable_amount() -> Column:
    return F.col("total_taxable_amount") * F.col("exchange_rate")


def date_windows(date: Column, period: Period, as_of: dt.date) -> dict[str, Column]:
    """The period, the same months a year earlier, and both year-to-date windows."""
    return {
        "period": period.date_filter(date),
        "prior": period.prior_year().date_filter(date),
        "ytd": ytd(date, period.year, as_of),
        "ytd_prior": ytd_prior(date, period.year, as_of),
    }


def with_channels(df: DataFrame) -> DataFrame:
    """Add one flag per channel; a missing code is in no channel."""
    tests = channel_predicates(F.col("sales_person_number"), F.col("customer_number"))
    return df.withColumns({c: F.coalesce(tests[c], F.lit(False)) for c in CHANNELS})


def header_metrics(header: DataFrame, period: Period, as_of: dt.date) -> DataFrame:
    """All amounts of the invoice headers in one scan.

    Period amounts go by the *stored* invoice year, year-to-date amounts by the date.
    Invoices are first added up per combination of windows and channels, of which there
    are few, and the figures are read off these sums: an invoice is added once, not once
    per figure. Sums without rows stay NULL, except the two the report defaults to 0.
    """
    date = F.col("invoice_date")
    windows = {
        "in_period": (F.col("invoice_year") == period.year) & period.month_filter(date),
        "in_ytd": ytd(date, period.year, as_of),
        "in_ytd_prior": ytd_prior(date, period.year, as_of),
    }
    wanted = any_of(windows.values())
    sums = (
        with_channels(header.filter(wanted).withColumns(windows))
        .groupBy(*windows, *CHANNELS)
        .agg(
            F.sum(taxable_amount()).alias("amount"),
            F.sum("total_final_amount_base").alias("final_amount"),
        )
    )
    figures = {
        "total_sales_amount": "sum(IF(in_period, amount, NULL))",
        **{f"{c}_sales": f"sum(IF(in_period AND {c}, amount, NULL))" for c in CHANNELS},
        "total_final_amount": "coalesce(sum(IF(in_period, final_amount, NULL)), 0)",
        "sales_ytd": "sum(IF(in_ytd, amount, NULL))",
        "sales_ytd_prior": "sum(IF(in_ytd_prior, amount, NULL))",
        "export_ytd": "coalesce(sum(IF(in_ytd AND export, amount, NULL)), 0)",
        "export_ytd_prior": "sum(IF(in_ytd_prior AND export, amount, NULL))",
    }
    return sums.agg(*[F.expr(f"{sql} AS {name}") for name, sql in figures.items()])


def customer_ledger(journal: DataFrame, in_period: Column, balance_rows: Column) -> DataFrame:
    """Collections of the period and the customer balance, in one ledger scan."""
    return metrics(
        journal.filter(ledger.customer_rows()),
        {
            "total_collection": (in_period & ledger.collection_rows(), F.col("credit_book")),
            "customer_balance": (balance_rows, ledger.book_balance()),
        },
    )


def _two_years_of_lines(tables: Tables, period: Period) -> DataFrame:
    first, last = period.year - 1, period.year
    return prune_years(tables.sales_line, "line_year", first, last).filter(
        in_years(F.col("invoice_date"), first, last)
    )


def line_measures(tables: Tables, period: Period, as_of: dt.date) -> DataFrame:
    """Weight and volume per invoice in each window.

    Lines are summed per invoice before they meet their headers: an invoice with very
    many lines reaches the join as one row, and the join reuses the shuffle.
    """
    lines = _two_years_of_lines(tables, period)
    items = tables.item_master.select("item_id", "volume")
    windows = date_windows(F.col("invoice_date"), period, as_of)
    measures = {"weight": "line_weight", "volume": "invoiced_quantity * volume"}
    return (
        left_dim(lines.withColumns(windows), items, "item_id")
        .groupBy("int_id")
        .agg(
            *[
                F.expr(f"sum(IF({w}, {value}, NULL)) AS {m}_{w}")
                for m, value in measures.items()
                for w in WINDOWS
            ]
        )
    )


def line_metrics(tables: Tables, period: Period, as_of: dt.date) -> DataFrame:
    """Weights per window and channel, and color-center volumes, as one row."""
    header = tables.sales_header
    if tables.stored:
        # headers of any year may belong to these lines, but only those within their ids
        header = bounded_by(header, "internal_id", _two_years_of_lines(tables, period), "int_id")
    header = header.select(
        F.col("internal_id").alias("int_id"), "sales_person_number", "customer_number"
    )
    quantities = [f"{m}_{w}" for m in ("weight", "volume") for w in WINDOWS]
    by_channel = (
        with_channels(left_dim(line_measures(tables, period, as_of), header, "int_id"))
        .groupBy(*CHANNELS)
        .agg(*[F.expr(f"sum({q}) AS {q}") for q in quantities])
    )
    figures = {}
    for w in WINDOWS:
        figures[f"total_weight_{w}"] = f"sum(weight_{w})"
        for c in CHANNELS:
            figures[f"{c}_weight_{w}"] = f"sum(IF({c}, weight_{w}, NULL))"
        figures[f"color_center_volume_{w}"] = f"sum(IF(color_center, volume_{w}, NULL))"
    return by_channel.agg(
        *[F.expr(f"coalesce({sql}, 0) AS {name}") for name, sql in figures.items()]
    )


def sales_channels(header: DataFrame, period: Period, as_of: dt.date) -> DataFrame:
    """Sales per exclusive sales-person channel in the four date windows."""
    date, amount = F.col("invoice_date"), taxable_amount()
    windows = date_windows(date, period, as_of)
    channel = F.substring("sales_person_number", 1, 1).alias("channel")
    two_years = prune_years(header, HEADER_YEAR, period.year - 1, period.year)
    return (
        two_years.filter(in_years(date, period.year - 1, period.year))
        .groupBy(channel)
        .agg(*[or_zero(sum_where(windows[w], amount)).alias(f"amount_{w}") for w in WINDOWS])
    )


def sales_month(tables: Tables, year: int, month: int, as_of: dt.date) -> DataFrame:
    """The one-month sales figures: amounts, year-to-date, collection and balance."""
    tables.require_open(year)
    period = Period.monthly(year, [month])
    amounts = header_metrics(tables.sales_header, period, as_of).drop("total_final_amount")
    date = F.col("journal_date")
    return one_row(
        amounts,
        customer_ledger(tables.journal_line, period.date_filter(date), F.lit(True)),
    )


def sales_period(tables: Tables, period: Period, as_of: dt.date) -> DataFrame:
    """The full sales figures of a period as one row of 36 columns.

    Three scans: headers, lines (with items and headers), ledger.
    """
    tables.require_open(period.year)
    date = F.col("journal_date")
    return one_row(
        header_metrics(tables.sales_header, period, as_of),
        line_metrics(tables, period, as_of),
        customer_ledger(tables.journal_line, period.date_filter(date), F.lit(True)),
    )


#: The year partition of the sales lines.
LINE_YEAR = YEAR_PARTITIONS["sales_line"][0]


def of_years(df: DataFrame, partition: str, years: Collection[int | None] | None) -> DataFrame:
    """Rows dated in the given years (None: without a date), from their partitions alone where there are such."""
    if years is None:
        return df
    known = sorted(y for y in years if y is not None)

    def among(year: Column) -> Column:
        return (year.isin(known) | year.isNull()) if None in years else year.isin(known)

    dated = df.filter(among(F.year("invoice_date")))
    return dated.filter(among(F.col(partition))) if partition in df.columns else dated


def customers_of(per_invoice: DataFrame, header: DataFrame, years: Collection[int | None] | None) -> DataFrame:
    """Invoices (``internal_id``) with their customer, inner.

    Invoices of some years are first sought among the headers of these years and of those next to them. Only if
    some are not there are the other partitions read for them. Of the invoices their ids alone are kept meanwhile.
    """
    named = header.withColumnRenamed("customer_number", "customer_no")
    if years is None or HEADER_YEAR not in header.columns:
        return per_invoice.join(named.select("internal_id", "customer_no"), "internal_id")
    near = {y + d for y in years if y is not None for d in (-1, 0, 1)}
    here = F.coalesce(F.col(HEADER_YEAR).isin(sorted(near)), F.lit(False))
    wanted = named.select("internal_id", "customer_no", HEADER_YEAR)
    first, others = (wanted.filter(test).drop(HEADER_YEAR) for test in (here, ~here))
    if not others.isEmpty():
        ids = per_invoice.select("internal_id").filter("internal_id IS NOT NULL").distinct()
        missing = cut(ids.join(first, "internal_id", "left_anti"))
        if not missing.isEmpty():
            first = first.unionByName(semi(others, missing, "internal_id"))
    return per_invoice.join(first, "internal_id")


def customer_monthly_summary(
    tables: Tables,
    names: DataFrame | None = None,
    years: Collection[int | None] | None = None,
    among: Collection[int | None] | None = None,
) -> DataFrame:
    """Amount, weight and volume per customer and month, rebuilt from the invoices.

    Amounts go by the invoice date, weights and volumes by the line date. ``names``
    (customer_no, customer_name) supplies the names; without it they are NULL. With ``years`` the
    summary of these years alone is built, from the lines and headers of their partitions. ``among`` names all years of
    which they are a part: customers are sought as for all of them.
    """
    header = tables.sales_header
    amounts = of_years(header, HEADER_YEAR, years).select(
        F.col("customer_number").alias("customer_no"),
        F.year("invoice_date").alias("summary_year"),
        F.month("invoice_date").alias("summary_month"),
        taxable_amount().alias("total_amount"),
    )
    per_invoice = (
        left_dim(
            of_years(tables.sales_line, LINE_YEAR, years),
            tables.item_master.select("item_id", "volume"),
            "item_id",
        )
        .groupBy(
            F.col("int_id").alias("internal_id"),
            F.year("invoice_date").alias("summary_year"),
            F.month("invoice_date").alias("summary_month"),
        )
        .agg(
            F.sum("line_weight").alias("total_weight"),
            F.sum(F.col("invoiced_quantity") * F.col("volume")).alias("total_volume"),
        )
    )
    quantities = customers_of(per_invoice, header, years if among is None else among).drop("internal_id")
    summary = (
        amounts.unionByName(quantities, allowMissingColumns=True)
        .groupBy("customer_no", "summary_year", "summary_month")
        .agg(
            *[
                or_zero(F.sum(m)).cast("decimal(18,2)").alias(m)
                for m in ("total_amount", "total_weight", "total_volume")
            ]
        )
    )
    if names is None:
        return summary.withColumn("customer_name", F.lit(None).cast("string"))
    return left_dim(summary, names, "customer_no")


def max_month(year: int, as_of: dt.date) -> int:
    """Last month of the leaderboard: the current one, or 12 for any other year."""
    return as_of.month if year == as_of.year else 12


def customer_breakdown(
    tables: Tables,
    kind: str | None,
    year: int,
    as_of: dt.date,
    k: int = fixed.LEADERBOARD_SIZE,
) -> DataFrame:
    """Leading customers of a type by amount of the year to date, against the year before.

    Only the year and the current month set the window; the requested months do not.
    A missing or unknown ``kind`` means other customers. The summary is summed per
    customer before it meets the customer master.
    """
    chosen = year or as_of.year
    month = F.col("summary_month") <= max_month(chosen, as_of)
    this_year = (F.col("summary_year") == chosen) & month
    last_year = (F.col("summary_year") == chosen - 1) & month
    aggs = [max_or(F.col("customer_name"), "Unknown Customer").alias("customer_name")]
    for measure in ("amount", "weight", "volume"):
        value = F.col(f"total_{measure}")
        aggs.append(sum_if(this_year, value).alias(f"{measure}_ytd"))
        aggs.append(sum_if(last_year, value).alias(f"{measure}_ytd_prior"))
    totals = (
        tables.customer_monthly_summary.filter(
            F.col("summary_year").isin(chosen, chosen - 1)
        )
        .groupBy("customer_no")
        .agg(*aggs)
    )
    of_kind = tables.customer_master.filter(
        customer_type_filter(kind, F.col("customer_sales_person"), F.col("customer_no"))
    )
    chosen_customers = semi(totals, of_kind.select("customer_no"), "customer_no")
    ranked = top_k(chosen_customers, k, [F.col("amount_ytd").desc(), F.col("customer_no").asc()])
    return ranked.withColumnRenamed("customer_no", "customer_number")


def leaderboard_totals(leaders: DataFrame, kind: str | None) -> DataFrame:
    """Totals and averages over the leaderboard; color centers count volume, not weight."""
    unit = "volume" if kind == "Color Centers" else "weight"
    totals = leaders.agg(
        F.count(F.lit(1)).alias("customers"),
        or_zero(F.sum("amount_ytd")).alias("total_amount"),
        or_zero(F.sum("amount_ytd_prior")).alias("total_amount_prior"),
        or_zero(F.sum(f"{unit}_ytd")).alias("total_quantity"),
        or_zero(F.sum(f"{unit}_ytd_prior")).alias("total_quantity_prior"),
    )

    def average(total: str) -> Column:
        return F.when(
            F.col("customers") > 0, F.col(total).cast("double") / F.col("customers")
        ).otherwise(F.lit(0.0))

    return totals.withColumn("average_amount", average("total_amount")).withColumn(
        "average_amount_prior", average("total_amount_prior")
    )


def sales_mix(sales: DataFrame) -> DataFrame:
    """Local, export and other sales with their shares, and year-to-date growth."""
    def n(name: str) -> Column:
        return or_zero(F.col(name))

    base = sales.select(
        n("total_sales_amount").alias("total_sales"),
        n("total_collection").alias("total_collection"),
        n("total_final_amount").alias("total_final"),
        n("export_sales").alias("export_sales"),
        (n("total_sales_amount") - n("export_sales")).alias("local_sales"),
        n("white_sales").alias("white_sales"),
        n("color_center_sales").alias("color_center_sales"),
        n("project_sales").alias("project_sales"),
        n("sales_ytd").alias("ytd_total"),
        n("sales_ytd_prior").alias("ytd_total_prior"),
        (n("sales_ytd") - n("export_ytd")).alias("ytd_local"),
        (n("sales_ytd_prior") - n("export_ytd_prior")).alias("ytd_local_prior"),
        n("export_ytd").alias("ytd_export"),
        n("export_ytd_prior").alias("ytd_export_prior"),
    )
    c = F.col
    named = c("white_sales") + c("color_center_sales") + c("project_sales")
    collection_base = F.when(c("total_final") != 0, c("total_final")).otherwise(c("total_sales"))
    out = base.withColumn("other_sales", clamp_zero(c("local_sales") - named))
    out = out.withColumns(
        {
            "collection_ratio": pct_of(c("total_collection"), collection_base),
            "local_pct": ratio_pct(c("local_sales"), c("total_sales")),
            "export_pct": ratio_pct(c("export_sales"), c("total_sales")),
            "white_pct": ratio_pct(c("white_sales"), c("local_sales")),
            "color_center_pct": ratio_pct(c("color_center_sales"), c("local_sales")),
            "project_pct": ratio_pct(c("project_sales"), c("local_sales")),
            "other_pct": ratio_pct(c("other_sales"), c("local_sales")),
            "ytd_growth": F.round(growth_pct(c("ytd_total_prior"), c("ytd_total")), 1),
            "ytd_local_growth": F.round(growth_pct(c("ytd_local_prior"), c("ytd_local")), 1),
            "ytd_export_growth": F.round(
                growth_pct(c("ytd_export_prior"), c("ytd_export")), 1
            ),
        }
    )
    return out.withColumn("collection_badge", target_badge(c("collection_ratio")))


def _other_weight(window: str) -> Column:
    """Weight of no channel: local weight beyond the three local channels, not below 0."""
    def n(channel: str) -> Column:
        return or_zero(F.col(f"{channel}_weight_{window}"))

    local = clamp_zero(n("total") - n("export"))
    return clamp_zero(local - (n("white") + n("color_center") + n("project")))


def weight_comparison(sales: DataFrame, mode: str = "period") -> DataFrame:
    """Six rows of prior and current weight: the channels, other, and the total.

    ``mode`` is ``period`` (against the same months a year earlier) or ``ytd``.
    """
    current, prior, total = {
        "period": ("period", "prior", "Total Weight"),
        "ytd": ("ytd", "ytd_prior", "Total YTD Weight"),
    }[mode]
    sides: Mapping[str, tuple[Column, Column]] = {
        **{
            LABELS[c]: (F.col(f"{c}_weight_{prior}"), F.col(f"{c}_weight_{current}"))
            for c in CHANNELS
        },
        "Other": (_other_weight(prior), _other_weight(current)),
        total: (F.col(f"total_weight_{prior}"), F.col(f"total_weight_{current}")),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(label).alias("label"),
                or_zero(before).cast("double").alias("prior_weight"),
                or_zero(now).cast("double").alias("current_weight"),
            )
            for i, (label, (before, now)) in enumerate(sides.items(), 1)
        ]
    )
    return (
        sales.select(F.explode(rows).alias("r"))
        .select("r.*")
        .withColumn(
            "growth_pct",
            F.round(growth_pct(F.col("prior_weight"), F.col("current_weight")), 1),
        )
    )
