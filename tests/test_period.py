from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizpanel.operators.period import (
    Period,
    a_year_before,
    parse_months,
    prune_years,
    quarter_months,
    request_months,
    ytd,
    ytd_prior,
)

TODAY = dt.date(2026, 6, 23)


def days(spark, *texts):
    rows = [(dt.date.fromisoformat(t),) for t in texts]
    return spark.createDataFrame(rows, "d date")


def kept(df, predicate):
    return [r.d.isoformat() for r in df.filter(predicate).orderBy("d").collect()]


def test_quarters_and_months():
    assert quarter_months(2) == (4, 5, 6)
    assert quarter_months(0) == ()
    assert parse_months("6, 4,4") == (4, 6)
    assert Period.from_quarters(2000, [3, 1, 3]).months == (1, 2, 3, 7, 8, 9)
    assert Period.monthly(2000, [12, 1]).quarters == (1, 4)
    assert Period.yearly(2000).quarters == (1, 2, 3, 4)


def test_request_forms():
    month = {"Period": "monthly", "Months": "6", "Quarter": 0, "Year": 2026}
    assert Period.from_request(month) == Period("monthly", 2026, (6,))
    year = {"Period": "yearly", "Months": "", "Quarter": 0, "Year": 2026}
    assert Period.from_request(year).is_yearly
    quarter = {"Period": "quarterly", "Months": None, "Quarter": 4, "Year": 2026}
    assert Period.from_request(quarter).months == (10, 11, 12)
    listed = {"Period": "quarterly", "Months": "1,2,3", "Quarter": 4, "Year": 2026}
    assert Period.from_request(listed).months == (1, 2, 3)
    with pytest.raises(ValueError):
        Period.from_request({"Period": "quarterly", "Months": "", "Quarter": 9, "Year": 2026})


def test_loyalty_fallbacks():
    """Missing months become the current month before the quarter is looked at."""
    assert Period.from_loyalty_request(None, TODAY) == Period("monthly", 2026, (6,))
    missing = {"Period": "quarterly", "Months": None, "Quarter": 1, "Year": 2025}
    assert Period.from_loyalty_request(missing, TODAY).months == (6,)
    blank = {"Period": "quarterly", "Months": "", "Quarter": 1, "Year": 2025}
    assert Period.from_loyalty_request(blank, TODAY).months == (1, 2, 3)
    assert Period.from_loyalty_request({"Year": 0}, TODAY, year=2024, month=3) == Period(
        "monthly", 2024, (3,)
    )
    assert Period.from_loyalty_request({"Period": "monthly", "Months": ""}, TODAY).months == ()


def test_labels():
    assert Period.yearly(2000).label == "Year 2000"
    assert Period.monthly(2000, [6]).label == "June 2000"
    assert Period.monthly(2000, [6, 4]).label == "Apr, Jun 2000"
    assert Period.from_quarters(2000, [2]).label == "Q2 2000"
    assert Period.from_quarters(2000, [2, 1]).label == "Q1, Q2 2000"


def test_month_set_and_range_differ(spark):
    """Months 1 and 3: the set leaves February out, the range covers it."""
    df = days(spark, "1999-12-31", "2000-01-01", "2000-02-29", "2000-03-31", "2000-04-01")
    gap = Period.monthly(2000, [3, 1])
    assert kept(df, gap.date_filter(F.col("d"))) == ["2000-01-01", "2000-03-31"]
    assert kept(df, gap.range_filter(F.col("d"))) == ["2000-01-01", "2000-02-29", "2000-03-31"]
    assert kept(df, gap.before_start(F.col("d"))) == ["1999-12-31"]
    assert kept(df, gap.until_end(F.col("d")))[-1] == "2000-03-31"
    assert kept(df, Period.monthly(2000, []).month_filter(F.col("d"))) == []


def test_openings(spark):
    df = days(spark, "1999-12-31", "2000-01-15", "2000-06-01")
    june = Period.monthly(2000, [6])
    assert kept(df, june.before_year(F.col("d"))) == ["1999-12-31"]
    assert kept(df, june.before_start(F.col("d"))) == ["1999-12-31", "2000-01-15"]


def test_leap_day_year_to_date(spark):
    assert a_year_before(dt.date(2024, 2, 29)) == dt.date(2023, 2, 28)
    df = days(spark, "2023-02-28", "2023-03-01", "2024-02-29", "2024-03-01")
    day = dt.date(2024, 2, 29)
    assert kept(df, ytd(F.col("d"), 2024, day)) == ["2024-02-29"]
    assert kept(df, ytd_prior(F.col("d"), 2024, day)) == ["2023-02-28"]
    # For a past year the whole year counts, and the year before is cut by today.
    assert kept(df, ytd(F.col("d"), 2023, day)) == ["2023-02-28", "2023-03-01"]


def test_month_end():
    assert Period.monthly(2024, [2]).end == dt.date(2024, 2, 29)
    assert Period.monthly(2023, [2]).end == dt.date(2023, 2, 28)
    assert Period.yearly(2023).end == dt.date(2023, 12, 31)


def test_request_month_column(spark):
    rows = [
        ("yearly", "", 0),
        ("quarterly", "", 2),
        ("quarterly", None, 7),
        ("quarterly", "9,8", 2),
        ("monthly", "6, 4,4,x", 0),
        ("monthly", None, 3),
    ]
    df = spark.createDataFrame(rows, "period string, months string, quarter int")
    found = [
        r.m
        for r in df.select(
            request_months(F.col("period"), F.col("months"), F.col("quarter")).alias("m")
        ).collect()
    ]
    assert found == [list(range(1, 13)), [4, 5, 6], [], [8, 9], [4, 6], []]


def test_prune_years_needs_the_partition_column(spark):
    df = spark.createDataFrame([(1999,), (2000,), (2001,)], "y int")
    assert prune_years(df, "other", 2000, 2000).count() == 3
    assert prune_years(df, "y", 2000, 2000).count() == 1
    assert prune_years(df, "y", last=2000).count() == 2
