"""Reporting periods: month sets, contiguous ranges, openings, year-to-date windows.

Two month semantics exist and are kept apart. ``month_filter`` tests the *set* of
months; ``range_filter`` covers every day from the first to the last month, so
months 1 and 3 include February.

Year tests on a date column are written as ranges, which reach the Parquet scan
and prune files; ``year(date) = y`` would not.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHLY, QUARTERLY, YEARLY = "monthly", "quarterly", "yearly"
MONTH_NAMES = tuple(calendar.month_name)[1:]


def quarter_months(quarter: int) -> tuple[int, ...]:
    """The three months of a quarter; empty for anything but 1 to 4."""
    return tuple(range(3 * quarter - 2, 3 * quarter + 1)) if quarter in (1, 2, 3, 4) else ()


def parse_months(text: str) -> tuple[int, ...]:
    """``"6,4,4"`` as sorted distinct month numbers."""
    return tuple(sorted({int(part) for part in text.split(",") if part.strip()}))


def in_year(date: Column, year: int) -> Column:
    """``year(date) = year`` as a range on the date itself."""
    return (date >= F.lit(dt.date(year, 1, 1))) & (date < F.lit(dt.date(year + 1, 1, 1)))


def in_years(date: Column, first: int, last: int) -> Column:
    """Date within the years ``first`` to ``last``, both included."""
    return (date >= F.lit(dt.date(first, 1, 1))) & (date < F.lit(dt.date(last + 1, 1, 1)))


def prune_years(
    df: DataFrame, partition: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """Limit a table to partitions of some years, where it is partitioned by year.

    Spark does not derive a partition test from a date test; without the partition
    column the date test alone decides, and prunes row groups only.
    """
    if partition not in df.columns:
        return df
    year = F.col(partition)
    if first is not None:
        df = df.filter(year >= first)
    return df if last is None else df.filter(year <= last)


def a_year_before(day: dt.date) -> dt.date:
    """Same day one year earlier; 29 February becomes 28 February."""
    last = calendar.monthrange(day.year - 1, day.month)[1]
    return dt.date(day.year - 1, day.month, min(day.day, last))


def ytd(date: Column, year: int, as_of: dt.date) -> Column:
    """Dates of ``year`` up to ``as_of``; the full year when it is already over."""
    return in_year(date, year) & (date <= F.lit(as_of))


def ytd_prior(date: Column, year: int, as_of: dt.date) -> Column:
    """Dates of the year before, up to the same day one year earlier."""
    return in_year(date, year - 1) & (date <= F.lit(a_year_before(as_of)))


def quarter_of(month: Column) -> Column:
    return F.ceil(month / F.lit(3)).cast("int")


@dataclass(frozen=True)
class Period:
    """A year with a set of months; ``yearly`` periods pass every month."""

    kind: str
    year: int
    months: tuple[int, ...] = ()

    @classmethod
    def yearly(cls, year: int) -> Period:
        return cls(YEARLY, year)

    @classmethod
    def monthly(cls, year: int, months: Iterable[int]) -> Period:
        return cls(MONTHLY, year, tuple(sorted(set(months))))

    @classmethod
    def from_quarters(cls, year: int, quarters: Iterable[int]) -> Period:
        months = {m for q in quarters for m in quarter_months(q)}
        return cls(QUARTERLY, year, tuple(sorted(months)))

    @classmethod
    def from_request(cls, request: Mapping[str, object]) -> Period:
        """Period of a ledger, sales or purchasing request.

        A quarter number is used only when no month list is given.
        """
        kind, year = str(request.get("Period")), int(request["Year"])
        if kind == YEARLY:
            return cls.yearly(year)
        text = request.get("Months")
        if kind == QUARTERLY and not text:
            months = quarter_months(int(request.get("Quarter") or 0))
        else:
            months = parse_months(str(text or ""))
        if not months:
            raise ValueError(f"request names no months: {dict(request)}")
        return cls(kind, year, months)

    @classmethod
    def from_loyalty_request(
        cls,
        request: Mapping[str, object] | None,
        today: dt.date,
        year: int = 0,
        month: int = 0,
    ) -> Period:
        """Period of a loyalty request, with its fallbacks.

        Missing months fall back to the given or current month *before* the quarter
        is looked at, so a quarter expands only when the month list is the empty text.
        """
        request = request or {}
        chosen_year = int(request.get("Year") or 0) or year or today.year
        kind = request.get("Period")
        kind = MONTHLY if kind is None else str(kind)
        text = request.get("Months")
        if text is None:
            text = str(month or today.month)
        quarter = request.get("Quarter")
        if kind == YEARLY:
            return cls.yearly(chosen_year)
        if kind == QUARTERLY and quarter is not None and text == "":
            return cls(kind, chosen_year, quarter_months(int(quarter)))
        return cls(kind, chosen_year, parse_months(str(text)))

    @property
    def is_yearly(self) -> bool:
        return self.kind == YEARLY

    @property
    def month_set(self) -> tuple[int, ...]:
        return tuple(range(1, 13)) if self.is_yearly else self.months

    @property
    def quarters(self) -> tuple[int, ...]:
        return tuple(sorted({(m + 2) // 3 for m in self.month_set}))

    @property
    def first_month(self) -> int:
        return min(self._months_or_fail())

    @property
    def last_month(self) -> int:
        return max(self._months_or_fail())

    @property
    def start(self) -> dt.date:
        return dt.date(self.year, self.first_month, 1)

    @property
    def end(self) -> dt.date:
        month = self.last_month
        return dt.date(self.year, month, calendar.monthrange(self.year, month)[1])

    @property
    def label(self) -> str:
        """``June 2000``, ``Apr, Jun 2000``, ``Q1, Q2 2000`` or ``Year 2000``."""
        if self.is_yearly:
            return f"Year {self.year}"
        if self.kind == QUARTERLY:
            names = [f"Q{q}" for q in self.quarters]
        elif len(self.months) == 1:
            names = [MONTH_NAMES[self.months[0] - 1]]
        else:
            names = [MONTH_NAMES[m - 1][:3] for m in self.months]
        return f"{', '.join(names)} {self.year}"

    def prior_year(self) -> Period:
        return replace(self, year=self.year - 1)

    def month_number_filter(self, month: Column) -> Column:
        """Test on a stored month number."""
        if self.is_yearly:
            return F.lit(True)
        return month.isin(*self.months) if self.months else F.lit(False)

    def month_filter(self, date: Column) -> Column:
        """``month(date) IN (...)``; every month for a yearly period."""
        return F.lit(True) if self.is_yearly else self.month_number_filter(F.month(date))

    def date_filter(self, date: Column) -> Column:
        """Dates of the year that fall in the month set."""
        return in_year(date, self.year) & self.month_filter(date)

    def range_filter(self, date: Column) -> Column:
        """Every day from the first to the last month."""
        return (date >= F.lit(self.start)) & (date <= F.lit(self.end))

    def before_start(self, date: Column) -> Column:
        return date < F.lit(self.start)

    def before_year(self, date: Column) -> Column:
        return date < F.lit(dt.date(self.year, 1, 1))

    def until_end(self, date: Column) -> Column:
        return date <= F.lit(self.end)

    def _months_or_fail(self) -> tuple[int, ...]:
        if not self.month_set:
            raise ValueError("the period has no months")
        return self.month_set


def request_months(period: Column, months: Column, quarter: Column) -> Column:
    """Month array of a request row, for tables of many requests.

    Sorted and distinct; empty for a row that names no months.
    """
    empty = F.array().cast("array<int>")
    listed = F.transform(
        F.split(F.coalesce(months, F.lit("")), ","),
        lambda part: F.trim(part).try_cast("int"),
    )
    whole_quarter = F.when(
        quarter.between(1, 4),
        F.sequence(quarter * 3 - 2, quarter * 3),
    ).otherwise(empty)
    chosen = (
        F.when(period == YEARLY, F.sequence(F.lit(1), F.lit(12)))
        .when(
            (period == QUARTERLY) & (F.coalesce(months, F.lit("")) == ""), whole_quarter
        )
        .otherwise(F.filter(listed, lambda m: m.isNotNull()))
    )
    return F.array_sort(F.array_distinct(chosen))


def month_label(year: Column, month: Column) -> Column:
    """``June 2000`` as a Column."""
    return F.date_format(F.make_date(year, month, F.lit(1)), "MMMM yyyy")
