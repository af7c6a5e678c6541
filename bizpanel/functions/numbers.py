"""Numeric Column expressions: defaults, conditional sums, ratios and growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(value: Column) -> Column:
    """``value`` with NULL read as 0."""
    return F.coalesce(value, F.lit(0))


def or_default(value: Column, default: object) -> Column:
    """``value`` with NULL read as ``default``."""
    return F.coalesce(value, F.lit(default))


def sum_where(predicate: Column, value: Column) -> Column:
    """SUM over the rows that satisfy ``predicate``; NULL when there are none."""
    return F.sum(F.when(predicate, value))


def sum_if(predicate: Column, value: Column) -> Column:
    """SUM(CASE WHEN predicate THEN value ELSE 0 END); 0 when no row matches."""
    return F.sum(F.when(predicate, value).otherwise(F.lit(0)))


def count_if(predicate: Column) -> Column:
    """Number of rows that satisfy ``predicate``."""
    return F.count(F.when(predicate, F.lit(1)))


def max_or(value: Column, default: object) -> Column:
    """MAX with a default for groups that hold only NULLs."""
    return F.coalesce(F.max(value), F.lit(default))


def clamp_zero(value: Column) -> Column:
    """Negative values read as 0 (NULL stays NULL)."""
    return F.when(value < 0, F.lit(0)).otherwise(value)


def _present(value: Column) -> Column:
    """True where a value is neither NULL nor 0."""
    return value.isNotNull() & (value != 0)


def _percent(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double") * F.lit(100.0)


def ratio_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole x 100, rounded; NULL when either side is 0 or NULL."""
    return F.when(
        _present(part) & _present(whole), F.round(_percent(part, whole), digits)
    )


def pct_of(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole x 100, rounded, a missing part as 0; NULL when the whole is 0 or NULL."""
    return F.when(_present(whole), F.round(_percent(or_zero(part), whole), digits))


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole x 100, rounded; 0 when the whole is not positive."""
    return F.when(
        whole > 0, F.round(_percent(or_zero(part), whole), digits)
    ).otherwise(F.lit(0.0))


def growth_pct(previous: Column, current: Column) -> Column:
    """Change from ``previous`` to ``current`` in percent; NULL when either is 0 or NULL."""
    return F.when(
        _present(previous) & _present(current), _percent(current - previous, previous)
    )


def yoy_pct_loyalty(current: Column, prior: Column) -> Column:
    """Year-on-year percent of the loyalty pages: 100 or 0 when the prior year is 0."""
    return (
        F.when(current.isNull() | prior.isNull(), F.lit(None).cast("double"))
        .when(prior == 0, F.when(current > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
        .otherwise(F.round(_percent(current - prior, prior), 1))
    )


def average_or(total: Column, count: Column, default: object = None) -> Column:
    """total / count where the count is positive, else ``default``."""
    return F.when(
        count > 0, total.cast("double") / count.cast("double")
    ).otherwise(F.lit(default).cast("double"))


def native_amount(
    currency: Column, base_currency: str, book: Column, transaction: Column
) -> Column:
    """Book amount for base-currency rows, transaction amount for all others."""
    return F.when(currency == base_currency, book).otherwise(transaction)
