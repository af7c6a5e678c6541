"""Predicates and filters. Codes are always compared as text, and blanks behind them do not count."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.functions.classify import all_of, any_of

ALL = "All"
_AFTER_BLANK = "!"


def in_list(column: Column, values: Iterable[object]) -> Column:
    """IN on text; blanks behind the code or the value do not count.

    The trimmed comparison decides. It cannot reach the Parquet scan, so the same test is said again in bounds that
    can: a code itself, or what lies between the code with a blank and the code with the character after the blank.
    """
    codes = sorted({str(v).rstrip(" ") for v in values})
    text = column.cast("string")
    padded = [(text >= code + " ") & (text < code + _AFTER_BLANK) for code in codes]
    return F.rtrim(text).isin(*codes) & any_of([text.isin(*codes), *padded])


def not_in_list(column: Column, values: Iterable[object]) -> Column:
    """NOT IN on text; a NULL code does not pass."""
    return ~in_list(column, values)


def prefix(column: Column, *starts: str) -> Column:
    return any_of(column.startswith(s) for s in starts)


def not_prefix(column: Column, *starts: str) -> Column:
    """None of the prefixes; a NULL code does not pass."""
    return all_of(~column.startswith(s) for s in starts)


def doc_type(journal_no: Column, kinds: Iterable[str]) -> Column:
    """Document type: the first two characters of the journal number."""
    return in_list(F.substring(journal_no, 1, 2), kinds)


def positive(column: Column) -> Column:
    return column > 0


def non_empty(column: Column) -> Column:
    """Neither NULL nor empty nor blanks only."""
    return F.coalesce(F.rtrim(column), F.lit("")) != ""


def state_eq(column: Column, code: int) -> Column:
    return column == code


def trim_in(column: Column, values: Iterable[str]) -> Column:
    return in_list(F.trim(column), values)


def search(df: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column contains the text, ignoring case; all rows for blank text."""
    if not query.strip():
        return df
    needle = query.lower()
    hits = [
        F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
        for c in columns
    ]
    return df.filter(any_of(hits))


def _chosen(choices: Mapping[str, str | None]) -> dict[str, str]:
    return {c: v for c, v in choices.items() if v not in (None, "", ALL)}


def facets(df: DataFrame, choices: Mapping[str, str | None]) -> DataFrame:
    """Keep rows equal to every chosen value; ``All`` or blank leaves a column open."""
    return df.filter(all_of(F.col(c) == v for c, v in _chosen(choices).items()))


def item_bucket(item_type: Column, bucket: str) -> Column:
    """Item type bucket: ``ALL``, ``R``, ``P`` or ``OTHERS`` (a missing type is other)."""
    kind = F.coalesce(item_type, F.lit(""))
    if bucket == "ALL":
        return F.lit(True)
    if bucket == "OTHERS":
        return ~kind.isin("R", "P")
    return kind == bucket


def having(df: DataFrame, predicate: Column) -> DataFrame:
    """Filter on aggregated columns and group keys."""
    return df.filter(predicate)


def facet_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a column, sorted."""
    return (
        df.filter(non_empty(F.col(column))).select(column).distinct().orderBy(column)
    )


def facet_counts(
    df: DataFrame, columns: Sequence[str], choices: Mapping[str, str | None] | None = None
) -> DataFrame:
    """All value lists of several facets from one scan: ``facet``, ``value``, ``rows``, ``shown``.

    ``rows`` counts all rows of a value. ``shown`` counts those that the choices leave, a facet's own choice left out: what
    choosing this value instead would show. Values that nothing is left of stay, with 0. NULL and empty values
    are no entries. The columns are counted by grouping sets, partly in each task, so that a value that most rows have
    is a few rows when it is shuffled.
    """
    chosen = _chosen(choices or {})

    def passes(facet: str) -> Column:
        return all_of(F.coalesce(F.col(c) == v, F.lit(False)) for c, v in chosen.items() if c != facet)

    # facets that are not chosen share one test
    test_of = {c: c if c in chosen else "" for c in columns}
    tests = {facet: f"_shown_{i}" for i, facet in enumerate(dict.fromkeys(test_of.values()))}
    kept = df.select(
        *[F.col(c).cast("string").alias(f"_value_{i}") for i, c in enumerate(columns)],
        *[passes(facet).cast("int").alias(name) for facet, name in tests.items()],
    )
    names = [f"_value_{i}" for i in range(len(columns))]
    grouped = kept.groupingSets([[n] for n in names], *names).agg(
        *[F.grouping(n).alias(f"_open{n}") for n in names],
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(name).alias(name) for name in tests.values()],
    )

    def of_facet(entry: Callable[[int, str], Column]) -> Column:
        return F.coalesce(*[F.when(F.col(f"_open{n}") == 0, entry(i, n)) for i, n in enumerate(names)])

    counted = grouped.select(
        of_facet(lambda i, n: F.lit(columns[i])).alias("facet"),
        of_facet(lambda i, n: F.col(n)).alias("value"),
        "rows",
        of_facet(lambda i, n: F.col(tests[test_of[columns[i]]])).alias("shown"),
    )
    return counted.filter(non_empty(F.col("value"))).orderBy("facet", "value")
