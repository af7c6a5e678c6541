"""Batch upsert and delete on a master table, as new snapshots."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bizpanel.functions import fixed_values as fixed
from bizpanel.operators.aggregates import latest
from bizpanel.operators.filters import search
from bizpanel.operators.numbering import number_rows
from bizpanel.sources import versions

REPEATED_KEY = "the batch names this key more than once"


def safety_stock_checks() -> dict[str, Column]:
    """Reason text by failing test, in the order they are reported."""
    return {
        "item code is required": F.coalesce(F.col("item_code"), F.lit("")) == "",
        "quantity must be 0 or greater": F.coalesce(F.col("safety_stock"), F.lit(0)) < 0,
    }


def split_valid(
    changes: DataFrame, checks: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with the first ``reason``."""
    reason = F.lit(None).cast("string")
    for text, failed in reversed(list(checks.items())):
        reason = F.when(failed, F.lit(text)).otherwise(reason)
    judged = changes.withColumn("reason", reason)
    valid = judged.filter(F.col("reason").isNull()).drop("reason")
    return valid, judged.filter(F.col("reason").isNotNull())


def upsert(
    base: DataFrame,
    changes: DataFrame,
    key: str,
    checks: Mapping[str, Column] | None = None,
    sequence: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New snapshot and rejected rows.

    Valid changes replace the base row with the same key or are added. A change whose key is 0
    or NULL is a new record and gets the next free key. Where a batch may name a key twice,
    ``sequence`` orders its changes and the last one counts; without it all of them are rejected.
    """
    valid, rejected = split_valid(changes, checks or {})
    valid = valid.withColumn("is_new", F.coalesce(F.col(key) == 0, F.lit(True)))
    added, valid = valid.filter("is_new").drop("is_new"), valid.filter("NOT is_new").drop("is_new")
    if sequence:
        rest = [c for c in valid.columns if c != key]
        valid = latest(valid, [key], [sequence], rest).drop(sequence)
    else:
        twice = valid.groupBy(key).count().filter("count > 1").select(key)
        again = valid.join(twice, key, "left_semi").withColumn("reason", F.lit(REPEATED_KEY))
        rejected = rejected.unionByName(again)
        valid = valid.join(twice, key, "left_anti")
    valid = valid.select(*base.columns)
    kept = base.join(valid.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(valid).unionByName(_numbered(base, valid, added, key)), rejected


def _numbered(base: DataFrame, valid: DataFrame, added: DataFrame, key: str) -> DataFrame:
    """New records of a batch with the keys that follow the largest one in use."""
    if added.isEmpty():
        return added.select(*base.columns)
    used = base.select(key).union(valid.select(key)).agg(F.max(key).alias("used"))
    rest = [c for c in base.columns if c != key]
    placed = number_rows(added, rest, "new_place")
    new_key = (F.coalesce(used.scalar(), F.lit(0)) + F.col("new_place")).cast(base.schema[key].dataType)
    return placed.withColumn(key, new_key).select(*base.columns)


def save(
    spark: SparkSession,
    path: str,
    change: Callable[[DataFrame], DataFrame],
    schema: str | StructType | None = None,
) -> versions.Version:
    """Replace a stored master table by what ``change`` makes of it.

    The new snapshot is written beside the old one and then takes its place in one step, so a table may be written
    from itself, and a change that fails leaves it as it was. If somebody else has saved the table in the meantime,
    ``WriteConflict`` is raised and theirs stays.
    """
    before = versions.current(spark, path)
    changed = change(versions.read(spark, path, schema))
    return versions.publish(changed, path, made_from=before.number if before else 0)


def save_upsert(
    changes: DataFrame,
    path: str,
    key: str,
    checks: Mapping[str, Column] | None = None,
    sequence: str | None = None,
    schema: str | StructType | None = None,
) -> DataFrame:
    """``upsert`` on a stored table; the rejected rows."""
    rejected = []

    def change(base: DataFrame) -> DataFrame:
        saved, refused = upsert(base, changes, key, checks, sequence)
        rejected.append(refused)
        return saved

    save(changes.sparkSession, path, change, schema)
    return rejected[0]


def save_delete(
    ids: DataFrame, path: str, key: str, schema: str | StructType | None = None
) -> versions.Version:
    """``delete`` on a stored table."""
    return save(ids.sparkSession, path, lambda base: delete(base, ids, key), schema)


def delete(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """New snapshot without the rows whose key is in ``ids``."""
    return base.join(ids.select(key), key, "left_anti").select(*base.columns)


def search_items(items: DataFrame, pattern: str, columns: Sequence[str]) -> DataFrame:
    """Items whose code or description contains the pattern.

    Patterns shorter than two characters find nothing.
    """
    if len(pattern) < fixed.MIN_SEARCH_LENGTH:
        return items.limit(0)
    return search(items, pattern, columns)
