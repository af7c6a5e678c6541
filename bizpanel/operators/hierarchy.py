"""Manager trees and manager-grouped order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.operators.lineage import cut

PATH_SEPARATOR = "/"
# Below every printable character, so that a shorter name sorts before its extensions.
SORT_SEPARATOR = "\u0001"
NAME_END = "\u0002"
ID_WIDTH = 20


def manager_first(is_manager: Column) -> Column:
    """0 for managers, 1 for all others."""
    return F.when(is_manager == 1, F.lit(0)).otherwise(F.lit(1))


def manager_order() -> list[Column]:
    """Manager id, then the manager, then the name without case, then the id."""
    return [
        F.coalesce(F.col("manager_id"), F.lit(0)).asc(),
        manager_first(F.col("is_manager")).asc(),
        F.lower(F.coalesce(F.col("full_name"), F.lit(""))).asc(),
        F.col("employee_id").asc(),
    ]


def manager_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*manager_order())


def _sort_key() -> Column:
    """Sibling order as text: managers first, then the lower-case name, then the id."""
    return F.concat(
        manager_first(F.col("is_manager")).cast("string"),
        F.lower(F.coalesce(F.col("full_name"), F.lit(""))),
        F.lit(NAME_END),
        F.lpad(F.col("employee_id").cast("string"), ID_WIDTH, "0"),
    )


def org_tree(employees: DataFrame) -> DataFrame:
    """Every employee with root, level, id path and sort path.

    Roots have no manager, manager 0, or a manager outside the given set. Everybody holds the
    stretch of the path that ends with them, and ``above``, who stands over its head. Each round
    puts the stretch of ``above`` in front, so that stretches double: the rounds grow with the
    logarithm of the height, and each is one join whose result is written to the checkpoint
    folder. Nodes on a cycle or below one never reach a root and are left out.
    ``employee_id`` must be unique.
    """
    nodes = employees.select(
        "employee_id", F.nullif(F.col("manager_id"), F.lit(0)).alias("parent_id"), _sort_key().alias("sort_key")
    )
    known = nodes.select(F.col("employee_id").alias("above"))
    state = cut(
        nodes.join(known, F.col("parent_id") == F.col("above"), "left").select(
            "employee_id",
            "above",
            F.col("employee_id").alias("root_id"),
            F.lit(0).alias("level"),
            F.col("employee_id").cast("string").alias("path"),
            F.col("sort_key").alias("sort_path"),
        )
    )
    complete = F.col("above").isNull()
    done, rest = [state.filter(complete)], state.filter(~complete)
    longest, rows = 1, state.count()
    # a stretch as long as there are nodes goes round a cycle
    while longest < rows and not rest.isEmpty():
        over = reduce(DataFrame.unionByName, [*done, rest])
        over = over.select(*[F.col(c).alias(f"over_{c}") for c in over.columns])
        joined = rest.join(over, F.col("above") == F.col("over_employee_id")).select(
            "employee_id",
            F.col("over_above").alias("above"),
            F.col("over_root_id").alias("root_id"),
            (F.col("level") + F.col("over_level") + 1).alias("level"),
            F.concat_ws(PATH_SEPARATOR, "over_path", "path").alias("path"),
            F.concat_ws(SORT_SEPARATOR, "over_sort_path", "sort_path").alias("sort_path"),
        )
        state = cut(joined)
        done.append(state.filter(complete))
        rest = state.filter(~complete)
        longest *= 2
    return reduce(DataFrame.unionByName, done).drop("above")
