"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.scratch import store


def _flatten(parent: DataFrame) -> DataFrame:
    """Follows parents up to nodes that are their own; the path halves in each round."""
    while True:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = store(parent.join(above, "parent").select("node", "parent", "above"))
        parent = jumped.select("node", F.col("above").alias("parent"))
        if jumped.where(F.col("parent") != F.col("above")).isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of the edges (a, b) reaches: node, component.

    Each round every node takes its smallest neighbour as parent, trees become stars, and edges
    move to their roots. The roots of a component at least halve, so that the rounds grow with the
    logarithm of the nodes. Edges with a null end and loops are left out; without edges there are no rows.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    edges = store(edges.where(whole & (F.col("a") != F.col("b"))).select(a, b).distinct())
    known = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        parent = both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent"))
        root = _flatten(store(parent))
        if known is None:
            known = root.toDF("node", "component")
        else:
            up = root.toDF("component", "top")
            known = store(
                known.join(up, "component", "left").select(
                    "node", F.coalesce("top", "component").alias("component")
                )
            )
        moved = edges.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b")
        edges = store(
            moved.where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    if known is None:
        return edges.toDF("node", "component")
    return known
