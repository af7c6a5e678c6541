"""Merkle manifest of a dataset: trees per group, one tree over the groups, and a proof for each row.

Leaves are numbered within their group in the order of the ids, so that blocks of ``BLOCK`` consecutive leaves are
aligned subtrees. Each block is hashed up to its subtree's root on its own. The roots then go through a butterfly
exchange: in round r those blocks meet whose numbers differ in digit r (to the base of the fanout) alone, swap the
roots of the subtrees that they stand for, and each hashes the common ancestor for itself. After the last round every
block holds the tree's root and the siblings along its own path, and nothing has to be sent down again. Where the
last subtree is not full, its last block stands in for the missing ones, so that each block meets a partner. The
tree over the groups' roots goes through the same exchange.

A node is the lowercase hex SHA-256 of its children's hex digests, in order; the last run of a level may be shorter,
down to one node. A tree of one leaf is that leaf.

Defined results: nulls have a place in every hash (``-``), and a null group is a group of its own, before the others.
Null ids come first in their group; rows with equal ids go by their leaf's digest, and rows that are repeated whole
are leaves of their own, any order of which gives the same digests. Empty texts have size 0. Columns that are not
named are left out. An empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizpanel.llm.scratch import small, store

FANOUT = 2
#: Levels of a block's subtree: a block has fanout ** LEVELS leaves.
LEVELS = 10
#: Rounds of the exchange after which its rows are written.
ROUNDS_STORED = 8
_STEPS = "array<struct<before: string, after: string>>"
_IN_PARTITION = (1 << 33) - 1


def field(value: Column) -> Column:
    """A value with its size in UTF-8 bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parents(nodes: Sequence[str], fanout: int) -> list[str]:
    """The next level."""
    return [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def subtree(leaves: Sequence[str], fanout: int, levels: int | None) -> list[list[str]]:
    """All levels of a block; without ``levels`` the block is a whole tree, and one node ends it."""
    found = [list(leaves)]
    while len(found) <= levels if levels is not None else len(found[-1]) > 1:
        found.append(parents(found[-1], fanout))
    return found


def siblings(level: Sequence[str], place: int, fanout: int) -> tuple[str, str]:
    """What stands before and after a node in its run."""
    run = place - place % fanout
    return "".join(level[run:place]), "".join(level[place + 1 : run + fanout])


def fold(node: str, steps: Sequence[tuple[str, str]]) -> str:
    """The root that a node leads to."""
    for before, after in steps:
        node = digest(before + node + after)
    return node


def number_rows(frame: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds ``place``, 0, 1, ... within each tree, and ``n_leaves`` of the tree.

    Rows are sorted over all partitions; each partition counts its rows of each tree, and the
    counts before it are added. Equal rows may be divided between partitions.
    """
    spread = frame.withColumn("tie", F.monotonically_increasing_id())
    keys = [tree, *order, "tie"]
    ordered = store(
        spread.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
        .drop("tie")
    )
    # a row for each partition of each tree
    spans = ordered.groupBy(tree, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(tree)
    spans = spans.select(
        F.col(tree).alias("span_tree"),
        F.col("part").alias("span_part"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("n_leaves"),
    )
    here = F.col(tree).eqNullSafe(F.col("span_tree")) & (F.col("part") == F.col("span_part"))
    return (
        ordered.join(spans, here)
        .withColumn("place", F.col("at") + F.col("shift"))
        .drop("part", "at", "shift", "span_tree", "span_part")
    )


def butterfly(nodes: DataFrame, tree: str, fanout: int) -> DataFrame:
    """Gives each node its tree's root and the siblings on its path: ``tree``, ``place``, ``root``, ``steps``.

    ``nodes`` has the tree, ``place`` from 0, ``width`` (nodes of the tree) and ``node``.
    """
    widest = nodes.agg(F.max("width")).first()[0] or 1
    rounds = 0
    while fanout**rounds < widest:
        rounds += 1
    full = F.coalesce(
        *(F.when(F.col("width") <= fanout**r, F.lit(fanout**r)) for r in range(rounds + 1))
    )
    last = F.col("place") == F.col("width") - 1
    # the last node also stands in for those that its tree lacks; it has nothing to show for them
    stands_for = F.when(last, F.sequence("place", full.cast("long") - 1)).otherwise(F.array("place"))
    state = nodes.select(tree, "width", "node", F.col("place").alias("own"), F.explode(stands_for).alias("place"))
    state = state.select(
        tree,
        "width",
        "place",
        F.when(F.col("own") == F.col("place"), F.col("node")).alias("node"),
        F.lit(None).cast(_STEPS).alias("steps"),
    )
    for r in range(rounds):
        below = F.lit(fanout**r)
        low, high = F.col("place") % below, F.expr(f"place div {fanout ** (r + 1)}")
        digit = F.expr(f"place div {fanout**r}") % fanout
        group = Window.partitionBy(tree, "high", "low")
        met = state.withColumns({"low": low, "high": high, "digit": digit}).withColumn(
            "met", F.array_sort(F.collect_list(F.struct("digit", "node")).over(group))
        )

        def joined(keep=lambda x: F.lit(True)) -> Column:
            nodes_met = F.filter("met", lambda x: x["node"].isNotNull() & keep(x))
            return F.array_join(F.transform(nodes_met, lambda x: x["node"]), "")

        own = F.col("digit")
        step = F.struct(
            joined(lambda x: x["digit"] < own).alias("before"),
            joined(lambda x: x["digit"] > own).alias("after"),
        )
        grows = F.col("width") > fanout**r
        parent = F.when(joined() != "", F.sha2(joined().cast("binary"), 256))
        steps = F.coalesce("steps", F.array().cast(_STEPS))
        state = met.select(
            tree,
            "width",
            "place",
            F.when(grows, parent).otherwise(F.col("node")).alias("node"),
            F.when(grows, F.concat(steps, F.array(step))).otherwise(steps).alias("steps"),
        )
        if r % ROUNDS_STORED == ROUNDS_STORED - 1:
            state = store(state)
    return state.where(F.col("place") < F.col("width")).select(
        tree, "place", F.col("node").alias("root"), F.coalesce("steps", F.array().cast(_STEPS)).alias("steps")
    )


def build_manifest(
    leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS
) -> DataFrame:
    """The proof of each leaf, and what its claimed digest leads to.

    ``leaves`` has ``tree`` (the group), ``id``, ``leaf`` and ``claimed`` (a digest to be
    checked against the manifest). Returns tree, id, leaf, subroot, root, ``proof_sha256`` (the digest
    of all siblings from the leaf to the root), ``folded_root`` and ``verified``.
    """
    block_leaves = fanout**levels
    placed = number_rows(leaves.select("tree", "id", "leaf", "claimed"), "tree", ["id", "leaf"])
    placed = store(placed.withColumn("block", F.expr(f"place div {block_leaves}")))

    def levels_of(table: pa.Table) -> tuple[pa.Table, list[list[str]]]:
        table = table.sort_by("place")
        alone = table.column("n_leaves")[0].as_py() <= block_leaves
        return table, subtree(table.column("leaf").to_pylist(), fanout, None if alone else levels)

    def root_of(table: pa.Table) -> pa.Table:
        table, found = levels_of(table)
        first = table.slice(0, 1)
        return pa.table(
            {
                "tree": first.column("tree"),
                "place": first.column("block"),
                "width": pa.array([-(-first.column("n_leaves")[0].as_py() // block_leaves)], pa.int64()),
                "node": pa.array([found[-1][0]], pa.string()),
            }
        )

    kind = leaves.schema["tree"].dataType.simpleString()
    blocks = store(
        placed.select("tree", "block", "place", "n_leaves", "leaf")
        .groupBy("tree", "block")
        .applyInArrow(root_of, f"tree {kind}, place long, width long, node string")
    )
    upper = store(butterfly(blocks, "tree", fanout))
    subroots = upper.where(F.col("place") == 0).select("tree", F.col("root").alias("node"), F.lit(0).alias("forest"))
    numbered = store(number_rows(subroots, "forest", ["tree"]).withColumnRenamed("n_leaves", "width"))
    top = butterfly(numbered, "forest", fanout)
    top = store(
        numbered.select("tree", "place", F.col("node").alias("subroot"))
        .join(top, "place")
        .select(F.col("tree").alias("top_tree"), "subroot", F.col("root").alias("top_root"), F.col("steps").alias("top_steps"))
    )
    paths = upper.join(small(top, 4096), F.col("tree").eqNullSafe(F.col("top_tree"))).select(
        "tree",
        F.col("place").alias("block"),
        "subroot",
        F.col("top_root").alias("root"),
        F.concat("steps", "top_steps").alias("steps"),
    )

    def prove(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows, found = levels_of(rows)
        own = path.slice(0, 1).to_pylist()[0]
        above = [(s["before"], s["after"]) for s in own["steps"]]
        rest = "".join(before + after for before, after in above)
        roots = {found[-1][0]: fold(found[-1][0], above)}
        proofs, folded = [], []
        for place, claimed in enumerate(rows.column("claimed").to_pylist()):
            steps = []
            for level in found[:-1]:
                steps.append(siblings(level, place, fanout))
                place //= fanout
            node = fold(claimed, steps)
            if node not in roots:
                roots[node] = fold(node, above)
            folded.append(roots[node])
            proofs.append(digest("".join(before + after for before, after in steps) + rest))
        count = len(proofs)
        return pa.table(
            {
                "tree": rows.column("tree"),
                "id": rows.column("id"),
                "leaf": rows.column("leaf"),
                "subroot": pa.array([own["subroot"]] * count, pa.string()),
                "root": pa.array([own["root"]] * count, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == own["root"] for f in folded], pa.bool_()),
            }
        )

    id_kind = leaves.schema["id"].dataType.simpleString()
    out = (
        f"tree {kind}, id {id_kind}, leaf string, subroot string, root string, "
        "proof_sha256 string, folded_root string, verified boolean"
    )
    return placed.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(prove, out)


def tampered(id_column: Column) -> Column:
    """Rows that a manifest check alters, by a hash of their id; rows without id are not altered."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def document_leaves(documents: DataFrame) -> DataFrame:
    """Leaves of documents by language, and the leaves that altered sizes would claim."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    altered = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]
    rows = documents.select(
        F.col("lang").alias("tree"),
        F.col("doc_id").alias("id"),
        leaf_hash([F.col(c) for c in names]).alias("leaf"),
        F.when(tampered(F.col("doc_id")), leaf_hash(altered)).alias("claimed"),
    )
    return store(rows.withColumn("claimed", F.coalesce("claimed", "leaf")))
