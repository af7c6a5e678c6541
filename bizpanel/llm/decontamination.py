"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds a posting (row, position) for each training word that the benchmark uses, and is
written once. Its counts tell each test window's rarest terms. The lists of these terms are shifted by
the term's offset in its item, so that an item's place in a row is one number, and intersected: a
place goes on if two of them meet there. What is left is intersected with the lists of all terms of
the item. Where as many neighbouring terms meet as a window has words, the phrase stands exactly.
Proximity matches are the shortest spans that hold an item's rarest terms.

Words: A-Z as a-z, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Defined results: null and empty texts have no words and no hits. Null and repeated ids of documents
are rows of their own. Items without words have no window; items without id count for hits and not
among items; equal item ids count once. Extra columns are dropped. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizpanel.llm.scratch import small, store

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a test window; a shorter item is one window.
WINDOW_WORDS = 10
#: Rarest terms of each window whose lists are intersected first.
RAREST = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as an array."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def item_terms(
    items: DataFrame, size: int = WINDOW_WORDS, id_column: str = "item_id", text_column: str = "text"
) -> DataFrame:
    """A row for each word of each item: item, item_id, len (words of its windows), offset, term.

    To be stored, as the item numbers hold for one run only.
    """
    numbered = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col(id_column).alias("item_id"),
        words(F.col(text_column)).alias("w"),
    )
    return numbered.select(
        "item",
        "item_id",
        F.least(F.size("w"), F.lit(size)).alias("len"),
        F.posexplode("w").alias("offset", "term"),
    )


def vocabulary_of(terms: DataFrame) -> DataFrame:
    """The different terms, numbered; to be stored, as the numbers hold for one run only."""
    return terms.select("term").distinct().withColumn("number", F.monotonically_increasing_id())


def build_index(
    documents: DataFrame,
    vocabulary: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Postings of the vocabulary (term, number): row, id, number, pos.

    The posting of number -1 stands behind a row's last word: every row has one, it alone has the id,
    and its position is the row's number of words.
    """
    numbered = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
        F.array_append(words(F.col(text_column)), F.lit("")).alias("terms"),
    )
    rows = numbered.select("row", "id", F.posexplode("terms").alias("pos", "term"))
    ends = vocabulary.sparkSession.range(1).select(
        F.lit("").alias("term"), F.lit(-1).cast("long").alias("number")
    )
    known = vocabulary.select("term", "number").unionByName(ends)
    size = known.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    known = small(known, 64, size[0] + size[1] // 64)
    id_at_end = F.when(F.col("number") == -1, F.col("id")).alias("id")
    return store(rows.join(known, "term").select("row", id_at_end, "number", "pos"))


def rarest_offsets(terms: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """The offsets of each item that are among the rarest of some window: item, len, offset, number.

    ``counts`` has the postings of each number; a term without postings is the rarest of all.
    """
    counted = terms.join(counts, "number", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    words_of = F.count("*").over(Window.partitionBy("item"))
    placed = counted.withColumn("words", words_of)
    begins = F.sequence(
        F.greatest(F.col("offset") - F.col("len") + 1, F.lit(0)),
        F.least(F.col("offset").cast("long"), F.col("words") - F.col("len")).cast("int"),
    )
    order = Window.partitionBy("item", "begin").orderBy("n", "offset")
    return (
        placed.withColumn("begin", F.explode(begins))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rarest)
        .select("item", "len", "offset", "number")
        .distinct()
    )


def phrase_matches(index: DataFrame, terms: DataFrame, rarest: int = RAREST) -> DataFrame:
    """Runs of words in which every window of an item stands: row, item, start, end.

    ``terms`` has item, len, offset and number, ``index`` the postings; both have been stored.
    """
    counts = index.where(F.col("number") >= 0).groupBy("number").agg(F.count("*").alias("n"))
    first = store(rarest_offsets(terms, counts, rarest))
    shifted = index.where(F.col("number") >= 0).join(small(first, 48), "number").select(
        "item", "len", "row", (F.col("pos") - F.col("offset")).alias("shift")
    )
    # an offset meets a shift of a row once
    places = store(
        shifted.groupBy("item", "len", "row", "shift")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= F.least(F.col("len"), F.lit(rarest)))
        .select("item", "len", "row", "shift")
    )
    of_item = small(terms.select("item", "offset", "number"), 32)
    wanted = places.join(of_item, "item").select(
        "item", "len", "row", "shift", "offset", "number", (F.col("shift") + F.col("offset")).alias("pos")
    )
    longest = terms.groupBy("item").agg((F.max("offset") + 1).alias("words"))
    reach = store(
        places.join(small(longest, 16), "item")
        .groupBy("row")
        .agg(F.min("shift").alias("lo"), F.max(F.col("shift") + F.col("words")).alias("hi"))
    )
    near = index.join(small(reach, 24), "row").where(
        (F.col("number") >= 0) & (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))
    )
    met = wanted.join(near.select("row", "number", "pos"), ["row", "number", "pos"])
    place = Window.partitionBy("item", "row", "shift").orderBy("offset")
    runs = met.withColumn("run", F.col("offset") - F.row_number().over(place))
    return (
        runs.groupBy("item", "row", "shift", "len", "run")
        .agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
        .where(F.col("end") - F.col("start") >= F.col("len"))
        .select("row", "item", "start", "end")
    )


def proximity_matches(
    index: DataFrame, terms: DataFrame, span: int = 40, rarest: int = RAREST
) -> DataFrame:
    """Shortest spans of at most ``span`` words with an item's rarest terms: row, item, start, end.

    Items need ``rarest`` different terms that the index has.
    """
    terms = terms.select("item", "number").distinct()
    counts = index.where(F.col("number") >= 0).groupBy("number").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item").orderBy("n", "number")
    ranked = terms.join(counts, "number").withColumn("rank", F.row_number().over(order))
    ranked = store(ranked.where(F.col("rank") <= rarest).select("item", "number", "rank"))
    places = index.join(small(ranked, 40), "number").select("row", "item", "rank", "pos")
    so_far = (
        Window.partitionBy("row", "item").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    last = [
        F.max(F.when(F.col("rank") == r, F.col("pos"))).over(so_far) for r in range(1, rarest + 1)
    ]
    missing = F.lit(False)
    for place in last:
        missing = missing | place.isNull()
    begin = F.least(*last) if rarest > 1 else last[0]
    spans = places.select(
        "row", "item", F.when(~missing, begin).alias("start"), (F.col("pos") + 1).alias("end")
    )
    spans = spans.where((F.col("end") - F.col("start")) <= span)
    return spans.groupBy("row", "item").agg(
        F.min_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), "start")).alias("s")
    ).select("row", "item", "s.start", "s.end")


def decontaminate(
    documents: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = WINDOW_WORDS,
) -> DataFrame:
    """For each document: words, words inside a window's place, and the items whose windows occur."""
    terms = store(item_terms(items, size))
    vocabulary = store(vocabulary_of(terms))
    index = build_index(documents, vocabulary, id_column, text_column)
    numbered = store(terms.join(vocabulary, "term").drop("term"))
    found = store(phrase_matches(index, numbered.drop("item_id")))
    earlier = (
        Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = found.select("row", "start", "end").distinct()
    open_from = F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0)))
    hit = (
        spans.withColumn("new", F.greatest(F.col("end") - open_from, F.lit(0)))
        .groupBy("row")
        .agg(F.sum("new").alias("n_hit"))
    )
    named = numbered.select("item", "item_id").distinct()
    listed = (
        found.join(small(named, 24), "item")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    rows = index.where(F.col("number") == -1).select("row", "id", F.col("pos").alias("n_words"))
    joined = rows.join(hit.join(listed, "row"), "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_column),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
