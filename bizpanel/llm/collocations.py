"""Phrases whose words belong together, mined by relations of occurrences (SETM).

The occurrences of phrases of one length are a relation of places, sorted and stored, in one row for each chunk of
texts. Each round counts the phrases over all chunks (each chunk deals its distinct ones to shards by value),
keeps the occurrences of the frequent ones (a semi-join with the shards' answer), and merge-joins them with
themselves at the next place of the same piece: two phrases that overlap in all but their outer words make one that
is a word longer. What is stored are the occurrences of frequent phrases; the join is made once to count the longer
ones, and again when the answer is there. Words are numbered over a chunk with a gap behind each piece, so that neighbours in the
relation are neighbours in a piece.

A phrase is known by a 64-bit value made of its language and its words; two with one value are not told apart. Its
text comes from one chunk that holds it, named by the shard. Languages are counted apart; a null language is
``und`` and joins a language of that name.

Scores are exact: decimals of 38 digits hold all products. The figure of a cut is the floor of 1000 * a * n / (l * r).

Defined results: null and empty texts hold nothing. Repeated rows and rows without id count like others; extra columns are
dropped. Ties go by the phrase's bytes. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizpanel.llm.dealing import (
    chunks,
    distinct,
    get,
    get_keys,
    joined,
    pieces,
    plan,
    put,
    put_keys,
    starts,
    summed,
)
from bizpanel.llm.scratch import drop, store
from bizpanel.llm.words import PIECE_ENDS, PIECE_WORDS_LOWER, U64, Words, mix, split_words, text_buffer

UNKNOWN = "und"
#: Parts in which the first relation, by far the largest, is read; what is done with goes before the next part.
TURNS = 4
_STEP = U64(0xA0761D6478BD642F)
_COLUMNS = (
    ("kind", "string", pa.string()),
    ("turn", "int", pa.int32()),
    ("shard", "int", pa.int32()),
    ("chunk", "long", pa.int64()),
    ("keys", "binary", pa.binary()),
    ("counts", "binary", pa.binary()),
    ("places", "binary", pa.binary()),
    ("codes", "binary", pa.binary()),
    ("names", "binary", pa.binary()),
    ("langs", "array<string>", pa.list_(pa.string())),
    ("lang_of", "binary", pa.binary()),
    ("lang", "string", pa.string()),
    ("phrase", "string", pa.string()),
    ("a", "long", pa.int64()),
)
_SCHEMA = ", ".join(f"{n} {kind}" for n, kind, _ in _COLUMNS)
_ARROW = pa.schema([(n, kind) for n, _, kind in _COLUMNS])


def language_value(lang: str) -> int:
    """The same in every task."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big")


def longer_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Values of the phrases that two overlapping ones make."""
    return mix(left * _STEP + right)


def word_places(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The words of all texts, and their places, with a gap between two pieces or texts."""
    words = split_words(texts, PIECE_WORDS_LOWER)
    raw, _ = text_buffer(texts)
    ends = np.zeros(256, bool)
    ends[list(PIECE_ENDS)] = True
    piece = np.concatenate(([0], np.cumsum(ends[raw])))[words.start]
    text = words.text_of
    gap = np.zeros(len(piece), np.int64)
    gap[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    return words, np.arange(len(piece)) + np.cumsum(gap)


def _dealt(chunk: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[dict]:
    cut = starts(keys, shards)
    for s in np.flatnonzero(np.diff(cut)):
        part = slice(cut[s], cut[s + 1])
        yield {
            "kind": "deal",
            "shard": int(s),
            "chunk": chunk,
            "keys": put_keys(keys[part]),
            "counts": put(counts[part]),
        }


def first_relation(chunk: int, texts: pa.Array, langs: list[str], shards: int) -> Iterator[dict]:
    """A chunk's words: the relation, its counts for the shards, and the words of each language."""
    kinds = sorted(set(langs))
    number = {lang: i for i, lang in enumerate(kinds)}
    salt = mix(np.array([language_value(k) for k in kinds], U64))
    values, lang, places, parts, after = [], [], [], [], 0
    for at, part in pieces(texts):
        words, place = word_places(part)
        own = np.array([number[x] for x in langs[at : at + len(part)]], np.int64)[words.text_of]
        values.append(mix(words.values() + salt[own]))
        lang.append(own)
        places.append(place + after)
        parts.append(words)
        after += int(place[-1]) + 2 if len(place) else 0
    values, lang = joined(values, U64), joined(lang, np.int64)
    if not len(values):
        return
    keys, codes, counts = distinct(values)
    last = np.zeros(len(keys), np.int64)
    last[codes] = np.arange(len(codes))
    # words by the part that holds them
    before = np.concatenate(([0], np.cumsum([len(w.start) for w in parts])))
    part_of = np.searchsorted(before, last, "right") - 1
    yield {
        "kind": "relation",
        "turn": chunk % TURNS,
        "chunk": chunk,
        "keys": put_keys(keys),
        "places": put_keys(joined(places, np.int64)),
        "codes": put(codes),
        "names": put_names([parts[p].word(i - before[p]).decode() for p, i in zip(part_of, last)]),
        "langs": kinds,
        "lang_of": put(lang[last]),
    }
    yield from _dealt(chunk, keys, counts, shards)
    for i, n in enumerate(np.bincount(lang, minlength=len(kinds))):
        yield {"kind": "size", "lang": kinds[i], "a": int(n)}


def frequent_of(table: pa.Table, least: int) -> Iterator[dict]:
    """Tells each chunk which of its phrases are frequent, and which of these it is to name."""
    lists = [
        (r["chunk"], get_keys(r["keys"]), get(r["counts"])) for b in table.to_batches() for r in b.to_pylist()
    ]
    lists.sort(key=lambda x: x[0])
    keys, counts = summed(joined([k for _, k, _ in lists], U64), joined([c for *_, c in lists], np.int64))
    keys, counts = keys[counts >= least], counts[counts >= least]
    named = np.zeros(len(keys), bool)
    for chunk, own, _ in lists:
        place = np.searchsorted(keys, own)
        held = place < len(keys)
        held[held] = keys[place[held]] == own[held]
        place = place[held]
        if len(place):
            fresh = place[~named[place]]
            named[fresh] = True
            yield {
                "kind": "answer",
                "chunk": chunk,
                "keys": put_keys(keys[place]),
                # 0 for phrases that another chunk names
                "counts": put(np.where(np.isin(place, fresh, assume_unique=True), counts[place], 0)),
            }


@dataclass(frozen=True)
class Relation:
    """A chunk's phrases of one length, ascending by value, and where they occur.

    ``codes`` has the phrase at each of the ``places``.
    """

    keys: np.ndarray
    names: list[str]
    lang_of: np.ndarray
    langs: list[str]
    places: np.ndarray
    codes: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Relation:
        return cls(
            get_keys(row["keys"]),
            get_names(row["names"]),
            get(row["lang_of"]),
            row["langs"],
            get_keys(row["places"]).astype(np.int64),
            get(row["codes"]),
        )

    def row(self, chunk: int) -> dict:
        return {
            "kind": "relation",
            "chunk": chunk,
            "keys": put_keys(self.keys),
            "names": put_names(self.names),
            "lang_of": put(self.lang_of),
            "langs": self.langs,
            "places": put_keys(self.places),
            "codes": put(self.codes),
        }

    def kept(self, wanted: np.ndarray) -> Relation:
        """The relation of some of its phrases: a semi-join."""
        chosen = np.flatnonzero(wanted)
        held = wanted[self.codes]
        names = [self.names[i] for i in chosen]
        codes = np.searchsorted(chosen, self.codes[held])
        return Relation(self.keys[chosen], names, self.lang_of[chosen], self.langs, self.places[held], codes)

    def longer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of one more word, by a merge join with the next place.

        Their values in order, for each its two phrases, how often it occurs, and which phrase begins at each place
        where one does; the last has -1 elsewhere.
        """
        first = np.flatnonzero(self.places[1:] == self.places[:-1] + 1)
        pair, at, times = distinct(self.codes[first] * np.int64(len(self.keys)) + self.codes[first + 1])
        left, right = np.divmod(pair, max(len(self.keys), 1))
        keys = longer_keys(self.keys[left], self.keys[right])
        order = np.argsort(keys)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begins = np.full(len(self.places), -1)
        begins[first] = rank[at]
        return keys[order], left[order], right[order], times[order], begins

    def extended(self, answered: np.ndarray) -> tuple[Relation, np.ndarray]:
        """The relation of those longer phrases that are among the answered ones, and where each stands there."""
        keys, left, right, _, begins = self.longer()
        place = np.searchsorted(answered, keys)
        wanted = place < len(answered)
        wanted[wanted] = answered[place[wanted]] == keys[wanted]
        held = begins >= 0
        names = [
            f"{self.names[i]} {self.names[j].rsplit(' ', 1)[-1]}" if w else ""
            for i, j, w in zip(left, right, wanted)
        ]
        whole = Relation(keys, names, self.lang_of[left], self.langs, self.places[held], begins[held])
        return whole.kept(wanted), place[wanted]


def put_names(names: list[str]) -> bytes:
    """Phrases as one block; a line feed is in none of them."""
    return zstandard.ZstdCompressor(level=1).compress("\n".join(names).encode())


def get_names(data: bytes) -> list[str]:
    """The phrases of ``put_names``, which had one at least."""
    return zstandard.ZstdDecompressor().decompress(data).decode().split("\n")


def narrowed(row: dict, answers: pa.Table, size: int, longest: bool, shards: int) -> Iterator[dict]:
    """Keeps the frequent phrases of a length, names those that fall to this chunk, and counts longer ones.

    The row holds phrases of one word less, whose longer ones were counted; words come as they are.
    """
    chunk, relation = row["chunk"], Relation.of(row)
    parts = answers.to_pylist()
    answered, named = joined([get_keys(r["keys"]) for r in parts], U64), joined([get(r["counts"]) for r in parts], np.int64)
    order = np.argsort(answered)
    answered, named = answered[order], named[order]
    if size == 1:
        place = np.searchsorted(answered, relation.keys)
        wanted = place < len(answered)
        wanted[wanted] = answered[place[wanted]] == relation.keys[wanted]
        relation, place = relation.kept(wanted), place[wanted]
    else:
        relation, place = relation.extended(answered)
    count = named[place]
    for i in np.flatnonzero(count):
        yield {"kind": "phrase", "lang": relation.langs[relation.lang_of[i]], "phrase": relation.names[i], "a": int(count[i])}
    if longest or not len(relation.keys):
        return
    keys, _, _, times, _ = relation.longer()
    if len(keys):
        yield relation.row(chunk)
        yield from _dealt(chunk, keys, times, shards)


def _table(rows: Iterator[dict]) -> pa.Table:
    return pa.Table.from_pylist(list(rows), _ARROW)


def _narrow(size: int, longest: bool, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def narrow(relation: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [r for b in relation.to_batches() for r in b.to_pylist()]
        return _table(x for r in rows for x in narrowed(r, answers, size, longest, shards))

    return narrow


def count_phrases(
    documents: DataFrame, least: int, words: int, text_column: str = "text", lang_column: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 1 to ``words`` words (lang, phrase, size, a), and the words of each language (lang, n)."""
    texts = documents.select(
        F.col(text_column).alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang")
    )
    most, shards = plan(texts, "text")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in chunks(batches, "text", most):
            found = first_relation(number, rows.column("text"), rows.column("lang").to_pylist(), shards)
            yield from _table(found).to_batches()

    def count(table: pa.Table) -> pa.Table:
        return _table(frequent_of(table, least))

    of = F.col("kind")
    at = store(texts.mapInArrow(begin, _SCHEMA), "kind", "turn")
    sizes = store(at.where(of == "size").groupBy("lang").agg(F.sum("a").alias("n")))
    found = []
    before = [at]
    for size in range(1, words + 1):
        narrow = _narrow(size, size == words, shards)
        every = reduce(DataFrame.unionByName, before)
        dealt = every.where(of == "deal").select("shard", "chunk", "keys", "counts")
        answers = store(dealt.groupBy("shard").applyInArrow(count, _SCHEMA)).select("chunk", "keys", "counts")
        for table in before:
            drop(table, "kind=deal")
        after = []
        for turn in range(TURNS) if size == 1 else [None]:
            relation, own = every.where(of == "relation"), answers
            if turn is not None:
                relation, own = relation.where(F.col("turn") == turn), own.where(F.col("chunk") % TURNS == turn)
            joined_up = relation.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(narrow, _SCHEMA)
            after.append(store(joined_up, "kind"))
            if turn is not None:
                drop(at, f"kind=relation/turn={turn}")
        named = reduce(DataFrame.unionByName, after).where(of == "phrase")
        found.append(store(named.select("lang", "phrase", F.lit(size).alias("size"), "a")))
        for table in (*before, answers):
            drop(table)
        before = after
    for table in before:
        drop(table)
    return reduce(DataFrame.unionByName, found), sizes


def _part(first: str, length: str) -> Column:
    return F.expr(f"array_join(slice(parts, {first}, {length}), ' ')")


def mine_collocations(
    documents: DataFrame,
    least: int = 100,
    words: int = 5,
    top: int = 2000,
    within: int = 100,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    ``least`` occurrences make a candidate; one that stands in a longer candidate with ``within`` percent of its
    occurrences or more is left out; ``top`` is how many of a language are returned.
    """
    phrases, sizes = count_phrases(documents, least, words, text_column, lang_column)
    phrases = phrases.withColumn("parts", F.split("phrase", " "))
    candidates = phrases.where(F.col("size") > 1)
    # a longer candidate that holds a phrase often enough has one of one more word between them that does too
    inner = F.array(_part("1", "size - 1"), _part("2", "size - 1"))
    held = candidates.where(F.col("size") > 2).select(
        "lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("of_longer")
    )
    held = held.groupBy("lang", "phrase").agg(F.max("of_longer").alias("of_longer"))
    free = candidates.join(held, ["lang", "phrase"], "left").where(
        F.col("of_longer").isNull() | (F.col("of_longer") * 100 < F.lit(within) * F.col("a"))
    )
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", _part("1", "k").alias("left"), _part("k + 1", "size - k").alias("right")
    )
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("part_a"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.withColumnsRenamed({"part": side, "part_a": name}), ["lang", side])
    wide = "decimal(19, 0)"
    over = (F.col("a") * 1000).cast(wide) * F.col("n").cast(wide)
    under = F.col("l").cast(wide) * F.col("r").cast(wide)
    scored = cuts.join(sizes, "lang").withColumn("over", over).withColumn("under", under)
    scored = scored.withColumn("score", F.expr("over div under"))
    lowest = scored.groupBy("lang", "phrase").agg(
        F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("x")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        lowest.select("lang", "phrase", "x.*")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
