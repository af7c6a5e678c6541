"""Interpolated modified Kneser-Ney model of word pairs, and the log probability of texts under it.

A text is a start mark, its words and an end mark, which is a token too. Each chunk of texts counts its distinct
words and pairs and deals them, as packed lists, to shards by the range of their 64-bit values. A pairs' shard adds up the
lists, and tells the words' shards how often each word begins and ends a pair and how many
different ones; the words' shards add that up and answer. Discounts follow from counts of counts. Each shard is then stored as
sorted hash arrays (values, weights) in the shared folder.

With backoff, log p(w|v) = log p(w) + log b(v) + extra(v, w), where ``extra`` is 0 for a pair that was not seen. So
the score of a text is a sum of weights of its words and of its pairs, and no shard needs another one: the distinct words
and pairs of each chunk go to their shards with the numbers of the rows that hold them, a worker maps its shard's
arrays into memory, looks the values up by binary search and sends back sums for each row.

Shards hold a bounded part of the input, a chunk sends a value to one shard once, however common it is, and nothing but a
few totals reaches the driver.

Defined results: null and empty texts are the end mark alone. Rows without id take part in the counts unless the
caller says otherwise, and are scored. Repeated rows count each time and are scored each. Extra columns are
dropped. Without training rows each word has probability 1 over the vocabulary and the unknown word, which is 1.
Where counts of counts do not give a discount between 0 and its count, 0.5, 1 and 1.5 stand in.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizpanel.llm.dealing import (
    chunks,
    distinct,
    get,
    get_keys,
    get_lists,
    joined,
    pieces,
    plan,
    put,
    put_keys,
    put_lists,
    starts,
    summed,
)
from bizpanel.llm.mapped import map_arrays, write_arrays
from bizpanel.llm.scratch import drop, shared_folder, store
from bizpanel.llm.words import SPACED_LOWER, U64, mix, split_words

START, END = (int(x) for x in mix(np.array([0x5354415254, 0x454E44], U64)))
_PAIR = U64(0xD6E8FEB86659FD93)
#: Discounts of counts 1, 2, and 3 or more where counts of counts give none.
DISCOUNTS = (0.5, 1.0, 1.5)
#: Parts of the shards that are written one after the other; the files of one part's shuffle go before the next.
TURNS = 4
_LISTS = "shard int, kind string, source int, words binary, numbers array<binary>, totals array<long>"
_FILES = "shard int, pair_file string, n_pairs long, word_file string, n_words long"
_WORD_FILE = [U64, np.int64, np.float64]
_PAIR_FILE = [U64, np.float32]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One value for each pair of words."""
    return mix(left * _PAIR + right)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of start mark, words and end mark of each text, the text of each, and the words of each text."""
    found, sizes = [], []
    for _, part in pieces(texts):
        words = split_words(part, SPACED_LOWER)
        size = words.counts
        begin = words.first[:-1] + 2 * np.arange(len(size))
        out = np.empty(len(words.start) + 2 * len(size), U64)
        inner = np.ones(len(out), bool)
        for at, mark in ((begin, START), (begin + size + 1, END)):
            out[at] = U64(mark)
            inner[at] = False
        out[inner] = words.values()
        found.append(out)
        sizes.append(size)
    size = joined(sizes, np.int64)
    return joined(found, U64), np.repeat(np.arange(len(size)), size + 2), size


def _row(shard: int, kind: str, source: int, words: np.ndarray, numbers: list[np.ndarray], totals=()) -> dict:
    return {
        "shard": shard,
        "kind": kind,
        "source": source,
        "words": put_keys(words),
        "numbers": [put(n) for n in numbers],
        "totals": [int(t) for t in totals],
    }


_LIST_TYPE = pa.schema(
    [
        ("shard", pa.int32()),
        ("kind", pa.string()),
        ("source", pa.int32()),
        ("words", pa.binary()),
        ("numbers", pa.list_(pa.binary())),
        ("totals", pa.list_(pa.int64())),
    ]
)


def chunk_counts(texts: pa.Array, shards: int) -> Iterator[dict]:
    """Counts of a chunk's distinct words and pairs, as a list for each shard."""
    values, _, _ = sequences(texts)
    words, at, times = distinct(values)
    token = words != U64(START)
    cut = starts(words[token], shards)
    for s in np.flatnonzero(np.diff(cut)):
        part = slice(cut[s], cut[s + 1])
        yield _row(int(s), "words", -1, words[token][part], [times[token][part]])
    first = np.flatnonzero(values != U64(END))
    code, _, count = distinct(at[first] * np.int64(len(words)) + at[first + 1])
    left, right = np.divmod(code, len(words))
    shard = (pair_keys(words[left], words[right]) >> U64(32)) * U64(shards) >> U64(32)
    order = np.argsort(shard, kind="stable")
    left, right, count = left[order], right[order], count[order]
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cut)):
        part = slice(cut[s], cut[s + 1])
        used, own = np.unique(np.concatenate((left[part], right[part])), return_inverse=True)
        n = cut[s + 1] - cut[s]
        yield _row(int(s), "pairs", -1, words[used], [own[:n], own[n:], count[part]])


def _lists(table: pa.Table, kind: str) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    for row in table.to_batches():
        for r in row.to_pylist():
            if r["kind"] == kind:
                yield r["source"], get_keys(r["words"]), [get(n) for n in r["numbers"]]


def merge_counts(table: pa.Table, shard: int, shards: int) -> Iterator[dict]:
    """A shard's words and pairs, its counts of counts, and what each word's shard has to know."""
    lists = list(_lists(table, "words"))
    words, count = summed(joined([w for _, w, _ in lists], U64), joined([n[0] for *_, n in lists], np.int64))
    yield _row(shard, "words", -1, words, [count])
    lists = list(_lists(table, "pairs"))
    words = np.unique(joined([w for _, w, _ in lists], U64))
    codes = []
    for _, own, (left, right, _) in lists:
        place = np.searchsorted(words, own)
        codes.append(place[left] * np.int64(len(words)) + place[right])
    code, count = summed(joined(codes, np.int64), joined([n[2] for *_, n in lists], np.int64))
    left, right = np.divmod(code, max(len(words), 1))
    yield _row(shard, "pairs", -1, words, [left, right, count], np.bincount(np.minimum(count, 5), minlength=6)[1:5])
    size = len(words)
    about = [np.bincount(left, count, size).astype(np.int64)]
    for low, high in ((1, 1), (2, 2), (3, None)):
        some = (count >= low) & (count <= high) if high else count >= low
        about.append(np.bincount(left[some], minlength=size))
    about.append(np.bincount(right, minlength=size))
    cut = starts(words, shards)
    for s in np.flatnonzero(np.diff(cut)):
        part = slice(cut[s], cut[s + 1])
        yield _row(int(s), "stats", shard, words[part], [a[part] for a in about])


def merge_words(table: pa.Table, shard: int) -> Iterator[dict]:
    """A shard's words with their counts, and an answer to each pairs' shard that has them."""
    counted = list(_lists(table, "words"))
    stats = list(_lists(table, "stats"))
    words = np.unique(joined([w for _, w, _ in counted + stats], U64))
    count = np.zeros(len(words), np.int64)
    for _, own, numbers in counted:
        count[np.searchsorted(words, own)] += numbers[0]
    about = np.zeros((5, len(words)), np.int64)
    for _, own, numbers in stats:
        about[:, np.searchsorted(words, own)] += np.stack(numbers)
    ended = about[4]
    totals = [count.sum(), (count > 0).sum(), ended.sum(), *np.bincount(np.minimum(ended, 5), minlength=6)[1:5]]
    yield _row(shard, "table", -1, words, [count, *about], totals)
    for source, own, _ in stats:
        yield _row(source, "reply", shard, own[:0], list(about[:, np.searchsorted(words, own)]))


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more, from how many have a count of 1, 2, 3 and 4."""
    y = ones / (ones + 2 * twos) if ones else 0.0
    found = []
    for k, (n, more) in enumerate(((ones, twos), (twos, threes), (threes, fours)), 1):
        d = k - (k + 1) * y * more / n if n else 0.0
        found.append(d if 0 < d < k else DISCOUNTS[k - 1])
    return tuple(found)


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return count - np.array((0.0, *d))[np.minimum(count, 3)]


@dataclass(frozen=True)
class NgramModel:
    """Where the arrays are, and the totals that all shards need.

    ``tokens`` and ``words`` are all and distinct training tokens; ``unknown`` is the probability of a word that no
    training row has.
    """

    folder: str
    files: DataFrame
    shards: int
    tokens: int
    words: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_share: float
    endings: int

    @property
    def unknown(self) -> float:
        return self.word_share / (self.words + 1)


def _backoff(about: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """What a word that begins pairs leaves to the word that follows; 1 for a word that begins none."""
    return np.where(about[0] > 0, (d[0] * about[1] + d[1] * about[2] + d[2] * about[3]) / np.maximum(about[0], 1), 1.0)


def _alone(ended: np.ndarray, model: NgramModel) -> np.ndarray:
    """The probability of a word by the number of different words before it."""
    return _discounted(ended, model.word_discounts) / max(model.endings, 1) + model.unknown


def _shard_files(table: pa.Table, shard: int, model: NgramModel) -> dict:
    out = {"shard": shard, "pair_file": None, "n_pairs": 0, "word_file": None, "n_words": 0}
    for _, words, (count, *about) in _lists(table, "table"):
        back = np.log10(_backoff(np.stack(about), model.pair_discounts))
        mark = words == U64(START)
        weight = np.where(mark, back, np.log10(_alone(about[4], model)) + back)
        if len(words):
            out |= {"word_file": write_arrays(model.folder, "words", [words, count, weight]), "n_words": len(words)}
    replies = sorted(_lists(table, "reply"), key=lambda x: x[0])
    about = np.concatenate([np.zeros((5, 0), np.int64), *(np.stack(n) for *_, n in replies)], axis=1)
    for _, words, (left, right, count) in _lists(table, "pairs"):
        if not len(left):
            continue
        back, alone = _backoff(about, model.pair_discounts), _alone(about[4], model)
        rest = back[left] * alone[right]
        extra = np.log10(_discounted(count, model.pair_discounts) / about[0][left] + rest) - np.log10(rest)
        keys = pair_keys(words[left], words[right])
        order = np.argsort(keys)
        name = write_arrays(model.folder, "pairs", [keys[order], extra[order].astype(np.float32)])
        out |= {"pair_file": name, "n_pairs": len(keys)}
    return out


def _by_shard(frame: DataFrame, make, schema: str, kind: pa.Schema) -> DataFrame:
    """Applies a generator of rows to all lists of a shard."""

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(make(table, table.column("shard")[0].as_py())), kind)

    return frame.groupBy("shard").applyInArrow(run, schema)


def _totals(lists: DataFrame) -> list[int]:
    summed_up = lists.select(F.posexplode("totals").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    return [r["n"] for r in summed_up.orderBy("k").collect()]


def fit_ngrams(documents: DataFrame, text_column: str = "text") -> NgramModel:
    """Counts the texts and stores the model in the shared folder."""
    texts = documents.select(F.col(text_column).alias("text"))
    chunk, shards = plan(texts, "text")
    folder = f"{shared_folder(documents.sparkSession)}/ngrams-{uuid.uuid4().hex}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in chunks(batches, "text", chunk):
            yield pa.RecordBatch.from_pylist(list(chunk_counts(rows.column("text"), shards)), _LIST_TYPE)

    counted = store(
        _by_shard(
            texts.mapInArrow(deal, _LISTS), lambda t, s: merge_counts(t, s, shards), _LISTS, _LIST_TYPE
        ),
        "kind",
    )
    of = F.col("kind")
    answered = store(
        _by_shard(counted.where(of.isin("words", "stats")), merge_words, _LISTS, _LIST_TYPE), "kind"
    )
    pair_totals = _totals(counted.where(of == "pairs")) or [0] * 4
    tokens, words, endings, *word_totals = _totals(answered.where(of == "table")) or [0] * 7
    by_word = discounts(*word_totals)
    once, twice = word_totals[:2]
    left = by_word[0] * once + by_word[1] * twice + by_word[2] * (words - once - twice)
    model = NgramModel(
        folder, counted, shards, tokens, words, discounts(*pair_totals), by_word,
        left / endings if endings else 1.0, endings,
    )
    totals = NgramModel(**{**model.__dict__, "files": None})
    parts = counted.where(of == "pairs").unionByName(answered.where(of.isin("table", "reply")))
    kind = pa.schema(
        [("shard", pa.int32()), ("pair_file", pa.string()), ("n_pairs", pa.int64()), ("word_file", pa.string()), ("n_words", pa.int64())]
    )
    files = []
    for turn in range(TURNS):
        own = parts.where(F.col("shard") % TURNS == turn)
        files.append(store(_by_shard(own, lambda t, s: [_shard_files(t, s, totals)], _FILES, kind)))
    drop(counted)
    drop(answered)
    return NgramModel(**{**model.__dict__, "files": reduce(DataFrame.unionByName, files)})


@dataclass(frozen=True)
class Asked:
    """Distinct values of a chunk in order, how often each comes, and the rows that hold them."""

    keys: np.ndarray
    times: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, rows: np.ndarray) -> Asked:
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return cls(keys[first], np.diff(np.append(first, len(rows))), rows)

    def by_shard(self, shards: int) -> list[Asked]:
        cut = starts(self.keys, shards)
        at = np.concatenate(([0], np.cumsum(self.times)))[cut]
        return [
            Asked(self.keys[i:j], self.times[i:j], self.rows[m:n])
            for i, j, m, n in zip(cut[:-1], cut[1:], at[:-1], at[1:])
        ]

    def packed(self) -> list[bytes]:
        return [put_keys(self.keys), put(self.times), put_lists(self.rows, self.times)]

    @classmethod
    def unpacked(cls, packed: list[bytes]) -> Asked:
        times = get(packed[1])
        return cls(get_keys(packed[0]), times, get_lists(packed[2], times))

    def found_in(self, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are stored, and where."""
        place = np.searchsorted(stored, self.keys)
        hit = place < len(stored)
        hit[hit] = stored[place[hit]] == self.keys[hit]
        return hit, place[hit]

    def sums(self, values: np.ndarray, rows: int) -> np.ndarray:
        """The sum of its values for each row."""
        return np.bincount(self.rows, np.repeat(values, self.times), rows).astype(np.float64)


def _answer(asked: pa.Table, files: pa.Table, model: NgramModel, kind: pa.Schema) -> pa.Table:
    """Sums for each row that a shard was asked about."""
    where = files.to_pylist()[0] if files.num_rows else dict.fromkeys(files.column_names)
    words = map_arrays(model.folder, where["word_file"], where["n_words"], _WORD_FILE)
    pairs = map_arrays(model.folder, where["pair_file"], where["n_pairs"], _PAIR_FILE)
    unknown = math.log10(model.unknown)
    out = []
    for row in (r for b in asked.to_batches() for r in b.to_pylist()):
        if row["ids"] is not None:
            out.append({"chunk": row["chunk"], "ids": row["ids"], "tokens": row["tokens"]})
            continue
        of_word, of_pair = Asked.unpacked(row["words"]), Asked.unpacked(row["pairs"])
        rows = 1 + max(int(x.rows.max(initial=-1)) for x in (of_word, of_pair))
        hit, at = of_word.found_in(words[0])
        count = np.zeros(len(hit), np.int64)
        count[hit] = words[1][at]
        weight = np.where(of_word.keys == U64(START), 0.0, unknown)
        weight[hit] = words[2][at]
        score = of_word.sums(weight, rows)
        base, known = of_word.sums(np.log10(count + 1.0), rows), of_word.sums(count > 0, rows)
        hit, at = of_pair.found_in(pairs[0])
        weight = np.zeros(len(hit))
        weight[hit] = pairs[1][at]
        score += of_pair.sums(weight, rows)
        one = np.flatnonzero((score != 0) | (known > 0))
        out.append(
            {
                "chunk": row["chunk"],
                "shard": row["shard"],
                "rows": put(np.diff(one, prepend=0)),
                "score": score[one].astype(np.float32).tobytes(),
                "base": base[one].tobytes(),
                "known": put(known[one].astype(np.int64)),
            }
        )
    return pa.Table.from_pylist(out, kind)


def _total(table: pa.Table, model: NgramModel) -> pa.Table:
    """The rows of a chunk, from the sums of all shards."""
    every = [r for b in table.sort_by("shard").to_batches() for r in b.to_pylist()]
    own = next(r for r in every if r["ids"] is not None)
    tokens = get(own["tokens"])
    score, base, known = np.zeros(len(tokens)), np.zeros(len(tokens)), np.zeros(len(tokens), np.int64)
    for row in every:
        if row["ids"] is None:
            at = np.cumsum(get(row["rows"]))
            score[at] += np.frombuffer(row["score"], np.float32)
            base[at] += np.frombuffer(row["base"])
            known[at] += get(row["known"])
    return pa.table(
        {
            "id": pa.array(own["ids"], table.schema.field("ids").type.value_type),
            "n_tokens": tokens,
            "n_known": known,
            "base_score": base - tokens * math.log10(model.tokens + model.words + 1),
            "score": score,
        }
    )


def score_texts(
    documents: DataFrame, model: NgramModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Of each row: id, ``n_tokens``, ``n_known``, ``base_score`` (words alone, one added) and ``score``.

    Both scores are log10 probabilities of the whole text.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    chunk, _ = plan(texts, "text")
    shards = model.shards
    id_kind = texts.schema["id"].dataType.simpleString()
    totals = NgramModel(**{**model.__dict__, "files": None})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in chunks(batches, "text", chunk):
            values, row, size = sequences(rows.column("text"))
            inner = np.flatnonzero(values != U64(END))
            pairs = Asked.of(pair_keys(values[inner], values[inner + 1]), row[inner]).by_shard(shards)
            words = Asked.of(values, row).by_shard(shards)
            ids = rows.column("id").combine_chunks()
            kind = pa.schema(
                [("shard", pa.int32()), ("chunk", pa.int64()), ("words", pa.list_(pa.binary())), ("pairs", pa.list_(pa.binary())),
                 ("tokens", pa.binary()), ("ids", pa.list_(ids.type))]
            )
            made = [{"shard": number % shards, "chunk": number, "tokens": put(size + 1), "ids": ids.to_pylist()}]
            for s, (w, p) in enumerate(zip(words, pairs)):
                if len(w.keys) or len(p.keys):
                    made.append({"shard": s, "chunk": number, "words": w.packed(), "pairs": p.packed()})
            yield pa.RecordBatch.from_pylist(made, kind)

    def answer(asked: pa.Table, files: pa.Table) -> pa.Table:
        kind = pa.schema(
            [("chunk", pa.int64()), ("shard", pa.int32()), ("rows", pa.binary()), ("score", pa.binary()), ("base", pa.binary()),
             ("known", pa.binary()), ("tokens", pa.binary()), asked.schema.field("ids")]
        )
        return _answer(asked, files, totals, kind)

    asked = texts.mapInArrow(
        deal, f"shard int, chunk long, words array<binary>, pairs array<binary>, tokens binary, ids array<{id_kind}>"
    )
    answers = asked.groupBy("shard").cogroup(model.files.groupBy("shard")).applyInArrow(
        answer,
        "chunk long, shard int, rows binary, score binary, base binary, known binary, tokens binary, "
        f"ids array<{id_kind}>",
    )
    scored = answers.groupBy("chunk").applyInArrow(
        lambda table: _total(table, totals),
        f"id {id_kind}, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_column)


def not_learned(id_column: Column) -> Column:
    """Rows that the model learns nothing from; rows without id are learned from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def perplexity(score: Column, tokens: Column) -> Column:
    """Of a text, from its log10 probability."""
    return F.pow(F.lit(10.0), -score / tokens)
