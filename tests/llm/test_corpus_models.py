"""Language model, manifest and collocations against brute force, on small and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bizpanel.llm import dealing, queries
from bizpanel.llm.collocations import mine_collocations
from bizpanel.llm.dealing import distinct, get, get_lists, put, put_lists, starts, summed
from bizpanel.llm.mapped import map_arrays, write_arrays
from bizpanel.llm.merkle import build_manifest, document_leaves
from bizpanel.llm.ngram_lm import discounts, fit_ngrams, not_learned, score_texts
from bizpanel.llm.scratch import drop, store

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(params=["one chunk", "many chunks"])
def dealt(request, monkeypatch):
    """The same results whether the input is one chunk and shard or many."""
    if request.param == "many chunks":
        monkeypatch.setattr(dealing, "CHUNK_BYTES", 1 << 15)
        monkeypatch.setattr(dealing, "SHARD_BYTES", 1 << 14)


@pytest.fixture(scope="module")
def odd_texts(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    odd = [
        (None, None, "A b\nc. c b"), (-1, None, None), (-2, "", ""), (-3, "é", " \t "), (5, "und", "x " * 3000),
        (5, "en", "of the\x0bOf The of the"), (5, "en", "of the\x0bOf The of the"), (7, "fr", "one"),
    ]
    frame = documents.union(spark.createDataFrame(odd, "doc_id long, lang string, text string"))
    return frame.withColumns({"shard": F.lit(1), "chunk": F.lit("x"), "id": F.lit(2), "kind": F.lit(None).cast("int")})


# dealing


def test_numbers_come_back():
    for values in ([], [0], [5, 0, 70_000], [1 << 40, 3]):
        assert get(put(np.array(values, np.int64))).tolist() == values


def test_lists_come_back():
    values, sizes = np.array([7, 9, 2, 2, 70_000, 0]), np.array([2, 3, 1])
    assert get_lists(put_lists(values, sizes), sizes).tolist() == values.tolist()


def test_distinct_and_sums():
    values = np.array([9, 3, 9, 1 << 63, 3, 9], np.uint64)
    keys, at, counts = distinct(values)
    assert keys.tolist() == [3, 9, 1 << 63] and counts.tolist() == [2, 3, 1]
    assert keys[at].tolist() == values.tolist()
    keys, total = summed(values, np.arange(6))
    assert keys.tolist() == [3, 9, 1 << 63] and total.tolist() == [5, 7, 3]


def test_shards_divide_all_values():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64))
    cut = starts(keys, 7)
    assert cut[0] == 0 and cut[-1] == 1000 and (np.diff(cut) > 80).all()


def test_arrays_are_mapped(tmp_path):
    arrays = [np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.float32)]
    for folder in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        name = write_arrays(folder, "x", arrays)
        back = map_arrays(folder, name, 5, [np.uint64, np.float32])
        assert all(isinstance(b, np.memmap) and (a == b).all() for a, b in zip(arrays, back))
    assert [len(a) for a in map_arrays(str(tmp_path), None, 0, [np.uint64])] == [0]


def test_stored_table_is_dropped(spark):
    kept, gone = store(spark.range(5)), store(spark.range(7).withColumn("kind", F.col("id") % 2), "kind")
    assert gone.where("kind = 1").count() == 3
    drop(gone)
    assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()


# language model


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), "</s>"]


class ByForce:
    """Interpolated modified Kneser-Ney over pairs, from dictionaries."""

    def __init__(self, texts):
        self.count, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.count.update(w)
            self.pairs.update(zip(["<s>", *w[:-1]], w))
        self.before, self.after, self.kinds = Counter(), Counter(), defaultdict(Counter)
        for (v, w), c in self.pairs.items():
            self.before[w] += 1
            self.after[v] += c
            self.kinds[v][min(c, 3)] += 1
        self.d2, self.d1 = self._discounts(self.pairs), self._discounts(self.before)
        self.n, self.v, self.ends = sum(self.count.values()), len(self.count), sum(self.before.values())
        left = sum(self.d1[min(c, 3)] for c in self.before.values())
        self.unknown = (left / self.ends if self.ends else 1.0) / (self.v + 1)

    @staticmethod
    def _discounts(counts):
        of = Counter(counts.values())
        return (0.0, *discounts(*(of[k] for k in (1, 2, 3, 4))))

    def alone(self, w):
        return (self.before[w] - self.d1[min(self.before[w], 3)]) / max(self.ends, 1) + self.unknown

    def after_word(self, w, v):
        if not self.after[v]:
            return self.alone(w)
        c = self.pairs[v, w]
        back = sum(self.d2[k] * self.kinds[v][k] for k in (1, 2, 3)) / self.after[v]
        return (c - self.d2[min(c, 3)]) / self.after[v] + back * self.alone(w)

    def of(self, text):
        w = tokens(text)
        base = sum(math.log10((self.count[x] + 1) / (self.n + self.v + 1)) for x in w)
        score = sum(math.log10(self.after_word(x, v)) for v, x in zip(["<s>", *w[:-1]], w))
        return len(w), sum(self.count[x] > 0 for x in w), base, score


def test_probabilities_sum_to_one():
    model = ByForce(["a b a c. d", "a b", "c c c a"])
    for v in ("<s>", "a", "never"):
        assert sum(model.after_word(w, v) for w in [*model.count, "unknown"]) == pytest.approx(1)


def test_discounts_where_counts_of_counts_give_none():
    assert discounts(0, 0, 0, 0) == (0.5, 1.0, 1.5)
    one, two, three = discounts(100, 40, 20, 12)
    assert 0 < one < 1 and 0 < two < 2 and 0 < three < 3


def test_scores_by_force(odd_texts, dealt):
    rows = odd_texts.select("doc_id", "text").collect()
    out = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    force = ByForce([r["text"] for r, o in zip(rows, out) if not o])
    model = fit_ngrams(odd_texts.where(~not_learned(F.col("doc_id"))))
    assert (model.tokens, model.words) == (force.n, force.v)

    def order(row):
        return (str(row[0]), *row[1:3], round(row[3], 5))

    ours = sorted(map(tuple, score_texts(odd_texts, model).collect()), key=order)
    theirs = sorted(((r["doc_id"], *force.of(r["text"])) for r in rows), key=order)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a[:3] == b[:3]
        assert a[3] == pytest.approx(b[3], abs=1e-6)
        # weights of pairs are 32-bit floats
        assert a[4] == pytest.approx(b[4], abs=1e-6 * b[1] + 1e-5)


def test_model_without_texts(odd_texts):
    none = odd_texts.limit(0)
    model = fit_ngrams(none)
    assert score_texts(none, model).collect() == []
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in score_texts(odd_texts, model).collect())


def test_known_order_of_words_is_likelier(spark):
    texts = [(i, "the cat sat on the mat and the dog lay on the rug") for i in range(8)]
    model = fit_ngrams(spark.createDataFrame(texts, "doc_id long, text string"))
    asked = [(1, "the cat sat on the mat"), (2, "mat the on sat cat the"), (3, "zig zag zog the cat on")]
    scored = score_texts(spark.createDataFrame(asked, "doc_id long, text string"), model)
    score = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert score[1] > max(score[2], score[3])


def test_lm_query(spark):
    rows = queries.op11_lm_scoring(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    trained = sum(r["n_tokens"] for r in rows if not r["held_out"])
    assert {r["train_tokens"] for r in rows} == {trained}
    assert all(r["n_known"] == r["n_tokens"] for r in rows if not r["held_out"])
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fanout):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + fanout])) for i in range(0, len(found[-1]), fanout)])
    return found


def manifest_by_force(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: levels([leaf(r) for r in groups[k]], fanout) for k in order}
    top = levels([trees[k][-1][0] for k in order], fanout)
    for number, k in enumerate(order):
        for place, r in enumerate(groups[k]):
            steps = []
            for tree, at in ((trees[k], place), (top, number)):
                for level in tree[:-1]:
                    run = at - at % fanout
                    steps.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
                    at //= fanout
            claimed = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                claimed[3] += 1
            node = leaf(claimed)
            for before, after in steps:
                node = sha(before + node + after)
            proof = sha("".join(b + a for b, a in steps))
            yield k, r[0], leaf(r), trees[k][-1][0], top[-1][0], proof, node, node == top[-1][0]


@pytest.fixture(scope="module")
def odd_leaves():
    pick = random.Random(3)
    langs = ["en"] * 6 + ["de", None, "é", "zz", ""]
    rows = [
        (pick.choice([None, *range(90)]), pick.choice(["s", None]), pick.choice(langs), pick.choice([None, 3]), pick.choice([None, "", "x é", "l" * 5000]))
        for _ in range(210)
    ]
    return rows + [rows[0]] * 40


@pytest.mark.parametrize("fanout, height", [(2, 1), (2, 3), (3, 1), (4, 9)])
def test_manifest_by_force(spark, odd_leaves, fanout, height):
    frame = spark.createDataFrame(odd_leaves, "doc_id long, source string, lang string, n_chars long, text string")
    frame = frame.withColumns({"tree": F.lit(1), "place": F.lit("p"), "leaf": F.lit(0), "block": F.lit(0)})
    ours = Counter(map(tuple, build_manifest(document_leaves(frame), fanout, height).collect()))
    assert ours == Counter(manifest_by_force(odd_leaves, fanout))


def test_manifest_of_none_and_of_one(spark, odd_leaves):
    frame = spark.createDataFrame(odd_leaves[:1], "doc_id long, source string, lang string, n_chars long, text string")
    (only,) = build_manifest(document_leaves(frame)).collect()
    assert only["root"] == only["subroot"] == only["leaf"] and only["proof_sha256"] == sha("")
    assert build_manifest(document_leaves(frame.limit(0))).collect() == []


def test_altered_sizes_are_found(spark):
    for r in queries.op12_merkle_manifest(spark, SMALL).collect():
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)


# collocations


def collocations_by_force(rows, least, words, top, within):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {
            p[i : i + k]
            for p, a in found.items()
            for k in range(2, len(p))
            for i in range(len(p) - k + 1)
            if 100 * a >= within * found[p[i : i + k]]
        }
        best = []
        for p, a in found.items():
            if p not in gone:
                cuts = ((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                score, k = min(cuts)
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


@pytest.mark.parametrize("least, words, top, within", [(10, 5, 2000, 100), (4, 4, 30, 60), (2, 2, 5, 100)])
def test_collocations_by_force(odd_texts, dealt, least, words, top, within):
    rows = [tuple(r) for r in odd_texts.select("lang", "text").collect()]
    ours = Counter(map(tuple, mine_collocations(odd_texts, least, words, top, within).collect()))
    assert ours == Counter(collocations_by_force(rows, least, words, top, within))


def test_no_phrases(odd_texts):
    assert mine_collocations(odd_texts.limit(0)).collect() == []
    assert mine_collocations(odd_texts, least=10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    wide = "decimal(19, 0)"
    a = 10**15
    row = spark.createDataFrame([(a, 10**17, 10**16, 10**16)], "a long, n long, l long, r long").selectExpr(
        f"cast(a * 1000 as {wide}) * cast(n as {wide}) as over", f"cast(l as {wide}) * cast(r as {wide}) as under"
    )
    assert row.selectExpr("over div under").first()[0] == 1000 * a * 10**17 // 10**32


def test_places_have_gaps_between_pieces():
    from bizpanel.llm.collocations import word_places

    _, places = word_places(pa.array(["a b. c", "", "d, e f"]))
    assert places.tolist() == [0, 1, 3, 5, 7, 8]
