"""Each operator against a brute-force version, on small and odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bizpanel.llm import jaccard_join, queries, sql
from bizpanel.llm.bpe import encode_documents
from bizpanel.llm.components import components
from bizpanel.llm.decontamination import (
    build_index,
    decontaminate,
    item_terms,
    proximity_matches,
    vocabulary_of,
)
from bizpanel.llm.jaccard_join import similar_components
from bizpanel.llm.license_scan import LicenceAutomaton, licence_labels, scan_licences
from bizpanel.llm.license_texts import TEMPLATES
from bizpanel.llm.linear import Incidence
from bizpanel.llm.packing import pack, unpack
from bizpanel.llm.quality import fit_ordinal, fit_quality, score_quality, select_rows
from bizpanel.llm.scratch import store
from bizpanel.llm.sharding import shard_rows
from bizpanel.llm.substring_dedup import remove_repeats
from bizpanel.llm.token_counts import ByteEncoder, section_tokens
from bizpanel.llm.topk import exact_top_k
from bizpanel.llm.toxicity import fit_label_model, fit_toxicity, held_out, score_toxicity

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def removed_by_force(rows, size=13):
    first = {}
    for i, t in rows:
        w = spaced(t)
        for s in range(len(w) - size + 1):
            if i is not None:
                g = tuple(w[s : s + size])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = spaced(t)
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and first[tuple(w[s : s + size])] < i:
                gone |= set(range(s, s + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def components_by_force(rows):
    sets = {}
    for i, t in rows:
        w = spaced(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None and w:
            grams = {tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))}
            sets.setdefault(i, []).append(grams)
    lead = {i: i for i, _ in rows if i is not None}
    for a, b in itertools.combinations(sorted(sets), 2):
        if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            low, high = sorted((lead[a], lead[b]))
            lead = {k: low if v == high else v for k, v in lead.items()}
    return lead


def documents_of(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    wanted = con.sql(sql.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = [sorted(map(str, f[columns].itertuples(index=False))) for f in (got, wanted)]
    assert rows[0] == rows[1]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for values in ([], [0], [2**64 - 1], sorted(rng.integers(0, 2**63, 500).tolist())):
        values = np.array(values, np.uint64)
        assert (unpack(pack(values)) == values).all()


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 160)]
    lead = {n: n for e in edges for n in e}
    for a, b in edges * 2:
        low, high = sorted((lead[a], lead[b]))
        lead = {k: low if v == high else v for k, v in lead.items()}
    touched = {n for a, b in edges if a != b for n in (a, b)}
    found = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {n: lead[n] for n in touched}


def test_token_counts(spark, odd_documents):
    encoder = ByteEncoder(RANKS, public_tokenizers.PATTERN)
    for rule in ("majority", "start", "split"):
        got = section_tokens(odd_documents, RANKS, public_tokenizers.PATTERN, rule=rule).toPandas()
        sums = got.groupby(["doc_id", "n_doc_tokens"], dropna=False).n_tokens.sum()
        for (i, total), tokens in sums.items():
            copies = 2 if i == 6 else 1
            assert abs(tokens - copies * total) < 1e-6
    text = "ab cd\n\nef gh ij\nk"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = section_tokens(frame, RANKS, public_tokenizers.PATTERN, rule="start").orderBy("section_no").collect()
    assert [text[r.char_start : r.char_end] for r in got] == ["ab cd\n\n", "ef gh ij\n", "k"]
    starts = [0, *encoder.ends(text)[:-1]]
    assert [r.n_tokens for r in got] == [sum(r.char_start <= s < r.char_end for s in starts) for r in got]


def test_licence_scan(spark, odd_documents):
    rows = licence_labels(scan_licences(odd_documents)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == odd_documents.count()
    assert (by_id[8].n_base, by_id[8].first_word, by_id[8].last_word) == (2, 0, 5)
    assert by_id[8].base_labels == "cc-by-nc,mit" and by_id[8].score == 1.0
    assert (by_id[1].n_words, by_id[1].labels, by_id[1].first_word, by_id[1].score) == (0, "", None, 0.0)
    notice = "x Permission is hereby granted, FREE of charge, to any person obtaining a copy of this software"
    part = spark.createDataFrame([(1, notice), (2, "All rights reserved.")], "doc_id long, text string")
    found = {r.doc_id: r for r in licence_labels(scan_licences(part)).collect()}
    assert found[1].labels == "" and 0.1 < found[1].score < 0.75 and found[1].spans[0]["start"] == 1
    assert found[2].labels == "all-rights-reserved" and found[2].n_base == 0


def test_licence_template_before_words_of_longer_ones(spark):
    words = [(label, alnum(text)) for label, text in TEMPLATES]
    rows, wanted = [(0, "All rights reserved. No part of this work may be copied")], ["all-rights-reserved"]
    for label, short in words:
        for other, long in words:
            for k in range(1, 8):
                rows.append((len(rows), " ".join([*short, *long[len(short) : len(short) + k], "zz", *long[:k]])))
                wanted.append(label)
    got = licence_labels(scan_licences(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert wanted[r.doc_id] in r.labels.split(",") and r.score == 1.0, rows[r.doc_id]


def matches_by_force(text, template):
    """Matches on a diagonal that cannot be made longer: start, end, end in the template."""
    out = set()
    for i, j in itertools.product(range(len(text)), range(len(template))):
        if text[i] == template[j] and not (i and j and text[i - 1] == template[j - 1]):
            n = 1
            while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                n += 1
            if n >= min(4, len(template)):
                out.add((i, i + n, j + n))
    return out


def test_licence_matches_by_force():
    rng = np.random.default_rng(5)
    for _ in range(150):
        texts = [rng.choice(list("abc"), rng.integers(2, 12)).tolist() for _ in range(5)]
        automaton = LicenceAutomaton([("a b", "x")], [("t", " ".join(t)) for t in texts])
        text = [str(c) for c in rng.choice(list("abc"), 40)]
        ids = [automaton.vocabulary.get(w.encode(), -1) for w in text]
        _, found = automaton.scan(ids, 0)
        for k, template in enumerate(texts):
            assert {(s, e, at) for s, e, t, at in found if t == k} == matches_by_force(text, template)


def test_licence_spans_of_every_notice(spark):
    short, long = TEMPLATES[16][1], TEMPLATES[1][1]
    words = alnum(long)
    damaged = " ".join(w if k % 15 else "zz" for k, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    code = " ".join(f"x{k}" for k in range(60))
    rows = [
        (1, f" {code} ".join([long, damaged, half, long] * 30)),
        (2, " ".join([long] * 40)),
        (3, " ".join([short] * 500)),
        (4, f"{long} {code} {short} {code} {long} {short}"),
    ]
    got = {r.doc_id: r for r in licence_labels(scan_licences(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    size = len(words)
    mit = [s for s in got[1].spans if s.label == "mit" and s.cover > 0.4]
    assert [s.cover == 1.0 for s in mit] == [True, False, False, True] * 30
    assert [s.cover >= 0.75 for s in mit] == [True, True, False, True] * 30
    whole = [s for s in got[2].spans if s.label == "mit" and s.cover == 1.0]
    assert [(s.start, s.end) for s in whole] == [(k * size, k * size + size) for k in range(40)]
    assert [(s.start, s.end) for s in got[3].spans if s.cover == 1.0] == [(3 * k, 3 * k + 3) for k in range(500)]
    four = [(s.label, s.start, s.end) for s in got[4].spans if s.cover == 1.0]
    first, last = size + 60, size + 123
    rights, mits = "all-rights-reserved", "mit"
    assert sorted(four) == sorted([(mits, 0, size), (rights, first, first + 3), (mits, last, last + size), (rights, last + size, last + size + 3)])


def chains_by_force(hits, gap):
    """All chains of matches (start, end, end in the template): start, end, covered."""
    out = {(s, e, e - s, at) for s, e, at in hits}
    while True:
        more = set(out)
        for first, last, covered, was in out:
            for s, e, at in hits:
                size = e - max(s, last)
                if s >= first and e > last and at > was and 0 < size <= at - was and s - last <= gap:
                    more.add((first, e, covered + size, at))
        if more == out:
            return {c[:3] for c in out}
        out = more


def test_licence_spans_by_force():
    rng = np.random.default_rng(7)
    for _ in range(200):
        template = rng.choice(list("abcde"), 10).tolist()
        automaton = LicenceAutomaton([("a b", "x")], [("t", " ".join(template))])
        text = []
        for _ in range(rng.integers(1, 5)):
            a, b = sorted(rng.integers(0, 11, 2))
            text += [*template[a:b], *["z"] * rng.integers(0, 7)]
        _, found = automaton.scan([automaton.vocabulary.get(w.encode(), -1) for w in text], 0)
        every = chains_by_force([(s, e, at) for s, e, _, at in found], 12)
        chains = [s for of_one in automaton.chains(found) for s in of_one]
        spans = automaton.apart(chains)
        assert max((s.covered for s in chains), default=0) == max((c for _, _, c in every), default=0)
        assert all(x.end <= y.start for x, y in itertools.pairwise(spans))
        assert all(any(s < x.end and x.start < e for x in spans) for s, e, _ in every)
        full, last = 0, 0
        for s, e, c in sorted(every, key=lambda c: c[1]):
            if c >= 7.5 and s >= last:
                full, last = full + 1, e
        assert sum(automaton.cover(s) >= 0.75 for s in spans) >= full


def test_quality(spark, odd_documents):
    documents = documents_of(spark)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = fit_quality(documents, queries.graded(labels), queries.GRADES)
    assert list(model.thresholds) == sorted(model.thresholds)
    scored = score_quality(odd_documents, model)
    assert scored.count() == odd_documents.count()
    assert all(0 <= r.tails[1] <= r.tails[0] <= 1 for r in scored.collect())
    assert select_rows(odd_documents, model).columns == odd_documents.columns
    none = fit_quality(documents, queries.graded(labels.limit(0)), queries.GRADES)
    assert score_quality(documents.limit(3), none).count() == 3


def test_ordinal_regression_orders_grades():
    grade = np.repeat([0, 1, 2], 100)
    packed = [np.array([g], "<u4").tobytes() for g in grade]
    weights, thresholds = fit_ordinal(Incidence(packed), grade, 3)
    assert weights[0] < thresholds[0] < weights[1] < thresholds[1] < weights[2]


def test_toxicity(spark, odd_documents):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        bad = bool(rng.random() < 0.3)
        text = " ".join(f"w{k}" for k in rng.integers(0, 300, 30)) + (" you idiot" if bad else "")
        rows.append((i, text))
        labels.append((i, int(bad)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame(labels, "doc_id long, rating long")
    model = fit_toxicity(documents, ratings)
    got = score_toxicity(documents, model).withColumn("out", held_out(F.col("doc_id"))).where("out").collect()
    assert all((r.score >= 0.5) == bool(dict(labels)[r.doc_id]) for r in got)
    assert score_toxicity(odd_documents, model).count() == odd_documents.count()
    assert score_toxicity(documents, fit_toxicity(documents, ratings.limit(0))).where("score > 0.5").isEmpty()


def test_label_model_shares_the_evidence_of_copies():
    rng = np.random.default_rng(4)
    truth = rng.random(2000) < 0.3
    votes = np.stack([np.where(truth, rng.random(2000) < 0.8, rng.random(2000) < 0.1) for _ in range(3)], 1)
    copied = np.concatenate((votes, votes[:, :1], votes[:, :1]), axis=1).astype(float)
    model = fit_label_model(copied, votes.mean(axis=1))
    assert model.own[0] < 0.5 < model.own[1]
    assert ((model.posterior(copied) > 0.5) == truth).mean() > 0.85


def test_substring_dedup(spark, odd_documents):
    got = remove_repeats(odd_documents, digests=True, group_bytes=2000).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == removed_by_force(pairs_of(odd_documents))
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"v{k}" for k in rng.integers(0, 3, 60))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(frame, digests=True, group_bytes=500).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == removed_by_force(rows)
    texts = {r.doc_id: r for r in remove_repeats(odd_documents, carry=("grp",)).where("doc_id < 6").collect()}
    assert texts[3].kept_text == " \n\t " and texts[4].n_removed == 0 and texts[5].grp == 1


def test_bpe(spark, odd_documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = pairs_of(odd_documents) + pairs_of(documents_of(spark).limit(50))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)))
    got = [(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in encode_documents(frame, WORD_BPE).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_jaccard_join(spark, odd_documents):
    lead = components_by_force(pairs_of(odd_documents))
    got = similar_components(odd_documents).where("doc_id IS NOT NULL").collect()
    assert {r.doc_id: r.component_id for r in got} == lead
    # a chain of near copies, and salted columns
    words = [f"a{k}" for k in range(90)]
    rows = [(k, " ".join([*words[k:], *(f"b{k}x{j}" for j in range(k))])) for k in range(0, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (50_000, 4):
        got = {r.doc_id: r.component_id for r in similar_components(frame, hot=hot).collect()}
        assert got == components_by_force(rows)


def test_jaccard_join_many_near_copies(spark, monkeypatch):
    """A large group of near copies, many of which are similar to few others only: pairs grow with the rows."""
    words, dice = [f"w{k}" for k in range(60)], random.Random(5)
    rows = []
    for i in range(1000):
        own = list(words)
        for place in dice.sample(range(60), dice.choice((1, 1, 2))):
            own[place] = f"x{i}x{place}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"y{i}x{k}" for k in range(60))) for i in range(1000)]
    sets = [{tuple(t.split()[s : s + 5]) for s in range(56)} for _, t in rows[:1000]]
    columns = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    incidence = np.zeros((len(sets), len(columns)), np.float32)
    for k, own in enumerate(sets):
        incidence[k, [columns[g] for g in own]] = 1
    shared = incidence @ incidence.T
    links = 100 * shared >= 75 * (112 - shared)
    lead = np.arange(len(sets))
    while (lower := np.where(links, lead, len(lead)).min(axis=1)).tolist() != lead.tolist():
        lead = lower
    counted = []
    plain = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda pairs, *rest: counted.append(pairs.count()) or plain(pairs, *rest))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar_components(frame).collect()}
    assert got == {i: int(lead[i]) if i < 1000 else i for i, _ in rows}
    assert sum(counted) < 40 * len(rows), counted


def test_jaccard_join_null_id_before_its_copy(spark):
    words = [f"a{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "b"])
    for rows in ([(None, text), (7, text), (8, near)], [(None, text), (None, near), (9, near), (7, text), (None, near)]):
        frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = similar_components(frame).where("doc_id IS NOT NULL").collect()
        assert {r.doc_id: r.component_id for r in got} == components_by_force(rows)
        assert similar_components(frame).count() == len(rows)


def test_decontamination(spark, odd_documents):
    items = spark.createDataFrame(
        [(1, "ONE two"), (2, None), (3, " ".join(f"copy{i}" for i in range(5, 18))), (None, "tail"), (1, "mit license")],
        "item_id long, text string",
    )
    got = decontaminate(odd_documents, items).collect()
    assert len(got) == odd_documents.count()
    windows = []
    for i, t in [(r.item_id, r.text) for r in items.collect()]:
        w = alnum(t)
        windows += [(i, w[s : s + min(10, len(w))]) for s in range(len(w) - min(10, len(w)) + 1) if w]
    for r, text in zip(sorted(got, key=lambda r: str(r.doc_id)), [t for _, t in sorted(pairs_of(odd_documents), key=lambda p: str(p[0]))]):
        w, hit, met = alnum(text), set(), set()
        for i, g in windows:
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit |= set(range(s, s + len(g)))
                    met |= {str(i)} if i is not None else set()
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(met))
    assert decontaminate(odd_documents, items.limit(0)).where("n_hit > 0").isEmpty()


def test_proximity(spark):
    documents = spark.createDataFrame([(1, "x alpha y beta z gamma alpha"), (2, "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "gamma beta alpha")], "item_id long, text string")
    terms = store(item_terms(items))
    vocabulary = store(vocabulary_of(terms))
    index = build_index(documents, vocabulary)
    found = proximity_matches(index, terms.join(vocabulary, "term"), span=5, rarest=3).collect()
    assert [(r.start, r.end) for r in found] == [(3, 7)]


def test_sharding(spark, odd_documents):
    documents = documents_of(spark)
    got = shard_rows(documents, shards=4).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 2 * got["size"].max()
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    odd = shard_rows(odd_documents, shards=3).toPandas()
    assert len(odd) == odd_documents.count() and odd["size"].min() == 1
    assert shard_rows(odd_documents.limit(0)).isEmpty()


def test_top_k(spark):
    rows = [
        (0, [0.5, -0.25]), (50, [0.5, -0.25]), (1, [0.1, 0.1]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
        (5, [0.5, -0.25]), (None, [1.0, 1.0]), (6, [-1.0, 3.0]), (7, [float("inf"), 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = exact_top_k(frame, F.col("vec_id") % 50 == 0, k=2).collect()
    ints = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for i, v in rows if i in (0, 50, 1, 5, 6)}
    wanted = []
    for q in (0, 50):
        scored = sorted((-int(np.dot(ints[q], v)), i) for i, v in ints.items() if i != q)[:2]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(wanted)
    assert exact_top_k(frame.limit(0), F.col("vec_id") == 0).isEmpty()


def test_empty_documents(spark):
    none = documents_of(spark).limit(0)
    assert similar_components(none).isEmpty() and remove_repeats(none).isEmpty()
    assert encode_documents(none, WORD_BPE).isEmpty() and scan_licences(none).isEmpty()
    assert decontaminate(none, spark.read.parquet(f"{SMALL}/benchmark.parquet")).isEmpty()


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents_of(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = store(stage(spark, docs, SMALL))
        assert kept.columns == docs.columns
        assert kept.select("doc_id").subtract(docs.select("doc_id")).isEmpty(), name
        docs = kept
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert coded.count() == docs.count() > 100


def test_pipeline_by_force(spark, tmp_path):
    """All stages against brute force, with ids that repeat with unrelated, similar and equal texts."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    labels, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    base = [(i, t) for i, t in pairs_of(documents_of(spark)) if len(spaced(t)) > 80][:40]

    def near(text):
        return " ".join([*spaced(text)[:-3], "changed"])

    (a, one), (b, two), (c, three), (d, four) = sorted(base)[:4]
    leak = " ".join(alnum(next(r.text for r in items.collect() if len(alnum(r.text)) > 15))[:14])
    rows = base + [
        (a, three + " own"), (a, " ".join(reversed(spaced(one)))), (a, one), (c, near(two)), (c, " ".join(reversed(spaced(three)))),
        (d, near(four)), (None, one), (None, near(two)), (900, ""), (900, None), (900, near(four)),
        (900, "only here " + " ".join(reversed(spaced(four)))), (901, f"{' '.join(reversed(spaced(two)))} {leak}"),
        (901, " ".join([*spaced(base[9][1])[::2], *spaced(base[8][1])[10:40]])),
    ]
    wide = [(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long")
    for name, table in (("documents", frame), ("labels", labels), ("benchmark", items)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    texts = sorted({t for _, t in rows}, key=str)
    by_number = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = fit_quality(docs, queries.graded(labels), queries.GRADES)
    sound = {texts[r.doc_id] for r in score_quality(by_number, model).collect() if r.tails[0] >= 0.5}
    hashes = {r.text: r.h for r in by_number.select("text", F.xxhash64("text").alias("h")).collect()}
    quality = [(i, t) for i, t in rows if t in sound]

    lead = components_by_force([(k if i is not None else None, t) for k, (i, t) in enumerate(quality)])
    groups, near_copies = {}, []
    for k, (i, t) in enumerate(quality):
        if i is None or not spaced(t):
            near_copies.append((i, t))
        else:
            groups.setdefault(lead[k], []).append((i, hashes[t], t))
    near_copies += [(i, t) for i, _, t in map(min, groups.values())]

    first, repeats = {}, []
    for i, t in near_copies:
        for s in range(len(spaced(t)) - 12 if i is not None else 0):
            g = tuple(spaced(t)[s : s + 13])
            first[g] = min(first.get(g, i), i)
    for i, t in near_copies:
        w, gone = spaced(t), set()
        for s in range(len(w) - 12 if i is not None else 0):
            gone |= set(range(s, s + 13)) if first[tuple(w[s : s + 13])] < i else set()
        if not gone or len(gone) < len(w):
            # a null text comes back as an empty one
            repeats.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t or ""))

    windows = set()
    for w in (alnum(r.text) for r in items.collect()):
        windows |= {tuple(w[s : s + min(10, len(w))]) for s in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(g) for g in windows}
    leaks = [(i, t) for i, t in repeats if not any(tuple(alnum(t)[s : s + n]) in windows for n in sizes for s in range(len(alnum(t)) - n + 1))]
    assert len(rows) >= len(quality) > len(near_copies) > len(leaks) > 5 and quality != repeats

    wanted = {"quality": quality, "near_copies": near_copies, "repeats": repeats, "leaks": leaks}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, str(tmp_path)))
        assert sorted(pairs_of(docs), key=str) == sorted(wanted[name], key=str), name
    library = Tokenizer.from_file(WORD_BPE)
    tokens = []
    for i, t in leaks:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        tokens.append((i, len(ids), tuple(ids), hashlib.sha256(decoded.encode()).hexdigest()))
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in coded), key=str) == sorted(tokens, key=str)


def test_jaccard_join_bounds_arrow_batches_while_it_counts(spark, monkeypatch):
    """Rows that carry whole sets go to Python in batches of bounded bytes; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    outside, seen = spark.conf.get(key), []
    plain = jaccard_join._links
    monkeypatch.setattr(jaccard_join, "_links", lambda *args: seen.append(spark.conf.get(key)) or plain(*args))
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(words[: 39 + i % 2])) for i in range(6)] + [(6, "other words here"), (7, None)]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 6, 7: 7}
    assert seen and all(int(v) == jaccard_join.BATCH_BYTES for v in seen), seen
    assert spark.conf.get(key) == outside


def test_select_rows_sends_only_texts_to_python(spark):
    rows = [(i, f"good words {i}" if i % 3 else "bad bad bad", "x" * 50) for i in range(300)] + [(None, None, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ratings = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, rating long")
    model = fit_quality(documents, ratings, 2)
    chosen = select_rows(documents, model)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert chosen.columns == documents.columns
    scored = {r.doc_id: r.tails[0] >= 0.5 for r in score_quality(documents, model).collect()}
    assert sorted(r.doc_id for r in chosen.collect() if r.doc_id is not None) == sorted(
        k for k, v in scored.items() if v and k is not None
    )
    assert chosen.where("doc_id is null").count() == int(scored[None])
