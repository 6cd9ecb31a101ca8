"""Held-out accuracy of the classifiers, and vector search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from brieflake.llm import language, quality, toxicity, vector_search

from ..conftest import DATA

BIG = DATA.replace("0.001", "0.01")


def held(spark, query, label, sf=BIG):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return [(r.score, r.predicted, labels[r.doc_id]) for r in query(spark, sf).collect() if r.held_out and r.doc_id in labels]


def auc(rows):
    a, b = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    return np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])


def test_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = [r for r in language.op7_language(spark, BIG).collect() if r.held_out]
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows]) >= 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, tables):
    got = {}
    for r in language.op7_language(spark, tables).collect():
        got.setdefault(r.doc_id, r)
    assert [got[i].lang_pred for i in (4, 5, 6, 12, 13)] == ["und"] * 5 and got[4].score == 0
    assert got[11].lang_pred != "und"


def test_quality(spark):
    rows = held(spark, quality.op3_quality, "quality")
    assert auc(rows) >= 0.97


def test_toxicity(spark):
    rows = held(spark, toxicity.op10_toxicity, "toxic")
    assert auc(rows) >= 0.65  # some 70 rows; about one in eight toxic labels has nothing toxic in its text


def test_toxicity_at_a_larger_size(spark):
    rows = held(spark, toxicity.op10_toxicity, "toxic", DATA.replace("0.001", "0.1"))
    assert auc(rows) >= 0.95
    assert np.mean([p for _, p, y in rows if y]) >= 0.85 and np.mean([y for _, p, y in rows if p]) >= 0.9


def test_toxicity_bends():
    bad = [f"some words {w} and others {i}" for i, w in enumerate(["grobniak", "fleabag"] * 60)]
    good = [f"some words {w} and others {i}" for i, w in enumerate(["harmless", "gentle", "grown", "flagged"] * 100)]
    m = toxicity.fit(bad + good, [1] * len(bad) + [0] * len(good), np.ones(len(bad) + len(good)))
    p = toxicity.Scorer(m)(["a grobniak here", "a grob-niak here", "a groxbniak here", "a g r o b n i a k here", "a gentle, grown harmless thing", "", None])
    assert (p[:4] >= 0.5).all() and (p[4:] < 0.5).all()


def test_no_labels_or_one_kind(spark, tables, empty_tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    none = spark.read.parquet(f"{empty_tables}/labels.parquet")
    for mod in (quality, toxicity):
        assert {r.score for r in mod.scored(docs, mod.learn(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in quality.scored(docs, quality.learn(docs, ones)).collect())


def test_gam_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, np.ones(len(y)))
    assert ((quality.scores(m, x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_quality_scores_are_sums_of_tables():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (300, len(quality.NAMES))).round(2)
    m = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), np.ones(len(x)))
    assert m.pairs
    bin_of = lambda v, edges: sum(v >= e for e in edges)
    want = []
    for row in x:
        f = m.base + sum(m.tables[j][bin_of(v, m.edges[j])] for j, v in enumerate(row))
        f += sum(t[bin_of(row[i], m.coarse[i]), bin_of(row[j], m.coarse[j])] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        want.append(1 / (1 + math.exp(-f)))
    assert np.allclose(quality.scores(m, x), want)


def test_language_weights_are_the_explicit_kernel():
    flags = np.zeros(1 << language.BITS, dtype=bool)
    texts = [f"{a} {b} {c} words" for a in ("the cat", "le chat", "die katze") for b in ("sat down", "est assis", "sitzt da") for c in ("today", "demain", "morgen")]
    langs = ["en" if "the" in t else "fr" if "le " in t else "de" for t in texts]
    grams = [set(language.present(t, flags).tolist()) for t in texts]
    m = language.fit([np.array(sorted(g)) for g in grams], langs)
    k = lambda x, y: len(x & y) / math.sqrt(len(x) * len(y))
    marks = [i for lang in sorted(set(langs)) for i in [j for j, x in enumerate(langs) if x == lang][: language.LANDMARKS // 3]]
    kmm = np.array([[k(grams[i], grams[j]) for j in marks] for i in marks])
    knm = np.array([[k(g, grams[j]) for j in marks] for g in grams])
    y = np.array([[1.0 if x == lang else -1.0 for lang in m.langs] for x in langs])
    values, vectors = np.linalg.eigh(kmm)
    inverse = vectors @ np.diag(1 / np.maximum(values, 1e-6)) @ vectors.T
    # kernel ridge regression on Nystroem features, in its dual form
    low = knm @ inverse @ knm.T
    alpha = np.linalg.solve(low + language.RIDGE * len(texts) / 100 * np.eye(len(texts)), y)
    for t in ["the cat sat", "le chat demain", "katze morgen"]:
        g = set(language.present(t, flags).tolist())
        f = np.array([k(g, grams[j]) for j in marks]) @ inverse @ knm.T @ alpha
        (lang,), (sure,) = language.score(m, [t], flags)
        assert lang == m.langs[int(f.argmax())] and abs(sure - min(1, max(0, (1 + f.max()) / 2))) < 1e-3


def test_toxicity_table_is_the_explicit_kernel():
    from itertools import combinations

    def counts(w):
        out = {}
        for at in combinations(range(len(w)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                s = "".join(w[i] for i in at)
                out[s] = out.get(s, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1 - toxicity.ORDER)
        return out

    def scale(w):
        return math.sqrt(sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1 - toxicity.ORDER)) for at in combinations(range(len(w)), toxicity.ORDER) if at[-1] - at[0] < toxicity.SPAN))

    words = [toxicity.normal(w) for w in ("grobniak", "gentle", "fleabag", "grobxniak", "abé", "harmless")]
    marks = words[:3]
    got = toxicity._kernel(words, marks)
    for i, a in enumerate(words):
        for j, b in enumerate(marks):
            x, y = counts(a), counts(b)
            assert abs(got[i, j] - sum(v * y.get(s, 0) for s, v in x.items()) / scale(a) / scale(b)) < 1e-4


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e300, 0.0]), (1, [1e30, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [2.0, 5.0])]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], VECTORS)
    got = [(x.query_id, x.vec_id, x.score) for x in vector_search.top_k(df, df.where("vec_id in (0, 3)"), 2).collect()]
    top, most = (1 << 63) - 1, vector_search.LARGEST
    assert sorted(got) == [(0, 1, top), (0, 3, top), (3, 0, top), (3, 1, top)] and most * 256 > top


def test_features_of_odd_texts():
    import pyarrow as pa

    x = quality.features(pa.array([None, "", " ", "a", "é" * 10_000, "A A A\nA A A"]))
    assert x.shape == (6, len(quality.NAMES)) and np.isfinite(x).all()


VECTORS = "vec_id long, embedding array<double>, label int, rank int, query_id long"


def test_vector_search(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.2, 16).round(2).tolist(), 0, 0, 0) for i in range(400)]
    rows += [(400, None, 0, 0, 0), (401, [], 0, 0, 0), (402, [None] * 16, 0, 0, 0), (403, [math.nan] * 16, 0, 0, 0), (404, [math.inf] * 16, 0, 0, 0), (None, [0.1] * 16, 0, 0, 0), (405, [0.5] * 16, 0, 0, 0), (406, [0.5] * 16, 0, 0, 0), (450, [0.5] * 3, 0, 0, 0), (500, [0.25] * 3, 0, 0, 0), (7, rows[7][1], 0, 0, 0)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in vector_search.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()]
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n", [1, 3, 40, 3000])
def test_search_block_is_exact_and_reads_few(n):
    r = np.random.default_rng(n)
    x = np.floor(256 * r.normal(0, 0.12, (n, 64))).astype(np.int64)
    ids, q = r.permutation(n).astype(np.int64), x[: min(n, 20)]
    lo, hi = x.min(axis=0), x.max(axis=0)
    step = np.maximum(1, -((lo - hi - 1) // vector_search.CELLS))
    who, got, s, reads = vector_search.search_block(q, ids[: len(q)], ids, x, ((x - lo) // step).astype(np.uint8), lo, step, 5)
    for i in range(len(q)):
        score = x @ q[i]
        want = sorted((-int(score[j]), int(ids[j])) for j in range(n) if ids[j] != ids[i])[:5]
        assert [(-int(b), int(a)) for a, b in zip(got[who == i], s[who == i], strict=True)] == want
    if n == 3000:
        assert reads < 0.5 * n * len(q)
