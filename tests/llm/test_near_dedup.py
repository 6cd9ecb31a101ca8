from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brieflake.llm import near_dedup, words

from .conftest import edge_texts, prose, rows, SCHEMA


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(items, n):
    sets = [shingle_set(t, n) for _, t in items]
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(items))


def ours(df, n):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_duplicates(df, n).collect())


@pytest.mark.parametrize("n", [2, 5])
def test_edge_cases_against_brute_force(docs, n):
    assert ours(docs, n) == brute([(i, t) for i, t, _ in edge_texts()], n)


def test_a_crowd_of_drifting_copies(spark):
    r, base, items = random.Random(5), prose(9, 80).split(), []
    for i in range(160):
        w = list(base)
        for _ in range(r.randint(0, 14)):
            w[r.randrange(len(w))] = r.choice(["the", "of", f"x{r.randint(0, 30)}"])
        items.append((i, " ".join(w)))
    df = spark.createDataFrame(rows([(i, t, "en") for i, t in items]), SCHEMA)
    assert ours(df, 2) == brute(items, 2)


def test_one_of_each_keeps_columns(docs):
    kept = near_dedup.one_of_each(docs, 5)
    assert kept.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("2") == 1 and "1" in ids and "3" not in ids and "4" in ids and "13" in ids  # of the rows with id 2 the other text stays


def test_words_and_hashes():
    texts = ["A bc\tBC", "", None, "x", "bc a", "\xa0y z"]
    got = [[w.hashes[w.ptr[i] : w.ptr[i + 1]].tolist() for i in range(len(w.ptr) - 1)] for w in words.words(pa.array(texts), words.SPACE_WORDS)]
    flat = [x for g in got for x in g]
    a, bc = flat[0][0], flat[0][1]
    assert flat[0] == [a, bc, bc] and flat[1] == [] and flat[2] == [] and flat[4] == [bc, a] and len(flat[5]) == 2
    by_one = [h for t in texts for w in words.words(pa.array([t], pa.string()), words.SPACE_WORDS) for h in w.hashes.tolist()]
    assert by_one == [h for f in flat for h in f]


def test_signature_agrees_as_similarity_does():
    r = np.random.default_rng(1)
    same = []
    for _ in range(60):
        x = r.integers(0, 2**63, 30).astype(np.uint64) * np.uint64(2)
        a, b = np.unique(x[:27]), np.unique(x[3:])
        same.append((near_dedup.signature(a) == near_dedup.signature(b)).mean())
    assert abs(np.mean(same) - 24 / 30) < 0.05
    one = near_dedup.signature(np.array([5], dtype=np.uint64))
    assert (one == 5).all()


def test_sets_of_many_texts_take_little_memory(monkeypatch):
    """The check's first finding: a worker's arrays and tables of powers count beside its executor's heap."""
    import tracemalloc

    texts = pa.array([" ".join(f"w{(i * 7919 + k) % 99991}" for k in range(700)) for i in range(1500)])
    for name in ("_pow", "_inv"):
        monkeypatch.setattr(words, name, words._pow[:1])
    tracemalloc.start()
    sets = sum(len(s) for s in near_dedup._sets(texts, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sets == 1500 * 696 and peak < 64 << 20
