"""Decontamination and passages against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from brieflake.llm import decontaminate, passages

from .conftest import SCHEMA, prose, rows


def test_fm_index_finds_all():
    r = np.random.default_rng(2)
    for _ in range(20):
        text = np.concatenate([r.integers(1, 6, 300), [1, 0]])
        fm = decontaminate.FMIndex(text, 6)
        want = [tuple(r.integers(2, 6, 3)) for _ in range(30)]
        lo, hi = fm.search(np.array(want), np.full(30, 3))
        for k, w in enumerate(want):
            places = [i for i in range(len(text) - 2) if tuple(text[i : i + 3]) == w]
            assert sorted(fm.locate(np.arange(lo[k], hi[k])).tolist()) == places


def test_decontamination_cuts_spans(spark, tables):
    docs, bench = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.contamination(clean, bench).where("size(items) > 0").count() == 0
    items = {r.doc_id: r["items"] for r in decontaminate.contamination(docs, bench).collect()}
    assert items[10] == ["1", None] and items[7] == ["2"]
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[7] == "" and text[8] == "" and text[4] is None
    assert text[10] == " " + " ".join((prose(4, 70) + " " + prose(1, 120)).split()[14:])


def test_phrases_of_short_and_long_items():
    p = decontaminate.phrases([1, 2, 3, 4], ["a b c", " ".join("abcdefghijkl"), None, "--"])
    assert sorted(p.length.tolist()) == [3, 10, 10, 10]


def words(t):
    return (t or "").encode().lower().split()


def test_passages_against_brute_force(spark):
    r, shared = random.Random(3), [prose(100 + k, 50 + 9 * k) for k in range(8)]
    texts = []
    for i in range(80):
        parts = [prose(1000 + i, r.randint(0, 80))] + [x for k in r.sample(range(8), r.randint(0, 2)) for x in (shared[k], prose(5000 + 10 * i + k, r.randint(1, 60)))]
        texts.append((i, " \n".join(p for p in parts if p), "en"))
    texts += [(80, None, "en"), (81, "", "en"), (82, prose(1, 49), "en"), (83, prose(1, 49), "en")]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc: {x for s in r.spans for x in range(s.start, s.end)} for r in passages.duplicate_passages(df).collect()}
    seen, want = {}, {}
    for i, t, _ in texts:
        w = words(t)
        for k in range(len(w) - 49):
            first = seen.setdefault(tuple(w[k : k + 50]), i)
            if first != i:
                want.setdefault(i, set()).update(range(k, k + 50))
    # a chance word next to a passage that another than the smallest document has too may stay
    assert want and max(len(v - got.get(i, set())) for i, v in want.items()) <= 2
    assert set(got) == set(want) and all(len(got[i] - want[i]) <= 5 for i in got)
    cleaned = passages.without_repeats(df)
    assert cleaned.columns == df.columns
    after = {r.doc_id: r.text for r in cleaned.collect()}
    for i, t, _ in texts:
        assert words(after[i]) == [x for k, x in enumerate(words(t)) if k not in got.get(i, set())]
    assert after[80] is None


def test_a_near_passage_is_found_and_a_short_one_left(spark):
    p = prose(7, 160).split()
    q = list(p)
    q[80] = "edited"
    rows_ = [(1, prose(11, 40) + " " + " ".join(p), "en"), (2, " ".join(q) + " " + prose(12, 40), "en"), (3, " ".join(p[:45]) + " " + prose(13, 80), "en")]
    got = {r.doc: r for r in passages.duplicate_passages(spark.createDataFrame(rows(rows_), SCHEMA)).collect()}
    assert set(got) == {2} and got[2].keepers == [1]
    assert [(s.start, s.end) for s in got[2].spans] == [(0, 160)]


def test_a_passage_is_found_that_the_smallest_document_holds_in_part(spark):
    texts = []
    for k in range(12):
        p = prose(200 + k, 50).split()
        own = [prose(300 + 10 * k + j, 30) for j in range(5)]
        texts += [(3 * k, own[0] + " " + " ".join(p[:45] if k % 2 else p[5:]) + " " + own[1], "en"), (3 * k + 1, own[2] + " " + " ".join(p) + " " + own[3], "en"), (3 * k + 2, " ".join(p) + " " + own[4], "en")]
    # the keeper's first place holds a part, its second the whole
    p = prose(250, 50).split()
    texts += [(100, " ".join(p[:45]) + " " + prose(401, 60) + " " + " ".join(p), "en"), (101, prose(402, 30) + " " + " ".join(p) + " " + prose(403, 9), "en")]
    got = {r.doc: (r.keepers, [(s.start, s.end) for s in r.spans]) for r in passages.duplicate_passages(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert got == {3 * k + 2: ([3 * k + 1], [(0, 50)]) for k in range(12)} | {101: ([100], [(30, 80)])}


def test_near_passages_of_50_to_100_words(spark):
    r, texts, want = random.Random(8), [], {}
    shingled = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    while len(want) < 120:
        k = len(want)
        p = prose(20_000 + r.randrange(10**6), r.randint(50, 100)).split()
        q, edits = list(p), r.randint(1, 2)
        for _ in range(edits):
            i = r.randrange(5, len(q) - 5) if k >= 20 or edits > 1 else len(q) // 2
            q[i : i + r.randint(0, 1)] = [f"other{r.randrange(10**6)}"] * r.randint(0, 1)
        a, b = shingled(p), shingled(q)
        if len(q) < 50 or q == p or len(a & b) < 0.8 * len(a | b):
            continue
        before = prose(30_000_000 + k, r.randint(1, 60))
        texts += [(2 * k, " ".join([prose(40_000_000 + k, r.randint(1, 60)), *p, prose(50_000_000 + k, 20)]), "en"), (2 * k + 1, " ".join([before, *q, prose(60_000_000 + k, 20)]), "en")]
        want[2 * k + 1] = (len(before.split()), len(before.split()) + len(q))
    got = {r.doc: (r.keepers, [(s.start, s.end) for s in r.spans]) for r in passages.duplicate_passages(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert {d for d, (s, e) in want.items() if got.get(d) != ([d - 1], [(s, e)])} == set()


def test_a_run_said_over_and_over_is_one_row(spark):
    from brieflake.llm.store import Scratch

    found = [(d, 7, [(1, s) for s in range(400)] + [(2, 500 + d)] * 2) for d in (3, 5, 9)] + [(2, 7, [(4, 0)])]
    with Scratch(spark) as to:
        df = spark.createDataFrame(found, "doc long, tag long, open array<struct<run:long,start:int>>")
        got = [(r.doc, r.keeper, sorted((s.start, s.end) for s in r.spans)) for r in passages._held(df, to).collect()]
    over = [(s, s + 50) for s in range(400)]
    assert sorted(got) == sorted((d, 3, spans) for d in (5, 9) for spans in (over, [(500 + d, 550 + d)]))


def test_runs_are_joined_without_a_greedy_start():
    at = np.full(100, -1)
    for a, z in ((10, 20), (23, 48), (53, 73)):
        at[a:z] = np.arange(a, z)
    assert passages.matched_passages(at) == [(23, 77)]
    assert passages.matched_passages(np.where(np.arange(100) < 50, at, at + (at >= 0) * 12)) == []


def test_windows_are_made_once(spark, monkeypatch):
    """The check's second finding: splitting, hashing and minima of all texts are the same for the keys and for the windows."""
    made, one = [], passages._windows
    monkeypatch.setattr(passages, "_windows", lambda *a, **b: made.append(1) or one(*a, **b))
    p = prose(9, 70)
    df = spark.createDataFrame(rows([(1, f"{prose(21, 30)} {p}", "en"), (2, f"{p} {prose(22, 30)}", "en"), (3, f"{prose(23, 9)} {p}", "en")]), SCHEMA)
    got = {r.doc: (r.keepers, [(s.start, s.end) for s in r.spans]) for r in passages.duplicate_passages(df).collect()}
    assert made == [1] and got == {2: ([1], [(0, 70)]), 3: ([1], [(9, 79)])}


def test_passages_of_strips_are_joined_where_they_touch():
    r = np.random.default_rng(6)
    for _ in range(60):
        at = np.arange(900) + 5
        for k in r.integers(0, 900, 40):
            at[k : k + r.integers(1, 12)] = -1
        part = np.sort(r.integers(0, 3, 900))
        strip, start, end = passages.strip_passages(at, part)
        got = list(zip(strip.tolist(), start.tolist(), end.tolist(), strict=True))
        assert got == [(k, *x) for k in range(3) for x in passages.matched_passages(np.where(part == k, at, -1))]
        assert all(e - s >= passages.LENGTH for _, s, e in got) and all(x[2] < y[1] for x, y in zip(got, got[1:], strict=False) if x[0] == y[0])


def test_compact_windows_are_maximal():
    r = np.random.default_rng(4)
    h = np.concatenate([[0], r.integers(1, 2**63, 400), [0], r.integers(1, 2**63, 30), [0]]).astype(np.uint64) << np.uint64(1)
    c, l, rr = passages.compact_windows(h, 20, 400)
    got = set(zip(c.tolist(), l.tolist(), rr.tolist(), strict=True))
    want = set()
    for i in np.flatnonzero(h):
        a = b = i
        while h[a - 1] > h[i]:
            a -= 1
        while h[b + 1] > h[i]:
            b += 1
        if b - a + 1 >= 20:
            want.add((int(i), int(a), int(b)))
    assert got == want


def test_word_class():
    w = next(decontaminate.W.words(pa.array(["Ab_c-é1 \x7fZ"]), decontaminate.W.ALNUM_WORDS))
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == re.findall("[0-9A-Za-z\x80-\U0010ffff]+", "Ab_c-é1 \x7fZ")


def test_near_passages_are_found_where_a_smaller_document_holds_pieces(spark):
    """The smallest document holds the passage in overlapping pieces, the next one whole, the last one a near-copy."""
    texts, want, n = [], {}, 80
    for t in range(30):
        p = prose(70_000 + t, n).split()
        q = [*p]
        q[20 + t] = "edited"
        pieces = " ".join(f"{' '.join(p[a : a + 45])} {prose(80_000 + 10 * t + a, 12)}" for a in range(0, n - 22, 22))
        texts += [(3 * t, f"{prose(71_000 + t, 20)} {pieces}", "en"), (3 * t + 1, f"{prose(72_000 + t, 20)} {' '.join(p)} {prose(73_000 + t, 20)}", "en"), (3 * t + 2, f"{prose(74_000 + t, 20)} {' '.join(q)} {prose(75_000 + t, 20)}", "en")]
        want[3 * t + 2] = set(range(20, 20 + n))
    got = {r.doc: {x for s in r.spans for x in range(s.start, s.end)} for r in passages.duplicate_passages(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert sum(len(got.get(d, set()) & w) >= 0.9 * n for d, w in want.items()) >= 28
    assert all(len(got[d] - want.get(d, set())) <= 5 for d in got if d in want)
