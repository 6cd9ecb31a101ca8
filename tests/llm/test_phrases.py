"""Phrase collocations against counting every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from brieflake.llm import phrases as P


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = {q for p, a in cand.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if a >= cand.get(q := (p[0], *p[i : i + k]), 1 << 60)}
    rows = []
    for p, a in cand.items():
        if p in covered:
            continue
        lang, w = p[0], p[1:]
        cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        rows.append((lang, -score, -a, " ".join(w).encode(), l, r))
    out, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(rows):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["a", "B", "cé", "d-d", "漢", "e", "f", "\x1c", "x\xa0y", "\U0001f642"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ",", "\r\n", "\x0c"]) for _ in range(r.randint(0, 60)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), ("en", " \t.;"), (None, "A a A a A a a a a"), ("en", "the same words here " * 30), ("en", "the same words here " * 30), ("xx", None)]


@pytest.mark.parametrize("bucket,held", [(P.BUCKET, P.HELD), (50, 120)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting(spark, monkeypatch, seed, bucket, held):
    rows = texts(seed)
    df = spark.createDataFrame([(lang, t, 1, "w", 2) for lang, t in rows], "lang string, text string, bucket int, word string, id int").repartition(3)
    monkeypatch.setattr(P, "BUCKET", bucket)
    monkeypatch.setattr(P, "HELD", held)
    for least, longest, top in ((5, 5, 2000), (3, 4, 7)):
        got = sorted(tuple(r) for r in P.collocations(df, least, longest, top).collect())
        assert got == sorted(brute(rows, least, longest, top)) and (got or least > 3)


def test_products_past_64_bits(spark):
    df = spark.createDataFrame([(1 << 40, 3 * (1 << 40), [1 << 41, 1 << 40], [1 << 40, 1 << 40])], "f long, n long, heads array<long>, tails array<long>")
    r = df.select(P._scored(*map(P.F.col, ("f", "n", "heads", "tails")), 5).alias("c")).first().c
    assert (r.score, r.k, r.l, r.r) == (1000 * (1 << 40) * 3 * (1 << 40) // ((1 << 41) * (1 << 40)), 1, 1 << 41, 1 << 40)


def test_empty(spark, no_docs):
    assert P.collocations(no_docs).collect() == []
