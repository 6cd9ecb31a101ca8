"""Quality classifier: a generalised additive model with pairwise interactions.

Operator 3.  Features of the whole text are cut into bins.  Cyclic boosting
visits the features in turn, each time fitting a shallow tree on one feature's
bins to the gradient of the log loss and adding it to that feature's lookup
table; then likewise on the pairs of features that explain most of what is
left.  A score is the logistic of a sum of table entries, added up for a batch
of texts at once.

Fitting takes about SAMPLE labelled rows in equal parts of both labels,
reweighted to their true shares.  A null text counts as empty; empty texts get
the score of their features.  Labels that are null teach nothing, repeated
labels each count.  With no labels every score is 0.5; with one kind of label it
is that label's.  Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .samples import fold, sample
from .store import arrow, table

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "stops", "marks", "space", "lines", "distinct", "top_word", "same_again",
    "short_words", "beyond_ascii", "bars", "distinct_pairs", "repeated_lines", "odd_ends", "long_words",
)


def _of(chars: bytes) -> np.ndarray:
    return np.frombuffer(chars, dtype=np.uint8).astype(np.int64)


_UPPER, _DIGIT, _SYMBOL, _STOP, _MARK, _SPACE = _of(bytes(range(65, 91))), _of(b"0123456789"), _of(b"#$%&*@^~+=<>{}[]\\/_`"), _of(b".,;:"), _of(b"!?"), _of(b" \t\n\r\x0b\x0c")
_LETTER = _of(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_ODD = np.zeros(256, dtype=bool)
_ODD[_of(b"#$%&*!@^~|?")] = True


def features(col: pa.Array) -> np.ndarray:
    """texts x NAMES."""
    rows = []
    for w in W.words(col, W.SPACE_WORDS, 1 << 20):
        length, odd = w.end - w.start, _ODD[w.data[w.end - 1]]
        for i in range(len(w.ptr) - 1):
            a, z, lo, hi = w.ptr[i], w.ptr[i + 1], int(w.text_at[i]), int(w.text_at[i + 1])
            h, size, n, raw = w.hashes[a:z], length[a:z], z - a, w.data[lo:hi]
            many = np.bincount(raw, minlength=256)
            bytes_, letters, words = max(1, hi - lo), max(1, int(many[_LETTER].sum())), max(1, n)
            counts = np.unique(h, return_counts=True)[1] if n else np.zeros(1)
            pairs = np.unique(h[1:] * np.uint64(3) + h[:-1]) if n > 1 else h
            lines = raw.tobytes().split(b"\n")
            rows.append((
                np.log1p(hi - lo), np.log1p(n), size.sum() / words, many[_UPPER].sum() / letters, many[_DIGIT].sum() / bytes_, many[_SYMBOL].sum() / bytes_, many[_STOP].sum() / words, many[_MARK].sum() / words, many[_SPACE].sum() / bytes_,
                1000 * len(lines) / bytes_, len(counts) / words, counts.max() / words, (h[1:] == h[:-1]).sum() / words, (size <= 2).sum() / words, many[128:].sum() / letters, many[124] / words, len(pairs) / words, 1 - len(set(lines)) / len(lines), odd[a:z].sum() / words, (size > 12).sum() / words,
            ))
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(NAMES))


class Model(NamedTuple):
    edges: list[np.ndarray]  # of each feature's bins
    coarse: list[np.ndarray]  # of each feature's wider bins, for pairs
    base: float
    tables: np.ndarray  # features x BINS
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # pairs x PAIR_BINS x PAIR_BINS


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), dtype=np.int64)


def raw_scores(m: Model, x: np.ndarray) -> np.ndarray:
    fine, wide = _bins(x, m.edges), _bins(x, m.coarse)
    out = m.base + m.tables[np.arange(len(m.edges)), fine].sum(axis=1)
    for k, (i, j) in enumerate(m.pairs):
        out += m.pair_tables[k, wide[:, i], wide[:, j]]
    return out


def scores(m: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw_scores(m, x), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 5.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins with gradients g and curvatures h: each bin's leaf value."""
    out = np.zeros(len(g))

    def grow(a: int, z: int, d: int) -> None:
        sg, sh = g[a:z].sum(), h[a:z].sum()
        if d and z - a > 1:
            left_g, left_h = np.cumsum(g[a:z])[:-1], np.cumsum(h[a:z])[:-1]
            gain = left_g**2 / (left_h + 5) + (sg - left_g) ** 2 / (sh - left_h + 5) - sg**2 / (sh + 5)
            at = int(gain.argmax())
            if gain[at] > 1e-6:
                grow(a, a + at + 1, d - 1)
                grow(a + at + 1, z, d - 1)
                return
        out[a:z] = _step(sg, sh)

    grow(0, len(g), depth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts both features once: leaf values of the grid, and what it gains."""
    best, out = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    n = len(g)
    for a in range(n - 1):
        for b in range(n - 1):
            qg = np.array([cg[a, b], cg[a, -1] - cg[a, b], cg[-1, b] - cg[a, b], cg[-1, -1] - cg[a, -1] - cg[-1, b] + cg[a, b]])
            qh = np.array([ch[a, b], ch[a, -1] - ch[a, b], ch[-1, b] - ch[a, b], ch[-1, -1] - ch[a, -1] - ch[-1, b] + ch[a, b]])
            gain = float((qg**2 / (qh + 5)).sum())
            if gain > best:
                best, v = gain, _step(qg, qh)
                out = np.zeros_like(g)
                out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = v
    return out, best


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    def edges(n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(NAMES))]

    m = Model(edges(BINS), edges(PAIR_BINS), 0.0, np.zeros((len(NAMES), BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    total = weight.sum()
    if not total:
        return m
    p0 = min(max(float((weight * y).sum() / total), 0.001), 0.999)
    m = m._replace(base=float(np.log(p0 / (1 - p0))))
    if y.min() == y.max():
        return m
    fine, wide = _bins(x, m.edges), _bins(x, m.coarse)
    f = np.full(len(y), m.base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(len(NAMES)):
            g, h = gradients()
            leaf = RATE * _tree(np.bincount(fine[:, j], g, BINS), np.bincount(fine[:, j], h, BINS))
            m.tables[j] += leaf
            f += leaf[fine[:, j]]

    def grid(i: int, j: int, g: np.ndarray) -> np.ndarray:
        return np.bincount(wide[:, i] * PAIR_BINS + wide[:, j], g, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = gradients()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(len(NAMES)) for j in range(i)), reverse=True)[:PAIRS]
    pairs = [(i, j) for _, i, j in gains]
    tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            g, h = gradients()
            leaf = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[0]
            tables[k] += leaf
            f += leaf[wide[:, i], wide[:, j]]
    return m._replace(pairs=pairs, pair_tables=tables)


def _featured(rows: DataFrame) -> DataFrame:
    """doc_id, y and features of rows (doc_id, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return arrow(rows.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text"), run, "doc_id long, y int, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> Model:
    """From labels (doc_id, label 0/1) of docs (doc_id, text)."""
    rows = labels.where(f"{label} in (0, 1) and doc_id is not null").select("doc_id", F.col(label).cast("int").alias("y"))
    true = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    some = F.broadcast(sample(rows, "y", bound, "doc_id"))  # of a bounded size
    got = sorted((r["doc_id"], r["y"], r["x"]) for r in _featured(docs.select("doc_id", "text").join(some, "doc_id")).collect())
    y = np.array([r[1] for r in got], dtype=np.float64)
    x = np.array([r[2] for r in got], dtype=np.float64).reshape(len(got), len(NAMES))
    weight = np.ones(len(y))
    for v, n in true.items():
        if (y == v).any():
            weight[y == v] = n / (y == v).sum()
    return fit(x, y, weight * (len(y) / weight.sum()) if len(y) else weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs."""
    got = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(got.value, features(b.column(1))))], names=["doc_id", "score"])

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, learn(docs, labels.where(fold("doc_id", 5) != 0)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
