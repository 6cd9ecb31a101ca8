"""Toxicity by a subsequence string-kernel support vector machine.

Operator 10.  A text's segments are its words (and runs of single characters set
apart by spaces, read as one word), in lower case, reduced to letters and marked at both
ends.  The kernel of two segments counts the subsequences of ORDER letters
that they share, each occurrence weighted by DECAY to the length it spans (at
most SPAN), so gaps and inserted characters cost a factor and not the match;
it is normalised by a function of each segment's length.  Nystroem features on
landmark segments carry a linear support vector machine.  As the kernel is
linear in subsequence counts, landmarks and weights fold into one table of
32**ORDER entries, and a batch of segments is scored by lookups.

Labels are of whole texts, so the machine is trained on their segments with the
segments that give a toxic text away found in turns: first those whose stems
(prefixes of four letters and more, and whole words) are far commoner in toxic texts, then the
highest-scoring ones.  A text's score is a logistic function of the best and the
mean of its highest segment decisions.

Fitting takes about SAMPLE labelled texts in equal parts of both labels,
reweighted to their true shares; fewer, in proportion, if together they have more
than SAMPLE_BYTES.  Of each, its distinct segments reach the driver.  A null, empty or wordless text has no segment
and gets the score of that.  With no labels every score is 0.5; with one kind of
label it is that label's share.  Rows may repeat; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .samples import fold, sample
from .split import Remembered
from .store import arrow, table

SAMPLE, SAMPLE_BYTES = 8000, 256 << 20
ORDER, SPAN, DECAY = 4, 7, 0.7
LANDMARKS = 384
INSERTED = 16  # so many of the commonest toxic segments are also learned with a letter put in
LONGEST = 40  # a longer segment is scored in overlapping stretches of this length
REMEMBER = 150_000  # words, in each of two generations

END, OTHER = "\x7f", "{|}~"
_SPACED = regex.compile(r"(?<!\S)\S(?: \S(?!\S)){3,}")



def normal(word: str) -> str:
    """^word$ over 31 signs: a to z, four classes of other letters, and the word's ends; anything else is dropped."""
    return END + "".join([c if "a" <= c <= "z" else OTHER[ord(c) % 4] if c.isalpha() and c > "\x7f" else "" for c in word]) + END


def segments(text: str) -> set[str]:
    """The distinct words of a text in lower case, as they stand."""
    low = text.lower()
    out = set(low.split())
    if " " in low:
        out.update(m.group().replace(" ", "") for m in _SPACED.finditer(low))
    return out


_combos: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def combos(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a segment of n letters, and their weights."""
    if n not in _combos:
        import itertools

        rel = [(0, *c) for c in itertools.combinations(range(1, SPAN), ORDER - 1)]
        rows = [tuple(i + x for x in r) for i in range(n) for r in rel if i + r[-1] < n]
        at = np.array(rows, dtype=np.int64).reshape(len(rows), ORDER)
        _combos[n] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1 - ORDER)) if len(rows) else np.zeros(0)
    return _combos[n]


def _codes(words: list[str]) -> np.ndarray:
    return (np.frombuffer("".join(words).encode("ascii"), dtype=np.uint8).astype(np.int64) - 96).reshape(len(words), -1)


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length: table places of their subsequences (words x subsequences) and normalised weights."""
    c = _codes(words)
    at, weight = combos(c.shape[1])
    p = c[:, at[:, 0]]
    for k in range(1, ORDER):
        p = p * 32 + c[:, at[:, k]]
    return p, weight / max(1e-9, np.sqrt((weight**2).sum()))


def _stretches(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def decisions(words: list[str], table_: np.ndarray, bias: float) -> np.ndarray:
    """Each normalised word's decision: of its stretches the highest.  Shorter than ORDER signs: -1.  Clipped to [-1, 1]."""
    out = np.full(len(words), -1.0)
    by: dict[int, list[tuple[int, str]]] = {}
    for i, w in enumerate(words):
        if len(w) >= ORDER:
            for s in _stretches(w):
                by.setdefault(len(s), []).append((i, s))
    for group in by.values():
        for a in range(0, len(group), 4096):
            part = group[a : a + 4096]
            p, weight = _places([s for _, s in part])
            np.maximum.at(out, [i for i, _ in part], np.clip(table_[p] @ weight.astype(np.float32) + bias, -1.0, 1.0))
    return out


class Model(NamedTuple):
    table: np.ndarray
    bias: float
    weights: tuple[float, float, float]  # constant, best, mean of the three highest


def _kernel(words: list[str], marks: list[str]) -> np.ndarray:
    out = np.zeros((len(words), len(marks)))
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for j, m in enumerate(marks):
        t = np.zeros(32**ORDER, dtype=np.float32)
        p, weight = _places([m])
        np.add.at(t, p[0], weight)
        for rows in by.values():
            p, weight = _places([words[i] for i in rows])
            out[rows, j] = t[p] @ weight.astype(np.float32)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 15) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss, by dual coordinate descent in a fixed order; the bias is a constant feature."""
    x = np.hstack([x, np.ones((len(x), 1))])
    alpha, w, square = np.zeros(len(x)), np.zeros(x.shape[1]), (x**2).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / square[i], 0.0), cost[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def _inserted(words: list[str]) -> list[str]:
    """Variants of words (with their end marks) with one more letter inside, at each place."""
    return [w[:i] + chr(97 + (7 * i + 13 * len(w)) % 26) + w[i:] for w in words for i in range(2, len(w) - 1)]


def _machine(bad: list[str], good: list[str], often: Counter) -> tuple[np.ndarray, float]:
    marks = bad[: LANDMARKS // 2]
    marks = marks + good[: LANDMARKS - len(marks)]
    values, vectors = np.linalg.eigh(_kernel(marks, marks))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    x = _kernel(bad + good, marks) @ root
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    w, bias = _svm(x, y, np.array([10.0 * (1 + np.log(max(1, often[w]))) for w in bad] + [10.0] * len(good)))
    beta = root @ w
    out = np.zeros(32**ORDER, dtype=np.float64)
    for m, b in zip(marks, beta, strict=True):
        p, weight = _places([m])
        np.add.at(out, p[0], weight * b)
    return out.astype(np.float32), bias


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _summary(values: np.ndarray) -> tuple[float, float]:
    top = np.sort(values)[::-1][:3] if len(values) else np.array([-1.0])
    return float(top[0]), float(np.concatenate([top, np.full(3 - len(top), -1.0)]).mean())


def _stems(word: str) -> set[str]:
    return {word[:n] for n in range(ORDER + 1, min(len(word), 12) + 1)} | {word}


def learnable(text: str | None) -> list[str]:
    """A text's distinct normalised segments that are long enough to hold a subsequence."""
    return sorted({s for s in map(normal, segments(text or "")) if len(s) > ORDER})


def fit(texts: list[str], labels: list[int], weight: np.ndarray) -> Model:
    return fit_segments([learnable(t) for t in texts], labels, weight)


def fit_segments(words: Iterable[list[str]], labels: list[int], weight: np.ndarray) -> Model:
    """The segments of texts in a fixed order; weight: what each row counts for the calibration."""
    y = np.array(labels, dtype=np.float64)
    blank = Model(np.zeros(32**ORDER, dtype=np.float32), -1.0, (0.0, 0.0, 0.0))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return blank._replace(weights=(float(np.log(share / (1 - share))), 0.0, 0.0))
    pool: dict[str, str] = {}  # one copy of each word, however many texts hold it
    words = [[pool.setdefault(s, s) for s in ws] for ws in words]
    in_bad, in_good, stem_bad, stem_good = Counter(), Counter(), Counter(), Counter()
    for ws, v in zip(words, labels, strict=True):
        (in_bad if v else in_good).update(ws)
        (stem_bad if v else stem_good).update({s for w in ws for s in _stems(w)})
    n_bad, n_good = int(y.sum()), int(len(y) - y.sum())

    def lift(bad: int, good: int) -> float:
        return ((bad + 0.2) / (n_bad + 1)) / ((good + 0.2) / (n_good + 1))

    least = max(3, n_bad // 40)
    telling = {s for s, n in stem_bad.items() if n >= least and lift(n, stem_good[s]) > 12}
    bad: list[str] = []
    for ws, v in zip(words, labels, strict=True):
        if v:
            bad += [w for w in ws if _stems(w) & telling and lift(in_bad[w], in_good[w]) > 3]
    bad = [w for w, _ in sorted(Counter(bad).items(), key=lambda x: (-x[1], x[0]))][:800]
    if not bad:
        bad = [w for w, n in sorted(in_bad.items(), key=lambda x: (-lift(x[1], in_good[x[0]]), x[0]))][:20]
    if not bad:
        return blank._replace(weights=(float(np.log(y.mean() / (1 - y.mean()))), 0.0, 0.0))
    bad += [v for v in _inserted(bad[:INSERTED]) if v not in in_good]
    chosen = set(bad)
    spread = sorted(w for w in in_good if w not in chosen)
    good = spread[:: max(1, len(spread) // 3000)]
    near = sorted((w for w in in_good if w not in chosen and in_good[w] > 1), key=lambda w: (-in_good[w], w))[:1000]
    good = sorted(set(good) | set(near))
    good = [good[i] for i in np.random.default_rng(3).permutation(len(good))]
    table_, bias = _machine(bad, good, in_bad)
    every = sorted({w for ws in words for w in ws})
    for _ in range(2):  # words of clean texts that look toxic are learned as clean
        of = dict(zip(every, decisions(every, table_, bias), strict=True))
        hard = [w for w in every if of[w] > -0.5 and w not in chosen and in_good[w]][:2000]
        good = hard + [w for w in good if w not in set(hard)]
        table_, bias = _machine(bad, good, in_bad)
    of = dict(zip(every, decisions(every, table_, bias), strict=True))
    x = np.array([_summary(np.array([of[w] for w in ws])) for ws in words])
    w = _logistic(x, y, weight)
    return Model(table_, bias, (float(w[0]), float(w[1]), float(w[2])))


class Scorer:
    """Scores texts, remembering the decisions of words."""

    def __init__(self, model: Model):
        self.model, self.memory = model, Remembered(REMEMBER)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        sets = [segments(t) if t else () for t in texts]
        get = self.memory.of(set().union(*sets), lambda new: decisions([normal(w) for w in new], self.model.table, self.model.bias).tolist())
        x = np.array([_summary(np.fromiter(map(get, s), dtype=np.float64, count=len(s))) for s in sets]).reshape(len(sets), 2)
        a, b, c = self.model.weights
        return 1 / (1 + np.exp(-np.clip(a + x @ np.array([b, c]), -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """From labels (doc_id, label 0/1) of docs (doc_id, text)."""
    rows = labels.where(f"{label} in (0, 1) and doc_id is not null").select("doc_id", F.col(label).cast("int").alias("y"))
    true = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}

    def chosen(bound: int) -> DataFrame:
        return docs.select("doc_id", "text").join(F.broadcast(sample(rows, "y", bound, "doc_id")), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")  # of a bounded size

    size = chosen(bound).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = chosen(bound if size <= SAMPLE_BYTES else max(1, bound * SAMPLE_BYTES // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array([" ".join(learnable(t)) for t in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words], names=["doc_id", "y", "words"])

    got = sorted(tuple(r) for r in arrow(texts, run, "doc_id long, y int, words string").collect())
    y = [r[1] for r in got]
    weight = np.ones(len(y))
    for v, n in true.items():
        if v in y:
            weight[np.array(y) == v] = n / y.count(v)
    return fit_segments((r[2].split() for r in got), y, weight / weight.mean() if len(y) else weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs."""
    got = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(got.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s(part.column(1).to_pylist()))], names=["doc_id", "score"])

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs, learn(docs, labels.where(fold("doc_id", 5) != 0)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
