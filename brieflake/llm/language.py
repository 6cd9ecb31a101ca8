"""Language identification by a string kernel.

Operator 7.  k(x, y) = |G(x) and G(y)| / sqrt(|G(x)| |G(y)|), where G(x) holds
the byte n-grams present in x (a blended spectrum of n = 2, 3, 4, hashed to
2**BITS places; letters in lower case, everything else a space).  Landmark texts
give Nystroem features, kernel ridge regression on them one score for each
language against the rest.  As the kernel is linear in presence, landmarks and
weights fold into one matrix of places x languages, and a batch of texts is
scored by one sparse presence matrix times that.

Fitting takes about SAMPLE texts with a known language, in equal parts of each,
and LANDMARKS of them.  Whole texts are read, on the executors; a text reaches the
driver as the 2**BITS bits of its n-grams, so what is collected is bounded by
SAMPLE whatever the texts' length.  A text that is null or has no letter is
``und`` with score 0; so is every text if nothing can be learned.  Rows may
repeat; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..ship import ship
from .samples import fold, sample
from .split import forget
from .store import arrow, free_names, limit_batches, table

BITS = 17
GRAMS = (2, 3, 4)
SAMPLE = 2400
LANDMARKS = 240
RIDGE = 1e-2
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_CLASS = np.full(256, 0x20, dtype=np.uint64)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # places x languages


def present(text: str, flags: np.ndarray) -> np.ndarray:
    """The places of the n-grams in a text, ascending.  ``flags``: 2**BITS False, left as they were."""
    b = _CLASS[np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)]
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    b = b[keep]
    code = b
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        if n in GRAMS:
            flags[((code + np.uint64(n << 40)) * _MULTIPLY) >> np.uint64(64 - BITS)] = True
    out = np.flatnonzero(flags)
    flags[out] = False
    return out


def fit(sets: list[np.ndarray], langs: list[str]) -> Model:
    """Places of texts in a fixed order; the first of each language become landmarks."""
    names = sorted(set(langs))
    marks = [i for lang in names for i in [k for k, x in enumerate(langs) if x == lang][: max(1, LANDMARKS // len(names))]]
    mark = np.zeros((1 << BITS, len(marks)), dtype=np.float32)
    for j, i in enumerate(marks):
        mark[sets[i], j] = 1 / np.sqrt(len(sets[i]))
    k_nm = np.stack([mark[s].sum(axis=0) / np.sqrt(len(s)) for s in sets]).astype(np.float64)
    values, vectors = np.linalg.eigh(k_nm[marks])
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # K_mm ** -1/2, up to a rotation
    phi = k_nm @ root
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    coef = np.linalg.solve(phi.T @ phi + RIDGE * len(sets) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, mark @ (root @ coef).astype(np.float32))


def score(model: Model, texts: list[str | None], flags: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Each text's language and how sure it is, 0 to 1."""
    out, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
    if not rows or not model.langs:
        return out, sure
    sets = [present(texts[i], flags) for i in rows]
    size = np.array([len(s) for s in sets])
    f = np.add.reduceat(model.weights[np.concatenate(sets)], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / np.sqrt(size)[:, None]
    best = f.argmax(axis=1)
    for k, i in enumerate(rows):
        out[i], sure[i] = model.langs[best[k]], min(1.0, max(0.0, (1 + float(f[k, best[k]])) / 2))
    return out, sure


def learn(docs: DataFrame) -> Model:
    """From the rows of docs (doc_id, text, lang) that have a language and a letter."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    got = sorted(tuple(r) for r in _present(sample(rows, "lang", SAMPLE, "doc_id")).collect())  # of a bounded size
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(r[2], np.uint8))).astype(np.int32) for r in got]
    return fit(sets, [r[0] for r in got]) if got else Model([], np.zeros((0, 0)))


def _present(rows: DataFrame) -> DataFrame:
    """lang, id and the places of each text that has a letter, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, dtype=bool)
        for b in batches:
            out = []
            for i, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if _LETTER.search(text):
                    bits = np.zeros(1 << BITS, dtype=bool)
                    bits[present(text, flags)] = True
                    out.append({"lang": lang, "id": i, "bits": np.packbits(bits).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("id", pa.int64()), ("bits", pa.binary())]))

    return arrow(rows.select(F.col("doc_id").cast("long"), "lang", "text"), run, "lang string, id long, bits binary")


def identified(docs: DataFrame, model: Model, pred: str = "lang_pred", sure: str = "lang_score") -> DataFrame:
    """docs with the columns ``pred`` and ``sure`` put on; columns of those names give way."""
    ship(docs.sparkSession)
    limit_batches(docs.sparkSession)
    got = docs.sparkSession.sparkContext.broadcast(model)

    # a scalar function: only texts go to Python and only answers come back
    @F.arrow_udf(StructType([StructField("lang", StringType()), StructField("sure", DoubleType())]))
    def told(texts: pa.Array) -> pa.Array:
        forget()
        flags = np.zeros(1 << BITS, dtype=bool)
        langs, scores = [], []
        for i in range(0, len(texts), 200):
            x, y = score(got.value, texts.slice(i, 200).to_pylist(), flags)
            langs += x
            scores.append(y)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang", "sure"])

    names, (got_name,) = [c for c in docs.columns if c.lower() not in (pred.lower(), sure.lower())], free_names(docs, "_told")
    out = docs.select(*(F.col(f"`{c}`") for c in names), told.asNondeterministic()("text").alias(got_name))
    return out.select(*(F.col(f"`{c}`") for c in names), F.col(f"{got_name}.lang").alias(pred), F.col(f"{got_name}.sure").alias(sure))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 4) != 2)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), learn(training_rows(docs)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


#: Below this share of certainty a document's language counts as unknown and the pipeline rejects it.
SURE = 0.4


def kept_languages(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """docs whose language is known: not ``und`` and at least ``sure``."""
    told, how = free_names(docs, "_lang", "_sure")
    out = identified(docs, learn(training_rows(docs)), told, how)
    return out.where(f"{told} <> '{UNKNOWN}' and {how} >= {sure}").select(*(F.col(f"`{c}`") for c in docs.columns))
