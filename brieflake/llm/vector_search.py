"""Exact top-k search with vector-approximation files.

Operator 1.  The table is written as blocks of up to BLOCK vectors: ids, exact
integer components, and a quantised cell of CELLS steps for each component, with
the block's cell borders.  A query scans the cells only: each component's cell
bounds what it can add to the inner product, so the cells give an upper and a
lower bound for every row.  Rows whose upper bound is under the k-th lower bound
are out; the rest are read in the order of their bounds until no unread row can
reach the k-th exact score.

Queries come in blocks too, and each meets each block of rows under a key of its
own, so no task gets more than one block of both at a time whatever the tables'
sizes; a task returns at most k rows for each of its queries.

Integer components are floor(scale * x).  Vectors that are null, empty, or hold
a null or non-finite component take no part; vectors of different lengths don't
meet.  Ties go to the smaller id.  Rows may repeat: rows with the query's own id
are never its answers.  A null id takes no part.  Integer components beyond
-LARGEST and LARGEST count as these.  Sums are exact; one that 64 bits can't hold
counts as the least or greatest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import arrow, table, written

BLOCK, QUERIES = 8192, 1024
CELLS = 16
FIRST = 32  # so many rows are read for every query before any is read alone
LARGEST = 1 << 60


def _blocks(rows: DataFrame, size: int, scale: int, approximate: bool) -> DataFrame:
    """rows (id, v) as blocks: block, dim, n, ids, exact (int64), and with ``approximate`` cells (uint8) and borders."""

    def pack(ids: np.ndarray, x: np.ndarray, number: int) -> dict:
        out = {"block": TaskContext.get().partitionId() * (1 << 32) + number, "dim": x.shape[1], "n": len(ids), "ids": ids.astype("<i8").tobytes(), "exact": x.astype("<i8").tobytes()}
        if approximate:
            lo, hi = x.min(axis=0), x.max(axis=0)
            step = np.maximum(1, -((lo - hi - 1) // CELLS))
            out |= {"cells": ((x - lo) // step).astype(np.uint8).tobytes(), "low": lo.astype("<i8").tobytes(), "step": step.astype("<i8").tobytes()}
        return out

    names = ["block", "dim", "n", "ids", "exact"] + ["cells", "low", "step"] * approximate
    kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * (len(names) - 3)
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        number = 0
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            off, values = lists.offsets.to_numpy().astype(np.int64), np.clip(np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64)), -LARGEST, LARGEST)
            dims = np.diff(off)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = values[off[at][:, None] + np.arange(d)].astype(np.int64)
                parts = held.setdefault(int(d), [])
                parts.append((ids[at], x))
                if sum(len(p[0]) for p in parts) >= size:
                    all_ids, all_x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    while len(all_ids) >= size:
                        yield pa.RecordBatch.from_pylist([pack(all_ids[:size], all_x[:size], number)], schema=schema)
                        all_ids, all_x, number = all_ids[size:], all_x[size:], number + 1
                    held[int(d)] = [(all_ids, all_x)]
        for parts in held.values():
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if len(ids):
                yield pa.RecordBatch.from_pylist([pack(ids, x, number)], schema=schema)
                number += 1

    return arrow(rows, run, "block long, dim int, n int, ids binary, exact binary" + ", cells binary, low binary, step binary" * approximate)


def search_block(q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of a block for each query: query places, ids, scores; and how many exact vectors were read."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] >= 2.0**62:
        return _large_block(q, q_ids, ids, x, k)
    lower = (low + cells.astype(np.int64) * step).astype(np.float64)
    upper = lower + (step - 1)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    most = up @ upper.T + down @ lower.T  # float64: exact below 2**53, and bounds get slack beyond
    least = up @ lower.T + down @ upper.T
    slack = np.abs(most).max(initial=0) * 2.0**-45 if np.abs(most).max(initial=0) >= 2.0**52 else 0.0
    own = q_ids[:, None] == ids[None, :]
    most[own], least[own] = -np.inf, -np.inf
    n, keep = len(ids), min(k, len(ids))
    sure = np.partition(least, n - keep, axis=1)[:, n - keep]  # the k-th lower bound
    out_q, out_id, out_s, reads = [], [], [], 0
    some = min(n, max(keep, FIRST))
    first = np.argpartition(-most, some - 1, axis=1)[:, :some]
    exact = np.einsum("qcd,qd->qc", x[first], q)
    reads += exact.size
    for i in range(len(q)):
        c, s = first[i], exact[i]
        ok = ~own[i, c]
        c, s = c[ok], s[ok]
        if not len(c):
            continue
        order = np.lexsort((ids[c], -s))[:keep]
        kth = s[order[-1]] if len(order) == keep else -np.inf
        edge = most[i, first[i]].min()
        if edge + slack >= max(kth, sure[i]) - slack or len(order) < keep:  # an unread row may still reach it
            more = np.flatnonzero(most[i] + slack >= max(kth, sure[i]) - slack)
            more = more[~np.isin(more, first[i]) & ~own[i, more]]
            more = more[np.argsort(-most[i, more], kind="stable")]
            for a in range(0, len(more), 256):
                part = more[a : a + 256]
                if len(order) == keep and most[i, part[0]] + slack < kth:
                    break
                reads += len(part)
                c, s = np.concatenate([c[order], part]), np.concatenate([s[order], x[part] @ q[i]])
                order = np.lexsort((ids[c], -s))[:keep]
                kth = s[order[-1]] if len(order) == keep else -np.inf
        out_q.append(np.full(len(order), i))
        out_id.append(ids[c[order]])
        out_s.append(s[order])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s), reads) if out_q else (none, none, none, 0)


def _large_block(q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """search_block where sums may pass 64 bits: every row in whole numbers of any size."""
    who, got, score = [], [], []
    rows = x.astype(object)
    for i in range(len(q)):
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), int(j)) for s, j in zip(rows @ q[i].astype(object), ids, strict=True) if j != q_ids[i])[:k]
        who += [i] * len(best)
        got += [j for _, j in best]
        score += [-s for s, _ in best]
    return np.array(who, dtype=np.int64), np.array(got, dtype=np.int64), np.array(score, dtype=np.int64), len(q) * len(x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` its k highest integer inner products with the rows of ``vectors``, not its own."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    rows = written(_blocks(clean(vectors), BLOCK, scale, True), "va-file")
    asked = written(_blocks(clean(queries).distinct(), QUERIES, scale, False).toDF("q_block", "dim", "q_n", "q_ids", "q_exact"), "va-queries")
    # numbers of blocks only: a row for each 8192 vectors; row blocks are dealt into shares and query blocks go to each, so no task makes all the pairs of a length
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mine = rows.select("block", "dim", F.pmod(F.hash("block"), F.lit(shares)).alias("share"))
    theirs = asked.select("q_block", "dim", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    meets = mine.join(theirs, ["dim", "share"]).select("block", "q_block").repartition(shares, "block", "q_block")
    pairs = meets.join(rows, "block").join(asked.drop("dim"), "q_block").select("ids", "exact", "cells", "low", "step", "dim", "q_ids", "q_exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, x, cells, low, step, d, q_ids, q = (b.column(i)[r].as_py() for i in range(8))
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                x, q = np.frombuffer(x, "<i8").reshape(-1, d), np.frombuffer(q, "<i8").reshape(-1, d)
                cells, low, step = np.frombuffer(cells, np.uint8).reshape(-1, d), np.frombuffer(low, "<i8"), np.frombuffer(step, "<i8")
                at = 64
                for a in range(0, len(q), at):
                    who, got, s, _ = search_block(q[a : a + at], q_ids[a : a + at], ids, x, cells, low, step, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a : a + at][who]), pa.array(got), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = arrow(pairs, run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


ORACLE = {
    "op1_vector_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::bigint as score
  from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 50 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5
"""
}
