"""Centroid clustering with partition-local ball trees.

Operator 13.  Each partition packs its vectors into blocks of up to BLOCK and
builds a metric tree over each: a ball has a centre, a radius, a count and the
integer sum of its vectors, and its vectors stand in a row.  The blocks are
written once.  A round sends the centroids, k x dim numbers, to every block.
From the root down, a ball drops the centroids that the triangle inequality shows
to be farther for all its vectors than another one; a ball that is left with one
centroid gives it its count and sum as a whole, and the others go on to their
halves, in the end to leaves, whose vectors are held against the centroids that
are left by exact integer distances.  A task returns k sums; their total is k x
dim numbers, from which the driver takes the floors of the means.

Integer components are floor(scale * x), x as double.  Vectors that haven't got
exactly ``dim`` components, or hold a null or non-finite one, take no part; null
vectors neither.  Ties in distance go to the smaller number.  The first centroids
are the k vectors with the smallest SHA-256 of "<seed>:<id>"; rows that share an
id come in the order of their vectors, rows with a null id (the least long counts as
one) come last.  With fewer vectors than k there are as many centroids as
vectors; without any there is no result.  Repeated rows are rows.  Sums and distances are exact: blocks whose
numbers could pass 2**53 are computed in whole numbers of any size, and components
beyond -LARGEST and LARGEST count as these, distances and inertias beyond 64 bits
as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, arrow, table, written

BLOCK, LEAF = 4096, 32
LARGEST = 1 << 60
_MOST = (1 << 63) - 1
#: Share by which a bound is taken wider than computed, so rounding can't decide.
SLACK = 1e-9


class Tree(NamedTuple):
    """Balls in the order of a heap: the halves of ball i are 2 i + 1 and 2 i + 2; ball i holds the vectors [start, end)."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def grown(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over the rows of x: each ball is cut at the median of its widest component until it holds no more than ``leaf``."""
    n = len(x)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    order = np.arange(n)
    start, end = np.zeros((2 << depth) - 1, dtype=np.int64), np.zeros((2 << depth) - 1, dtype=np.int64)
    end[0] = n
    f = x.astype(np.float64)
    for i in range((1 << depth) - 1):
        a, z = int(start[i]), int(end[i])
        mid = (a + z) // 2
        if z - a > 1:
            part = f[order[a:z]]
            by = part[:, int(np.argmax(part.max(axis=0) - part.min(axis=0)))]
            order[a:z] = order[a:z][np.argpartition(by, mid - a)]
        start[2 * i + 1], end[2 * i + 1], start[2 * i + 2], end[2 * i + 2] = a, mid, mid, z
    sums = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(f[order], axis=0)])
    many = np.maximum(1, end - start)[:, None]
    centre = (sums[end] - sums[start]) / many
    radius = np.zeros(len(start))
    for level in range(depth + 1):
        balls = np.arange((1 << level) - 1, (2 << level) - 1)
        size = end[balls] - start[balls]
        far = np.sqrt(((f[order] - np.repeat(centre[balls], size, axis=0)) ** 2).sum(axis=1))
        some = balls[size > 0]
        if len(some):
            radius[some] = np.maximum.reduceat(far, start[some])
    return Tree(order, start, end, centre, radius)


def _distances(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of z."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(z).max(initial=0)))
    if 4 * top * top * x.shape[1] < 2.0**53:
        f, g = x.astype(np.float64), z.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    y = x.astype(object)
    return np.stack([((y - c) ** 2).sum(axis=1) for c in z.astype(object)], axis=1) if len(y) else np.zeros((0, len(z)), dtype=object)


def filtered(t: Tree, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Which ball went whole to which centroid, and what is left: (ball, centroid) as two arrays, and the leaves with a mask of their centroids."""
    k, depth = len(z), (len(t.start) + 1).bit_length() - 2
    g = z.astype(np.float64)
    balls, left = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    whole, to, leaves = [], [], []
    noise = (float(np.abs(t.centre).max(initial=0)) + float(np.abs(g).max(initial=0))) * t.centre.shape[1] * 2.0**-50
    for level in range(depth + 1):
        d = np.sqrt(np.maximum(0, ((t.centre[balls][:, None, :] - g[None]) ** 2).sum(axis=2)))
        r = t.radius[balls][:, None]
        d[~left] = np.inf
        near = d.min(axis=1, keepdims=True)
        # a vector is at most near + r from one centroid and at least d - r from another
        left &= d - r <= (near + r) * (1 + SLACK) + SLACK * (1 + np.where(np.isfinite(d), d, 0)) + noise
        one = left.sum(axis=1) == 1
        whole.append(balls[one])
        to.append(left[one].argmax(axis=1))
        balls, left = balls[~one], left[~one]
        if level == depth:
            leaves = [(int(b), m) for b, m in zip(balls, left, strict=True)]
        else:
            balls, left = np.stack([2 * balls + 1, 2 * balls + 2], axis=1).ravel(), np.repeat(left, 2, axis=0)
    return np.concatenate(whole), np.concatenate(to), leaves


def nearest(x: np.ndarray, t: Tree, z: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each row's nearest centroid, rows in the tree's order, and how many rows were held against centroids one by one."""
    out = np.zeros(len(x), dtype=np.int32)
    whole, to, leaves = filtered(t, z)
    for b, c in zip(whole, to, strict=True):
        out[t.start[b] : t.end[b]] = c
    rows = np.concatenate([np.arange(t.start[b], t.end[b]) for b, _ in leaves]) if leaves else np.zeros(0, dtype=np.int64)
    if len(rows):
        left = np.repeat(np.stack([m for _, m in leaves]), [t.end[b] - t.start[b] for b, _ in leaves], axis=0)
        d = _distances(x[rows], z)
        d = np.where(left, d, _MOST if d.dtype != object else 1 << 200)
        out[rows] = d.argmin(axis=1)
    return out, len(rows)


def _whole(v: np.ndarray, kind: str = "<i8") -> bytes:
    return v.astype(kind).tobytes()


def _blocks(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """rows (row, v) as blocks: n, kind (bytes a component), rows and vectors in the tree's order, and the tree: centres, radii, starts, ends, sums."""
    names = ["n", "kind", "rows", "exact", "centre", "radius", "start", "end", "sums"]
    schema = pa.schema([("n", pa.int32()), ("kind", pa.int32())] + [(c, pa.binary()) for c in names[2:]])

    def packed(ids: list, x: np.ndarray) -> pa.RecordBatch:
        t = grown(x)
        x, ids = x[t.order], np.concatenate(ids)[t.order]
        top = int(np.abs(x).max(initial=0))
        kind = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        sums = np.concatenate([np.zeros((1, dim), dtype=np.int64), np.cumsum(x, axis=0)]) if top * len(x) < 1 << 62 else None
        sums = b"" if sums is None else _whole(sums[t.end] - sums[t.start])
        return pa.RecordBatch.from_pylist([dict(zip(names, (len(x), kind, _whole(ids), _whole(x, f"<i{kind}"), _whole(t.centre, "<f8"), _whole(t.radius, "<f8"), _whole(t.start), _whole(t.end), sums), strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, many = [], [], 0
        for b in batches:
            v = b.column(1)
            x = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
            x = np.clip(x, -LARGEST, LARGEST).astype(np.int64)
            for a in range(0, len(x), BLOCK):
                ids.append(b.column(0).to_numpy()[a : a + BLOCK])
                parts.append(x[a : a + BLOCK])
                many += len(parts[-1])
                if many >= BLOCK:
                    yield packed(ids, np.concatenate(parts))
                    ids, parts, many = [], [], 0
        if many:
            yield packed(ids, np.concatenate(parts))

    return arrow(rows, run, "n int, kind int, rows binary, exact binary, centre binary, radius binary, start binary, end binary, sums binary")


def _opened(b: pa.RecordBatch, i: int, dim: int) -> tuple[np.ndarray, np.ndarray, Tree, np.ndarray | None]:
    get = lambda c: b.column(c)[i].as_py()
    x = np.frombuffer(get("exact"), f"<i{get('kind')}").reshape(-1, dim).astype(np.int64)
    tree = Tree(np.arange(len(x)), np.frombuffer(get("start"), "<i8"), np.frombuffer(get("end"), "<i8"), np.frombuffer(get("centre"), "<f8").reshape(-1, dim), np.frombuffer(get("radius"), "<f8"))
    sums = get("sums")
    return np.frombuffer(get("rows"), "<i8"), x, tree, np.frombuffer(sums, "<i8").reshape(-1, dim) if sums else None


def _sums(blocks: DataFrame, z: np.ndarray, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each centroid's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(z), dim), dtype=object), np.zeros(len(z), dtype=np.int64)
        for b in batches:
            for i in range(b.num_rows):
                _, x, t, sums = _opened(b, i, dim)
                whole, to, leaves = filtered(t, z)
                if sums is None:
                    who, _ = nearest(x, t, z)
                    for c in range(len(z)):
                        total[c] += x[who == c].astype(object).sum(axis=0) if (who == c).any() else 0
                    count += np.bincount(who, minlength=len(z))
                    continue
                part = np.zeros((len(z), dim), dtype=np.int64)
                np.add.at(part, to, sums[whole])
                np.add.at(count, to, (t.end - t.start)[whole])
                if leaves:
                    rows = np.concatenate([np.arange(t.start[l], t.end[l]) for l, _ in leaves])
                    left = np.repeat(np.stack([m for _, m in leaves]), [t.end[l] - t.start[l] for l, _ in leaves], axis=0)
                    d = _distances(x[rows], z)
                    who = np.where(left, d, _MOST if d.dtype != object else 1 << 200).argmin(axis=1)
                    np.add.at(part, who, x[rows])
                    count += np.bincount(who, minlength=len(z))
                total += part
        at, col = np.divmod(np.arange(len(z) * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(col, pa.int32()), pa.array(count[at]), pa.array([str(v) for v in total.ravel()])], names=["cluster", "at", "n", "total"])

    parts = arrow(blocks, run, "cluster int, at int, n long, total string")
    # k x dim numbers
    got = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("cluster", "at").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in got:
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.total))
    return out


def _assigned(blocks: DataFrame, z: np.ndarray, dim: int) -> DataFrame:
    """(row, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, x, t, _ = _opened(b, i, dim)
                who, _ = nearest(x, t, z)
                d = np.zeros(len(x), dtype=np.int64)
                for c in np.unique(who):
                    d[who == c] = np.minimum(_distances(x[who == c], z[c : c + 1])[:, 0], _MOST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(who), pa.array(d)], names=["row", "cluster", "distance"])

    return arrow(blocks, run, "row long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector with ``dim`` finite components."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{vector_col}`").isNotNull() & (F.size(f"`{vector_col}`") == dim) & ok).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = rows.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()  # k rows
    out = "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    z = np.stack([np.clip(np.floor(scale * np.array(r.v, dtype=np.float64)), -LARGEST, LARGEST).astype(np.int64) for r in starts])
    with Scratch(spark) as to:
        # blocks hold numbers alone: the least long stands for a null id
        nulls = F.when(F.col("id").isNull(), F.lit(-(1 << 63))).otherwise(F.col("id"))
        blocks = to.keep(_blocks(rows.select(nulls.alias("row"), "v"), dim, scale), "ball-trees")
        for _ in range(rounds):
            for c, (n, total) in _sums(blocks, z, dim).items():
                if n:
                    z[c] = [t // n for t in total]
        last = written(_assigned(blocks, z, dim), "clusters")
    sums = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    cut = lambda s: min(int(s), _MOST)
    whole = cut(sum(int(r.s) for r in sums))
    facts = [(r.cluster, cut(r.s), whole, hashlib.sha256(",".join(map(str, z[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    row = F.nullif("row", F.lit(-(1 << 63)))
    return last.join(F.broadcast(told), "cluster").select(row.alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_ball_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 3, k: int = 16) -> str:
    parts = [
        "v0 as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as (select row_number() over (order by sha256('1:' || vec_id) nulls last, e) - 1 as cluster, e from v0 qualify row_number() over (order by sha256('1:' || vec_id) nulls last, e) <= {k})",
    ]
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::bigint"
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select row, vec_id, e, cluster, distance from (select v.row, v.vec_id, v.e, c.cluster, {square} as distance from v0 v, c{r} c) qualify row_number() over (partition by row order by distance, cluster) = 1)")
        if r < rounds:
            parts.append(f"s{r} as (select cluster, i, sum(e[i])::bigint as s, count(*)::bigint as n from a{r}, range(1, 65) t(i) group by cluster, i)")
            parts.append(f"c{r + 1} as materialized (select c.cluster, coalesce((select list((s - ((s % n) + n) % n) // n order by i) from s{r} x where x.cluster = c.cluster), c.e) as e from c{r} c)")
    return f"with {', '.join(parts)} select a.vec_id, a.cluster::integer as cluster, a.distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia, sha256(array_to_string(c.e, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.cluster = a.cluster"


ORACLE = {"op13_ball_trees": _sql()}
