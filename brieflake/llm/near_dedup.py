"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges, links confirmed on full sets.

Operator 2.  A text's set is that of its distinct word shingles.  Two texts are
linked if 100 * |A and B| >= percent * |A or B|.

How pairs stay bounded, and links whole:

1. Texts with the same set are one class; copies are never paired.
2. Each class gets one signature (BINS bins of one permutation; an empty bin
   borrows from a bin that its own probe sequence meets first), cut into bands.
3. A bucket's classes point at its smallest one (a star).  Each class is
   compared with the centre that it shares most buckets with, then, where the
   two are still apart, with its other centres.
4. Where a bucket still holds more than one component, what stands outside its
   largest component may yet be linked to something in it.  In buckets of up to
   SMALL classes those are paired with all the others.  In larger ones an exact
   prefix filter finds the partners: members are ranked by how rare they are,
   and a pair of sizes x and y that is linked must share a member among the
   x - a + 1 rarest of one and the y - a + 1 rarest of the other, where a is the
   overlap that a link of these sizes needs.  Either way a bitmap of BITS bits
   for each class bounds the overlap from above (a bit that only one has stands
   for a member that the other lacks), and what can't reach a is left out before
   sets are fetched; the prefix filter's join looks at the bitmap folded to FOLDED
   words first.
   So every pair that shares a bucket is compared, proved apart, or already in
   one component; no bucket is capped.

A pair of similarity 0.8 shares no bucket with probability (1 - 0.8^6)^42 =
3e-6; a more alike pair far more rarely.

A set is named by 128 bits and a class by its number in the written table of
classes.  Each step's table is deleted when its last reader is done.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .components import components, joined
from .split import forget
from .store import Scratch, arrow, free_names, table, written

BINS, ROWS, BANDS = 256, 6, 42
SMALL = 24
BITS, FOLDED = 2048, 8
_PROBES = 2048


def _probe_table() -> np.ndarray:
    """probe[j, t]: the bin that bin j, if empty, tries at attempt t."""
    j, t = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(_PROBES, dtype=np.uint64), indexing="ij")
    return (W.mix(j * np.uint64(1_000_003) + t + np.uint64(77)) & np.uint64(BINS - 1)).astype(np.int16)


_probe: np.ndarray | None = None


def signature(s: np.ndarray) -> np.ndarray:
    """Of a sorted set of uniform 64-bit hashes: per bin (the top bits) the smallest hash, empty bins densified."""
    global _probe
    if _probe is None:
        _probe = _probe_table()
    bins = (s >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    sig = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    sig[bins[first]] = s[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    depth = 32
    while len(empty):
        hit = full[_probe[empty, :depth]]
        found = hit.any(axis=1)
        sig[empty[found]] = sig[_probe[empty[found], hit[found].argmax(axis=1)]]
        empty = empty[~found]
        if depth == _PROBES:  # hardly ever: then the next full bin round the circle
            at = np.flatnonzero(full)
            sig[empty] = sig[at[np.searchsorted(at, empty) % len(at)]]
            break
        depth = min(_PROBES, depth * 8)
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        acc = W.mix(acc + rows[:, r])
    return acc


def _sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    for w in W.words(col, W.SPACE_WORDS, W.CHUNK):
        h, ptr = W.shingles(w, n)
        for i in range(len(ptr) - 1):
            yield np.unique(h[ptr[i] : ptr[i + 1]])


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: its members, mixed in two ways and added up."""
    x = [np.add.reduce(W.mix(s ^ np.uint64(k)), dtype=np.uint64) + np.uint64(len(s)) for k in (0x5851F42D4C957F2D, 0xA0761D6478BD642F)]
    return tuple(W.mix(np.array(x)).view(np.int64).tolist())


def _bitmap(s: np.ndarray) -> np.ndarray:
    at = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)
    out = np.zeros(BITS // 64, dtype=np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _may_link(x: str, y: str, percent: int) -> str:
    """That sizes and bitmaps (size_x, bits_x and so on) allow a link."""
    lacks = lambda p, q: f"aggregate(zip_with(bits_{p}, bits_{q}, (i, j) -> cast(bit_count(i & ~j) as int)), 0, (n, v) -> n + v)"
    need = f"ceil({percent} * (size_{x} + size_{y}) / {100 + percent})"
    return f"(least(size_{x}, size_{y}) >= {need} and size_{x} - {lacks(x, y)} >= {need} and size_{y} - {lacks(y, x)} >= {need})"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, set_a, set_b, bands) for each row; the set's name and bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            size, name, out = [], [], []
            for s in _sets(b.column(2), n):
                size.append(len(s))
                name.append(_set_hash(s) if len(s) else (None, None))
                out.append(bands(signature(s)) if len(s) else np.zeros(0, dtype=np.uint64))
            names = [pa.array([x[i] for x in name], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), *names, _lists(out)], names=["id", "text_hash", "n_shingles", "set_a", "set_b", "bands"])

    return arrow(_rows(docs, id_col, text_col), run, "id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _full_sets(docs: DataFrame, need: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, size, bits, set) of the nodes in ``need`` (id, text_hash, node, set_a, set_b): from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, out = [], []
            for k, x, y, s in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), _sets(b.column(1), n), strict=True):
                if len(s) and _set_hash(s) == (x, y):  # ids may repeat with other texts
                    node.append(k)
                    out.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(map(len, out), pa.int64()), _lists([_bitmap(x) for x in out]), _lists(out)], names=["node", "size", "bits", "set"])

    found = _rows(docs, id_col, text_col).join(need, ["id", "text_hash"]).dropDuplicates(["node"]).select("node", "text", "set_a", "set_b")
    return arrow(found, run, "node long, size long, bits array<long>, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that are links, compared on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            (oa, va), (ob, vb) = ((c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(2), b.column(3)))
            for i in range(b.num_rows):
                x, y = va[oa[i] : oa[i + 1]].view(np.uint64), vb[ob[i] : ob[i + 1]].view(np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    rows = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return arrow(rows, run, "a long, b long")


def _rare_partners(nodes: DataFrame, sets: DataFrame, percent: int, to: Scratch) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, part, size, few) of different parts, one of them few, whose rarest members allow a link."""
    members = nodes.join(sets.select("node", "set"), "node").select("node", "part", "size", "few", F.explode("set").alias("g"))
    rarity = members.groupBy("g").agg(F.count("*").alias("common"))
    at = F.row_number().over(Window.partitionBy("node").orderBy("common", "g"))
    ranked = members.join(rarity, "g").withColumn("at", at)
    ranked = to.keep(ranked.where(f"100 * (at - 1) <= {100 - percent} * size").select("node", "part", "size", "few", "g", "at"), "ranked")
    step = math.log(1.25)
    need = f"ceil({percent} * (size + greatest(floor(exp({step} * class)) - 1, floor({percent} * size / 100))) / {100 + percent})"
    lowest, highest = f"cast(floor(ln({percent} * size / 100) / {step} - 1e-6) as int)", f"cast(floor(ln(100 * size / {percent}) / {step} + 1e-6) as int)"
    # a member this far down can serve only classes of sizes up to so much
    reach = f"cast(floor(ln(greatest(1, {100 + percent} * (size - at + 1) / {percent} - size) + 2) / {step} + 1e-6) as int)"
    folds = range(FOLDED)
    bits = sets.select("node", *(F.expr(" | ".join(f"bits[{w}]" for w in range(i, BITS // 64, FOLDED))).alias(f"w{i}") for i in folds))
    x = ranked.where("few").join(bits, "node").withColumn("class", F.explode(F.sequence(F.expr(lowest), F.expr(f"greatest({lowest}, least({highest}, {reach}))")))).where(f"at <= size - {need} + 1")
    x = x.select("g", "class", *(F.col(c).alias(f"{c}_x") for c in ("node", "part", "size", "at", *(f"w{i}" for i in folds))))
    y = ranked.withColumn("class", F.expr(f"cast(floor(ln(size) / {step}) as int)")).join(bits, "node")
    y = y.select("g", "class", "few", *(F.col(c).alias(f"{c}_y") for c in ("node", "part", "size", "at", *(f"w{i}" for i in folds))))
    exact = f"ceil({percent} * (size_x + size_y) / {100 + percent})"
    lacks = lambda p, q: "(" + " + ".join(f"cast(bit_count(w{i}_{p} & ~w{i}_{q}) as int)" for i in folds) + ")"
    near = f"least(size_x, size_y) >= {exact} and at_x <= size_x - {exact} + 1 and at_y <= size_y - {exact} + 1 and size_x - {lacks('x', 'y')} >= {exact} and size_y - {lacks('y', 'x')} >= {exact}"
    met = x.join(y, ["g", "class"]).where(f"part_x <> part_y and (not few or node_x < node_y) and {near}")
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, text_hash (xxhash64 of the text), n_shingles, component_id (the smallest id that links reach, its own included), kept (id_col = component_id).

    Texts that are null, empty or white space have no shingles and stand alone.
    Rows that repeat an id are rows of their own, compared by their own texts.
    Other columns don't matter.  An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as to:
        found = written(_components_of(docs, n, percent, id_col, text_col, to), "near-duplicates")
    id_ = F.col("id")
    return found.select(id_.alias(id_col), "text_hash", "n_shingles", "component_id", id_.eqNullSafe(F.col("component_id")).alias("kept"))


def _components_of(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, to: Scratch) -> DataFrame:
    """(id, text_hash, n_shingles, component_id), of tables kept in ``to``."""
    full = to.keep(signatures(docs, n, id_col, text_col), "signatures")
    classes = full.where("set_a is not null").groupBy("set_a", "set_b").agg(F.min("n_shingles").alias("size"), F.first("bands").alias("bands"), F.min("id").alias("least"), F.min_by("text_hash", F.struct("id", "text_hash")).alias("text_hash"), F.min_by("id", F.struct("id", "text_hash")).alias("id"))
    classes = to.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = to.keep(full.drop("bands"), "rows")
    to.drop(full)
    buckets = classes.select("node", "size", F.explode("bands").alias("key"))
    stars = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("key", "a")
    shared = to.keep(buckets.join(stars, "key"), "buckets")  # of buckets with more than one class
    edges = to.keep(shared.where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count("*").alias("shared")), "edges")
    ends = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "node")
    sets = to.keep(_full_sets(docs, ends.join(classes, "node").select("id", "text_hash", "node", "set_a", "set_b"), n, id_col, text_col), "sets")
    names = to.keep(classes.select("node", "least", "set_a", "set_b"), "names")
    to.drop(classes)
    light = sets.select("node", "size", "bits")

    def plausible(pairs: DataFrame) -> DataFrame:
        return pairs.join(light.toDF("a", "size_a", "bits_a"), "a").join(light.toDF("b", "size_b", "bits_b"), "b").where(_may_link("a", "b", percent)).select("a", "b")

    best = to.keep(edges.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b"), "best")
    links = to.keep(_confirmed(best, sets, percent), "links")
    part = components(links, to)
    to.drop(links)
    rest = edges.select("a", "b").join(best, ["a", "b"], "left_anti").join(part.select("node", "label").toDF("a", "part_a"), "a", "left").join(part.select("node", "label").toDF("b", "part_b"), "b", "left")
    rest = to.keep(plausible(rest.where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b")), "rest")
    to.drop(edges)
    part = joined(part, _confirmed(rest, sets, percent), to)
    tried = best.union(rest)
    # buckets that still hold several components
    crowd = shared.join(part.select("node", "label"), "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("part"))
    by_part = crowd.groupBy("key", "part").agg(F.count("*").alias("many")).groupBy("key").agg(F.max_by("part", F.struct("many", "part")).alias("main"), F.sum("many").alias("many"), F.count("*").alias("parts")).where("parts > 1")
    mixed = crowd.join(by_part.select("key", "main", "many"), "key")
    mixed = to.keep(mixed.withColumn("few", F.expr("part <> main")), "mixed")
    to.drop(shared)
    few = mixed.where(f"few and many <= {SMALL}").select("key", F.col("node").alias("x"), F.col("size").alias("size_x"), F.col("part").alias("part_x"))
    grey = few.join(mixed.where(f"many <= {SMALL}"), "key").where(f"part_x <> part and (part = main or x < node) and 100 * least(size, size_x) >= {percent} * greatest(size, size_x)")
    grey = grey.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    large = mixed.where(f"many > {SMALL}").groupBy("node").agg(F.first("part").alias("part"), F.first("size").alias("size"), F.max("few").alias("few"))
    grey = to.keep(plausible(grey.union(_rare_partners(large, sets, percent, to)).distinct()), "grey")
    to.drop(best, rest, mixed)
    part = joined(part, _confirmed(grey, sets, percent), to)
    to.drop(grey, sets)
    of = names.select("node", "least").join(part.select("node", "label"), "node")
    lowest = to.keep(of.groupBy("label").agg(F.min("least").alias("lowest")), "lowest")
    of = part.select("node", "label").join(lowest, "label").select("node", "lowest")
    of = names.join(of, "node", "left").select("set_a", "set_b", F.coalesce("lowest", "least").alias("lowest"))
    out = rows.join(of, ["set_a", "set_b"], "left")
    return out.select("id", "text_hash", "n_shingles", F.when(F.col("set_a").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, with all its columns; of rows that repeat an id and its text, one.  Extra columns may have any names."""
    names, keys = docs.columns, free_names(docs, "_id", "_null", "_hash")
    kept = near_duplicates(docs, n, percent).where("kept").select(*_keys(F.col("doc_id"), F.col("text_hash"), keys)).distinct()
    # one exchange of the texts serves both the join and the choice among repeated rows
    found = docs.select(*(F.col(f"`{c}`") for c in names), *_keys(F.col("doc_id"), F.xxhash64("text"), keys)).join(kept, keys, "left_semi")
    return found.dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in names))


def _keys(doc_id: Column, text_hash: Column, names: list[str]) -> list[Column]:
    """A row's id and text as keys that are never null."""
    return [c.alias(name) for c, name in zip((F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull(), text_hash), names, strict=True)]


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = {
    "op2_near_dedup": r"""
with recursive d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b from x a join x b using (g) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on r.b = e.a)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select a as doc_id, min(b) as component_id from r group by a) c using (doc_id)
"""
}
