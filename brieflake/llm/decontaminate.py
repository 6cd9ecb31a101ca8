"""Benchmark decontamination with an FM-index for each training shard.

Operator 8.  A shard is a run of whole texts (about SHARD_BYTES).  Its words
become symbols: one for each word of the benchmark, one separator for all the
rest.  Runs of benchmark words that are shorter than the shortest phrase can't
hold one and stay out of the index; that loses nothing.  On what is left the
shard gets a suffix array, its Burrows-Wheeler transform in a wavelet matrix,
and sampled suffix positions.  All phrases are searched backwards at once, their
occurrences located by walking to sampled positions, and merged into spans.

Words: runs of ASCII digits and letters (A-Z lower-cased) and of any non-ASCII
characters.  A phrase is each run of ``window`` item words, or the whole item if
it has fewer, but not none.  A null text or item has no words.  Repeated rows
get a row each; items with one id count once, and all items without an id as one
that has no name (null, last of a row's items).  An empty benchmark hits nothing.

The benchmark is broadcast as integers, about 50 bytes a word; its size is checked
against MAX_CHARS first, and larger ones are refused with advice to split them:
spans of several calls may be united by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .split import forget
from .store import arrow, retexted, table

WINDOW = 10
SHARD_BYTES = 4 << 20
SAMPLE = 8
MAX_CHARS = 12_000_000


class Phrases(NamedTuple):
    vocab: np.ndarray  # sorted hashes of the benchmark's words; symbol = place + 2
    symbols: np.ndarray  # phrases x window, padded with 0 at the end
    length: np.ndarray
    item_ptr: np.ndarray  # phrases + 1
    items: np.ndarray  # item ids of each phrase, as strings; None for null
    shortest: int


def phrases(ids: list, texts: list[str | None], window: int = WINDOW) -> Phrases:
    """The distinct phrases of the benchmark and the items that hold each."""
    got = [(w.first + k, w.hashes[w.ptr[k] : w.ptr[k + 1]]) for w in W.words(pa.array(texts, pa.string()), W.ALNUM_WORDS) for k in range(len(w.ptr) - 1)]
    vocab = np.unique(np.concatenate([h for _, h in got])) if got else np.zeros(0, dtype=W.U64)
    names = sorted({str(x) for x in ids if x is not None}) + [None]
    number = {x: i for i, x in enumerate(names)}
    parts, owner = [], []
    for k, h in got:
        s = (np.searchsorted(vocab, h) + 2).astype(np.int32)
        if len(s):
            parts.append(np.lib.stride_tricks.sliding_window_view(s, window) if len(s) >= window else np.pad(s, (0, window - len(s)))[None, :])
            owner.append(np.full(len(parts[-1]), number[None if ids[k] is None else str(ids[k])]))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Phrases(vocab, np.zeros((0, window), dtype=np.int32), none, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=object), 0)
    out, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
    length = (out > 0).sum(axis=1)
    pair = np.unique(which.ravel() * len(names) + np.concatenate(owner))
    ptr = np.searchsorted(pair // len(names), np.arange(len(out) + 1))
    return Phrases(vocab, out, length, ptr, np.array(names, dtype=object)[pair % len(names)], int(length.min()))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; ``s`` holds ranks that end in a unique smallest one."""
    n, step = len(s), 1
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    x = s[order]
    rank[order] = np.concatenate([[0], np.cumsum(x[1:] != x[:-1])])
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        x = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(x[1:] != x[:-1])])
        step *= 2
    return order


class FMIndex:
    """Over symbols < size; 0 ends the text and 1 separates runs that are never searched across."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        apart = text == 1
        ranks = np.where(text > 1, text + n, np.where(apart, np.cumsum(apart), 0))  # each separator is its own symbol while sorting, so repeats end with their runs
        self.sa = sa = suffix_array(ranks)
        self.bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros, x = [], [], self.bwt
        for lv in range(self.levels - 1, -1, -1):
            bit = (x >> lv) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        start = np.flatnonzero(np.concatenate([[True], text[:-1] <= 1]) | (text <= 1))
        since = np.arange(n)
        since -= np.maximum.accumulate(np.where(np.isin(since, start), since, 0))
        keep = since % SAMPLE == 0
        self.sampled = keep[sa]
        self.position = np.where(self.sampled, sa, -1)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs before row i of the transform."""
        at = np.zeros_like(i)
        for k, lv in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> lv) & 1).astype(bool)
            r, q = self.ones[k][i].astype(np.int64), self.ones[k][at].astype(np.int64)
            i, at = np.where(one, self.zeros[k] + r, i - r), np.where(one, self.zeros[k] + q, at - q)
        return i - at

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of each phrase's occurrences, by backward search."""
        m = len(length)
        lo, hi = np.zeros(m, dtype=np.int64), np.full(m, len(self.bwt), dtype=np.int64)
        live = np.arange(m)
        for back in range(1, int(length.max()) + 1 if m else 1):
            live = live[(length[live] >= back) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = symbols[live, length[live] - back]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to sampled ones."""
        out, walked = np.empty(len(row), dtype=np.int64), 0
        todo, at = np.arange(len(row)), row.copy()
        while len(todo):
            here = self.sampled[at]
            out[todo[here]] = self.position[at[here]] + walked
            todo, at = todo[~here], at[~here]
            c = self.bwt[at]
            at = self.first[c] + self.rank(c, at)
            walked += 1
        return out


def _indexed(w: W.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """The shard's symbols for its index and the word that each stands for."""
    at = np.searchsorted(p.vocab, w.hashes)
    at[at == len(p.vocab)] = 0
    known = p.vocab[at] == w.hashes
    n = len(known)
    opens = known.copy()
    opens[1:] &= ~known[:-1]
    begin = w.ptr[:-1][w.ptr[:-1] < n]
    opens[begin] = known[begin]
    run = np.cumsum(opens) - 1
    size = np.bincount(run[known], minlength=int(opens.sum())) if n else np.zeros(0, dtype=np.int64)
    keep = np.flatnonzero(known & (size[run] >= p.shortest)) if len(size) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(keep)) + np.cumsum(np.concatenate([[0], run[keep][1:] != run[keep][:-1]])) if len(keep) else keep
    text = np.ones(int(place[-1]) + 3 if len(keep) else 1, dtype=np.int64)
    word = np.full(len(text), -1, dtype=np.int64)
    text[place], word[place] = at[keep] + 2, keep
    text[-1] = 0
    return text, word


def found(w: W.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: for each word whether it is hit, and the pairs (text, phrase) that occur."""
    none = np.zeros(0, dtype=np.int64)
    hit = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    if not len(p.length) or not len(w.hashes):
        return hit[:-1].astype(bool), none, none
    text, word = _indexed(w, p)
    if len(text) < p.shortest:
        return hit[:-1].astype(bool), none, none
    fm = FMIndex(text, len(p.vocab) + 2)
    lo, hi = fm.search(p.symbols, p.length)
    many = hi - lo
    which = np.repeat(np.arange(len(many)), many)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    first = word[fm.locate(rows)]
    np.add.at(hit, first, 1)
    np.add.at(hit, first + p.length[which], -1)
    doc = np.searchsorted(w.ptr, first, side="right") - 1
    pair = np.unique(doc * len(many) + which)
    return np.cumsum(hit)[:-1] > 0, pair // len(many), pair % len(many)


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(x == 1), np.flatnonzero(x == -1)


def load_phrases(benchmark: DataFrame, window: int = WINDOW) -> Phrases:
    size = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > MAX_CHARS:
        raise ValueError(f"the benchmark has {size} characters; split it into blocks of at most {MAX_CHARS} and unite their spans by document")
    rows = benchmark.select("item_id", "text").collect()
    return phrases([r[0] for r in rows], [r[1] for r in rows], window)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, spans (of hit words, end excluded), items (ids, sorted as strings; null for items without one)."""
    got = docs.sparkSession.sparkContext.broadcast(load_phrases(benchmark, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = got.value
        for b in batches:
            n_words, spans, items = [], [], []
            for w in W.words(b.column(1), W.ALNUM_WORDS, SHARD_BYTES):
                hit, doc, phrase = found(w, p)
                cut = np.searchsorted(doc, np.arange(len(w.ptr)))
                for i in range(len(w.ptr) - 1):
                    a, z = w.ptr[i], w.ptr[i + 1]
                    n_words.append(z - a)
                    if cut[i] == cut[i + 1]:
                        spans.append([])
                        items.append([])
                        continue
                    s, e = _runs(hit[a:z])
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)])
                    items.append(sorted({x for k in phrase[cut[i] : cut[i + 1]] for x in p.items[p.item_ptr[k] : p.item_ptr[k + 1]]}, key=lambda x: (x is None, x)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"]
            )

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every hit span cut out of its text, from its first word's first byte to its last word's last; n_chars follows, if docs has it."""
    got = docs.sparkSession.sparkContext.broadcast(load_phrases(benchmark, window))

    def change(texts: pa.Array) -> pa.Array:
        forget()
        p, out = got.value, [None] * len(texts)
        for w in W.words(texts, W.ALNUM_WORDS, SHARD_BYTES):
            hit, doc, _ = found(w, p)
            for i in np.unique(doc):
                a, z = w.ptr[i], w.ptr[i + 1]
                s, e = _runs(hit[a:z])
                at, parts = w.text_at[i], []
                for x, y in zip(s, e, strict=True):
                    parts.append(w.data[at : w.start[a + x]].tobytes())
                    at = w.end[a + y - 1]
                parts.append(w.data[at : w.text_at[i + 1]].tobytes())
                out[w.first + int(i)] = b"".join(parts).decode()
        return pa.array(out, pa.string())

    return retexted(docs, change)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


ORACLE = {
    "op8_decontaminate": r"""
with low as (
  select 'd' as kind, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select kind, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from low),
b as (select id, w, least(10, len(w)) as n from w where kind = 'b' and len(w) > 0),
bw as (select distinct id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from b)),
d as (select id, w from w where kind = 'd'),
dw as (select id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select d.id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) as i from d, (select distinct n from b) l)),
m as (select dw.id, dw.i, dw.n, bw.id as item from dw join bw using (n, g)),
hit as (select id, count(distinct k) as n_hit from (select id, unnest(range(i, i + n)) as k from m) group by id),
it as (select id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct id, item::varchar as item from m) group by id)
select d.id as doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (id) left join it using (id)
"""
}
