"""Substring deduplication with compact windows.

Operator 6.  A document is the sequence of its SHINGLE-word shingles (words: runs
of anything but ASCII white space, A-Z lower-cased).  The Cartesian tree over the
hashed sequence has a node for each place c that is the least in [l, r]; all
subsequences that hold c within [l, r] share its min-hash, so the node stands for
them: a compact window.  Only windows of at least RUN places are kept, about
2 n / RUN of them for n words.  They are found by sliding minima, their bounds by
descent in a table of range minima.

Two passages of LENGTH words and more that are as alike as PERCENT have RUN places
in a row in common: a gap takes nine places or more of the two, so passages with
one gap fewer than 20 % of all places apart have a longest run of 21 at least, and
longer ones a longer run.  The least place of such a run is the same in both, and
has SIDE of the run's places on its left or on its right.  So windows meet under
their min-hash together with the SIDE shingles on one side, and one hash function
meets every pair; more would meet the same pairs again.

Of those that meet, each is joined to one place in the smallest document only, so the
pairs grow with the windows and not with their square.  Windows that lie in no passage
found there go on: they meet others under what stands from their place to FURTHER
shingles beyond what they share with that document, after it or before it, and again
the smallest of those is compared, once with that document's other places and once
without it.  What meets then has so many more places in a row in
common, so after a few rounds it is a passage and nothing is open.  Runs of LENGTH
words about the shared place that the smallest document hasn't got meet under their
own hash besides, at most LENGTH of them for a window.
Verification compares the two documents' shingles within BAND places of the shared
diagonals, up to BEYOND places from a window, takes every stretch from a matched
run to another whose Jaccard similarity with its counterpart is PERCENT, and keeps
passages of at least LENGTH words.

An exact passage of LENGTH words is always found.  A near-copy is found if the two
are compared under a key they share: the document it is like is the smallest one there,
or they go on alike FURTHER places beyond a part that smaller documents hold.

The smallest document keeps a passage; in all others it is a duplicate.  Repeats
within one document, and rows that share an id, are not compared.  Documents
with fewer than LENGTH words, and null or empty ones, have no windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .split import forget
from .store import Scratch, arrow, free_names, retexted, table, written

SHINGLE, LENGTH, PERCENT = 5, 50, 80
#: Places that an exact run has in any two passages as alike as PERCENT: with S places in both, at most S / 9 of them differ, and a gap takes 9 of these.
RUN = 20
SIDE = RUN // 2
#: Places beyond a window that verification sees, and how far from the diagonal.
BEYOND, BAND = 2 * LENGTH, 12
#: Places by which what is shared must go on beyond a smaller document's part of it for others to meet there.
FURTHER = 3


def _tag() -> Column:
    """31 bits that tell texts under one id apart."""
    return F.xxhash64("text").bitwiseAND(0x7FFFFFFF)


def _sliding(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    pad = np.full(-len(v) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    x = np.concatenate([v, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def compact_windows(h: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places c and bounds l, r of the compact windows of at least ``least`` places; zeros in h part the documents, of at most ``longest`` places."""
    n = len(h)
    bits = np.uint64(max(1, n.bit_length()))
    v = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    m = _sliding(v, least)
    if not len(m):
        return (np.zeros(0, dtype=np.int64),) * 3
    c = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    c = c[np.concatenate([[True], c[1:] != c[:-1]])]
    c = c[h[c] != 0]
    levels = [v]
    while 1 << len(levels) <= longest:
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]) if len(last) > step else last[:0])
    r, l, mine = c.copy(), c.copy(), v[c]
    for k in range(len(levels) - 1, -1, -1):
        t, step = levels[k], 1 << k
        if not len(t):
            continue
        go = r + 1 < len(t)
        go[go] = t[r[go] + 1] > mine[go]
        r[go] += step
        at = l - step
        go = (at >= 0) & (at < len(t))
        go[go] = t[at[go]] > mine[go]
        l[go] -= step
    wide = r - l + 1 >= least
    return c[wide], l[wide], r[wide]


def _sequences(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a chunk's texts with a zero before, between and after them, where each text's begin, and how many it has."""
    s, ptr = W.shingles(w, SHINGLE, whole_if_short=False)
    s = np.where(s == 0, W.U64(1), s)
    size = np.diff(ptr)
    begin = ptr[:-1] + np.arange(1, len(size) + 1)
    out = np.zeros(len(s) + len(size) + 1, dtype=W.U64)
    out[np.arange(len(s)) + np.repeat(np.arange(1, len(size) + 1), size)] = s
    return out, begin, size


def _windows(docs: DataFrame) -> DataFrame:
    """(key, doc, tag, c, left, right) of each window and side: its place and how far it reaches to either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for w in W.words(b.column(2), W.SPACE_WORDS, W.CHUNK):
                s, begin, size = _sequences(w)
                if not len(size) or size.max() < LENGTH - SHINGLE + 1:
                    continue
                side = np.zeros(len(s) + 1, dtype=W.U64)
                np.cumsum(s * W.U64(0xD1342543DE82EF95), out=side[1:])
                keys, places, lefts, rights = [], [], [], []
                # the order within a side counts through a second sum, weighted by place
                weight = np.zeros(len(s) + 1, dtype=W.U64)
                np.cumsum(s * np.arange(1, len(s) + 1, dtype=W.U64), out=weight[1:])
                h = np.where(s == 0, W.U64(0), W.mix(s + W.U64(1)) | W.U64(1 << 63))
                c, l, r = compact_windows(h, RUN, int(size.max()))
                for left in (True, False):
                    ok = (c - l >= SIDE) if left else (r - c >= SIDE)
                    at = c[ok]
                    lo, hi = (at - SIDE, at) if left else (at, at + SIDE)
                    total, turn = side[hi + 1] - side[lo], weight[hi + 1] - weight[lo] - lo.astype(W.U64) * ((side[hi + 1] - side[lo]) * W.U64(pow(0xD1342543DE82EF95, -1, 1 << 64)))
                    keys.append(W.mix(W.mix(s[at] + total) + turn + W.U64(left)))
                    places.append(at)
                    lefts.append((at - l[ok]))
                    rights.append((r[ok] - at))
                key, at = np.concatenate(keys), np.concatenate(places)
                if not len(key):
                    continue
                row = np.searchsorted(begin, at, side="right") - 1
                cols = [pa.array(key.view(np.int64)), pa.array(ids[w.first + row]), pa.array(tags[w.first + row])]
                cols += [pa.array(v.astype(np.int32)) for v in (at - begin[row], np.concatenate(lefts), np.concatenate(rights))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "doc", "tag", "c", "left", "right"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), _tag(), "text")
    return arrow(rows, run, "key long, doc long, tag long, c int, left int, right int")


def _slices(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, tag, starts, sizes, hashes) of the asked ranges of shingles and BEYOND on either side, joined where they overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, sizes, hashes = [], [], []
            for w in W.words(b.column(2), W.SPACE_WORDS, W.CHUNK):
                s, begin, size = _sequences(w)
                low = (s & W.U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                for i in range(len(size)):
                    got: list[list[int]] = []
                    for r in sorted((max(0, x["l"] - BEYOND), min(int(size[i]), x["r"] + 1 + BEYOND)) for x in b.column(3)[w.first + i].as_py()):
                        if got and r[0] <= got[-1][1]:
                            got[-1][1] = max(got[-1][1], r[1])
                        else:
                            got.append([*r])
                    starts.append([a for a, _ in got])
                    sizes.append([z - a for a, z in got])
                    hashes.append(np.concatenate([low[begin[i] + a : begin[i] + z] for a, z in got]) if got else low[:0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int32()))], names=["doc", "tag", "starts", "sizes", "hashes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), _tag().alias("tag"), "text").join(asked, ["doc", "tag"]).dropDuplicates(["doc", "tag"]).select("doc", "tag", "text", "ranges")
    return arrow(rows, run, "doc long, tag long, starts array<int>, sizes array<int>, hashes array<int>")


def _laid(starts: pa.ListArray, sizes: pa.ListArray, hashes: pa.ListArray, unknown: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of all rows at their places in one array, ``unknown`` between them, with where each row begins and its length; rows are more than 2 * BAND apart."""
    off = starts.offsets.to_numpy()
    s, z = (c.values.to_numpy()[off[0] : off[-1]].astype(np.int64) for c in (starts, sizes))
    owner = np.repeat(np.arange(len(starts)), np.diff(off))
    length = np.zeros(len(starts), dtype=np.int64)
    np.maximum.at(length, owner, s + z)
    begin = np.cumsum(length + 2 * BAND + 1) - length
    out = np.full(int(length.sum()) + (2 * BAND + 1) * (len(starts) + 1), unknown, dtype=np.int64)
    at = hashes.offsets.to_numpy()
    out[_ranges(begin[owner] + s, z)] = hashes.values.to_numpy()[at[0] : at[-1]].view(np.uint32)
    return out, begin, length


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def strip_passages(at: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strip, first word and end of the passages that the matched shingles make.

    at: each shingle's place in the other document, -1 if it has none; part: which
    strip each belongs to, in order.  Of the stretches from a run to another that
    are as alike as PERCENT, each is within the longest one that ends with the same
    run: the one from the first run whose balance before it is no more than the
    balance at the end.
    """
    hit = np.flatnonzero(at >= 0)
    if not len(hit):
        return (hit,) * 3
    of = part[hit]
    cut = np.flatnonzero((hit[1:] != hit[:-1] + 1) | (at[hit[1:]] != at[hit[:-1]] + 1) | (of[1:] != of[:-1]))
    begins, ends = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(hit) - 1]])
    a, z, of = hit[begins], hit[ends] + 1, of[begins]
    done = np.cumsum(z - a)
    # each strip's balances lie below those of the strip before
    end = (100 + PERCENT) * done - PERCENT * (z + at[z - 1] + 1) - (of << 40)
    begin = (100 + PERCENT) * (done - (z - a)) - PERCENT * (a + at[a]) - (of << 40)
    first = a[np.searchsorted(-np.minimum.accumulate(begin), -end)]
    last = z + SHINGLE - 1
    long = last - first >= LENGTH
    first, last, of = first[long], last[long], of[long]
    if not len(of):
        return (of,) * 3
    # ends ascend within a strip; a passage ends where all that come later begin beyond it
    least = np.minimum.accumulate((first + (of << 40))[::-1])[::-1]
    cut = np.flatnonzero(least[1:] > (last + (of << 40))[:-1])
    begins, ends = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(of) - 1]])
    return of[ends], least[begins] - (of[ends] << 40), last[ends]


def matched_passages(at: np.ndarray) -> list[tuple[int, int]]:
    """The passages of a single strip."""
    _, start, end = strip_passages(at, np.zeros(len(at), dtype=np.int64))
    return list(zip(start.tolist(), end.tolist(), strict=True))


def _near(x: np.ndarray, target: np.ndarray, y_keys: np.ndarray) -> np.ndarray:
    """For each shingle, the place nearest its target that y has it at, -1 if none is within BAND; y_keys: y's shingles with their places, sorted."""
    k = np.searchsorted(y_keys, (x << 31) | np.maximum(target, 0))
    best = np.full(len(x), -1, dtype=np.int64)
    gap = np.full(len(x), BAND + 1, dtype=np.int64)
    for at in (k - 1, k):
        key = y_keys[np.clip(at, 0, len(y_keys) - 1)]
        place = key & 0x7FFFFFFF
        off = np.abs(place - target)
        ok = (key >> 31 == x) & (off < gap)
        best, gap = np.where(ok, place, best), np.where(ok, off, gap)
    return best


def _unheld(same: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, w: int) -> np.ndarray:
    """The starts of the runs of ``w`` places that hold a place c within its window and aren't all in ``same``."""
    lo, hi = np.maximum(c - left, c - w + 1), np.minimum(c, c + right - w + 1)
    miss = np.concatenate([[0], np.cumsum(~same)])
    bad = np.concatenate([[0], np.cumsum(miss[w:] > miss[:-w])]) if len(same) >= w else np.zeros(1, dtype=np.int64)
    ok = hi >= lo
    lo, hi = lo[ok], hi[ok]
    some = bad[hi + 1] > bad[lo]
    lo, hi = lo[some], hi[some]
    start = _ranges(lo, hi - lo + 1)
    return start[bad[start + 1] > bad[start]]


def _run_hashes(x: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """A hash of the ``w`` shingles from each start, the same wherever they stand."""
    if not len(start):
        return np.zeros(0, dtype=W.U64)
    lo = int(start.min())
    v = W.mix(x[lo : int(start.max()) + w].astype(W.U64) + W.U64(1))
    # sums of v times powers of a number, over 1, 2, 4, ... places; w is put together from them
    times, size, out, done = 0xD1342543DE82EF95, 1, np.zeros(len(start), dtype=W.U64), 0
    at = start - lo
    while size <= w:
        if w & size:
            out = out * W.U64(times) + v[at + done]
            done += size
        if 2 * size <= w:
            v = v[:-size] * W.U64(times) + v[size:]
        times, size = times * times % (1 << 64), 2 * size
    return W.mix(out)


#: Shingles that verification lays out at once, but for a single pair's or strip's.
LAID = 1 << 17


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending: sorting beats np.unique's hash table on numbers like these several times."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _settled(of: np.ndarray, start: np.ndarray, end: np.ndarray, pair: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether each pair's place lies in one of its passages; these are in order."""
    if not len(of):
        return np.zeros(len(c), dtype=bool)
    begin, end = (of << 32) | start, (of << 32) | end
    # those that reach beyond all before: ends ascend with begins, so the last one that begins before a place reaches farthest
    top = np.concatenate([[True], end[1:] > np.maximum.accumulate(end)[:-1]])
    begin, end = begin[top], end[top]
    at = (pair << 32) | c
    k = np.searchsorted(begin, at, side="right") - 1
    return (k >= 0) & (end[np.maximum(k, 0)] >= at + SHINGLE)


def _further(x: np.ndarray, begin: np.ndarray, length: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of what stands from the places c of documents laid at ``begin`` to FURTHER places beyond their matched runs [low, high), after and before: which have these places, and the keys."""
    v = W.mix(x.astype(W.U64) + W.U64(1))
    once, placed = (np.concatenate([np.zeros(1, dtype=W.U64), np.cumsum(y, dtype=W.U64)]) for y in (v, v * np.arange(len(x), dtype=W.U64)))
    out = []
    for side, start, end in ((1, c, high + FURTHER), (2, low - FURTHER, c + 1)):
        ok = np.flatnonzero((start >= 0) & (end <= length))
        lo, hi = begin[ok] + start[ok], begin[ok] + end[ok]
        known = (x[lo] >= 0) & (x[hi - 1] >= 0)
        ok, lo, hi = ok[known], lo[known], hi[known]
        total = once[hi] - once[lo]
        out.append((ok, W.mix(W.mix(total + W.U64(side)) + (placed[hi] - placed[lo]) - lo.astype(W.U64) * total)))
    return out


def _compared(part: pa.RecordBatch) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """Of each pair, its passages, the runs left open, and the windows left open under further keys: all its strips (diagonals with shared places) are laid end to end and compared at once."""
    w, n = LENGTH - SHINGLE + 1, part.num_rows
    x, x_at, x_len = _laid(part.column("starts"), part.column("sizes"), part.column("hashes"), -1)
    y, y_at, y_len = _laid(part.column("starts_0"), part.column("sizes_0"), part.column("hashes_0"), -2)
    later = part.column("doc").to_numpy() > part.column("keeper").to_numpy()
    have = np.flatnonzero(y >= 0)
    y_keys = np.sort((y[have] << 31) | have)
    # shingles of x that no keeper here has needn't be looked for on every diagonal
    hashes = y_keys >> 31
    known = (hashes[np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)] == x) if len(hashes) else np.zeros(len(x), dtype=bool)
    off = part.column("places").offsets.to_numpy()
    at, extent = (part.column("places").values.field(f).to_numpy()[off[0] : off[-1]] for f in ("at", "extent"))
    pair = np.repeat(np.arange(n), np.diff(off))
    order = np.lexsort((at, pair))
    at, extent, pair = at[order], extent[order], pair[order]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (pair[1:] != pair[:-1])])  # a window's two sides may meet the same place
    at, extent, pair = at[new], extent[new], pair[new]
    d, c, left, right = at >> 31, at & 0x7FFFFFFF, extent >> 31, extent & 0x7FFFFFFF
    low, high = c.copy(), c + 1  # the matched run about each place
    begins = np.concatenate([[True], (pair[1:] != pair[:-1]) | (d[1:] != d[:-1])])
    first, strip = np.flatnonzero(begins), np.cumsum(begins) - 1
    of, slant = pair[first], d[first]
    # a diagonal as far as its windows reach, and BEYOND
    lo = np.maximum(0, np.minimum.reduceat(c - left, first) - BEYOND)
    hi = np.minimum(x_len[of], np.maximum.reduceat(c + right, first) + 1 + BEYOND)
    passages, opened = [], []
    for u, v in W.spans(np.concatenate([[0], np.cumsum(hi - lo)]), LAID):
        size, mine_of = hi[u:v] - lo[u:v], of[u:v]
        here = np.repeat(np.arange(u, v), size)
        in_x = _ranges(lo[u:v] + x_at[mine_of], size)
        xs = x[in_x]
        target = in_x + np.repeat(slant[u:v] + y_at[mine_of] - x_at[mine_of], size)
        inside = (target >= np.repeat(y_at[mine_of], size)) & (target < np.repeat(y_at[mine_of] + y_len[mine_of], size))
        same = inside & (xs == y[np.where(inside, target, 0)])
        edge = np.cumsum(size)
        base = edge - size - lo[u:v]
        mine = slice(*np.searchsorted(strip, [u, v]))
        mine_strip = strip[mine] - u
        start = _unheld(same, c[mine] + base[mine_strip], left[mine], right[mine], w)
        opened.append((of[here[start]] << 32) | (start - base[here[start] - u]))
        stop = np.append(~same, True)
        stop[edge[:-1]] = True
        stops = np.flatnonzero(stop)
        p = c[mine] + base[mine_strip]
        k = np.searchsorted(stops, p, side="right")
        first_of = edge[mine_strip] - size[mine_strip]
        high[mine] = np.maximum(c[mine] + 1, np.minimum(stops[np.minimum(k, len(stops) - 1)], edge[mine_strip]) - base[mine_strip])
        before = np.where(k > 0, stops[np.maximum(k, 1) - 1] + 1, 0)
        low[mine] = np.minimum(c[mine], np.maximum(before, first_of) - base[mine_strip])
        meant = np.repeat(later[mine_of], size)
        todo = np.flatnonzero(meant & ~same & known[in_x])
        across = target - np.repeat(y_at[mine_of], size)
        at = np.where(same & meant, across, -1)
        near = _near(xs[todo], target[todo], y_keys) if len(todo) else todo
        near -= y_at[of[here[todo]]]
        at[todo] = np.where((near >= 0) & (near < y_len[of[here[todo]]]), near, -1)
        k, s, e = strip_passages(at, here)
        passages.append(np.stack([of[k], s - base[k - u], e - base[k - u]]))
    got = _distinct(np.concatenate(opened)) if opened else np.zeros(0, dtype=np.int64)
    start, owner = got & 0xFFFFFFFF, got >> 32
    runs = pa.StructArray.from_arrays([pa.array(_run_hashes(x, start + x_at[owner], w).view(np.int64)), pa.array(start, pa.int32())], names=["run", "start"])
    found = np.concatenate(passages, axis=1) if passages else np.zeros((3, 0), dtype=np.int64)
    found = found[:, np.lexsort(found[::-1])]
    found = found[:, np.concatenate([[True], (found[:, 1:] != found[:, :-1]).any(axis=0)])] if found.size else found
    spans = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in found[1:]], names=["start", "end"])
    left_open = np.flatnonzero(~_settled(*found, pair, c))
    parts = _further(x, x_at[pair[left_open]], x_len[pair[left_open]], c[left_open], low[left_open], high[left_open])
    which = left_open[np.concatenate([ok for ok, _ in parts])]
    keys = np.concatenate([k for _, k in parts])
    # once with the keeper's other places, once among the others
    keeper = part.column("keeper").to_numpy().view(W.U64)
    other = later[pair[which]]
    keys = np.concatenate([keys, W.mix(keys[other] + keeper[pair[which[other]]] * W.U64(2) + W.U64(1))]).view(np.int64)
    which = np.concatenate([which, which[other]])
    order = np.argsort(pair[which], kind="stable")
    which, keys = which[order], keys[order]
    more = pa.StructArray.from_arrays([pa.array(keys), *(pa.array(v[which], pa.int32()) for v in (c, left, right))], names=["key", "c", "left", "right"])
    lists = lambda who, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(n + 1)), pa.int32()), values)
    return lists(found[0], spans), lists(owner, runs), lists(pair[which], more)


def _verified(pairs: DataFrame) -> DataFrame:
    """(doc, tag, keeper, spans, open, more) of pairs with both slices and their shared places; open: hash and start of the runs of LENGTH words about a shared place that the keeper doesn't hold there; more: windows in no passage, under keys of what lies beyond their match."""

    def reach(starts: pa.ListArray, sizes: pa.ListArray) -> np.ndarray:
        off, last = starts.offsets.to_numpy(), sizes.offsets.to_numpy()
        a, z = (np.append(x.values.to_numpy(), 0) for x in (starts, sizes))  # a row without ranges may be the last
        return np.where(np.diff(off) > 0, a[off[1:] - 1].astype(np.int64) + z[last[1:] - 1], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = reach(b.column("starts"), b.column("sizes")) + reach(b.column("starts_0"), b.column("sizes_0"))
            for u, v in W.spans(np.concatenate([[0], np.cumsum(size)]), LAID):
                part = b.slice(u, v - u)
                spans, opened, more = _compared(part)
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("tag"), part.column("keeper"), spans, opened, more], names=["doc", "tag", "keeper", "spans", "open", "more"])

    return arrow(pairs, run, "doc long, tag long, keeper long, spans array<struct<start:int,end:int>>, open array<struct<run:long,start:int>>, more array<struct<key:long,c:int,left:int,right:int>>").where("size(spans) > 0 or size(open) > 0 or size(more) > 0")


def duplicate_passages(docs: DataFrame) -> DataFrame:
    """(doc, tag, keepers, spans) for the documents that repeat passages of smaller ones: the spans in words, merged and in order."""
    with Scratch(docs.sparkSession) as to:
        return written(_duplicates(docs, to), "passages")


LOW = 0x7FFFFFFF


def _packed(*cols: str) -> Column:
    """Two numbers of 31 bits in a long; the first may be negative."""
    high, low = cols
    return F.expr(f"shiftleft(cast({high} as long), 31) + {low}")


def _pairs(met: DataFrame, to: Scratch) -> DataFrame:
    """(doc, tag, c, left, right, keeper, tag_0, c_0, left_0, right_0): each window of ``met`` (key, doc, place, extent, keeper) with the first place that the smallest document under its key, the keeper, has it at.  The keeper's other places are windows too: they may hold what others repeat."""
    # plain numbers, so that this is no aggregate of sorted rows
    best = to.keep(met.where("doc = keeper").groupBy("key").agg(F.min("place").alias("place_0"), F.min_by("extent", "place").alias("extent_0")), "best")
    pairs = met.join(best, "key").where("not (doc = keeper and place = place_0)").drop("key")
    high, low = (lambda name: F.shiftright(name, 31)), (lambda name: F.col(name).bitwiseAND(LOW).cast("int"))
    sides = [(high(f"place{k}").alias(f"tag{k}"), low(f"place{k}").alias(f"c{k}"), high(f"extent{k}").cast("int").alias(f"left{k}"), low(f"extent{k}").alias(f"right{k}")) for k in ("", "_0")]
    out = to.keep(pairs.select("doc", *sides[0], "keeper", *sides[1]), "pairs")
    to.drop(best)
    return out


def _met(windows: DataFrame, to: Scratch) -> DataFrame:
    """(key, doc, place, extent, keeper) of the windows whose key several documents have."""
    # what a hot key is joined to is written first, so that both sides are plain exchanges, and a skewed join is split
    shared = to.keep(windows.groupBy("key").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper < last").select("key", "keeper"), "keys")
    met = to.keep(windows.select("key", "doc", _packed("tag", "c").alias("place"), _packed("`left`", "`right`").alias("extent")).join(shared, "key"), "windows")
    to.drop(shared)
    return met


def _asked(pairs: DataFrame) -> DataFrame:
    """(doc, tag, ranges) that the windows of pairs reach over.  Those that begin in the same 2 * BEYOND places are one: with BEYOND on either side they overlap."""
    reach = [pairs.select(F.col(doc).alias("doc"), F.col(f"tag{k}").alias("tag"), F.expr(f"c{k} - left{k}").alias("l"), F.expr(f"c{k} + right{k}").alias("r")) for doc, k in (("doc", ""), ("keeper", "_0"))]
    blocks = reach[0].union(reach[1]).groupBy("doc", "tag", F.expr(f"l div {2 * BEYOND}")).agg(F.min("l").alias("l"), F.max("r").alias("r"))
    return blocks.groupBy("doc", "tag").agg(F.collect_list(F.struct("l", "r")).alias("ranges"))


def _sliced(pairs: DataFrame, slices: DataFrame) -> DataFrame:
    place = F.struct(_packed("(c_0 - c)", "c").alias("at"), _packed("`left`", "`right`").alias("extent"))
    groups = pairs.groupBy("doc", "tag", "keeper", "tag_0").agg(F.collect_list(place).alias("places"))
    rows = groups.join(slices, ["doc", "tag"]).join(slices.toDF("keeper", "tag_0", "starts_0", "sizes_0", "hashes_0"), ["keeper", "tag_0"])
    return rows.select("doc", "tag", "keeper", "places", "starts", "sizes", "hashes", "starts_0", "sizes_0", "hashes_0")


def _duplicates(docs: DataFrame, to: Scratch) -> DataFrame:
    windows = to.keep(_windows(docs), "every")
    met = _met(windows, to)
    to.drop(windows)
    pairs = _pairs(met, to)
    to.drop(met)
    slices = to.keep(_slices(docs, _asked(pairs)), "slices")
    found = first_found = to.keep(_verified(_sliced(pairs, slices)), "found")
    to.drop(pairs)
    spans = found.where("size(spans) > 0").select("doc", "tag", "keeper", "spans")
    while True:  # what meets in a round has FURTHER more places in a row in common than in the one before, and from LENGTH words on nothing stays open
        left = to.keep(found.select("doc", "tag", F.inline("more")).distinct(), "open")
        met = _met(left, to)
        to.drop(left)
        if met.isEmpty():
            break
        pairs = _pairs(met, to)
        # documents of a round are among those of the one before, and mostly few
        theirs = pairs.select("doc", "tag").union(pairs.select("keeper", "tag_0")).distinct()
        before, slices = slices, to.keep(slices.join(theirs, ["doc", "tag"], "left_semi"), "slices")
        to.drop(before)
        found = to.keep(_verified(_sliced(pairs, slices)), "found")
        to.drop(met, pairs)
        spans = spans.union(found.where("size(spans) > 0").select("doc", "tag", "keeper", "spans"))
    to.drop(slices)
    found = first_found
    more = _held(found, to)
    return spans.union(more).groupBy("doc", "tag").agg(F.sort_array(F.collect_set("keeper")).alias("keepers"), _merged(F.sort_array(F.flatten(F.collect_list("spans")))).alias("spans"))


def _held(found: DataFrame, to: Scratch) -> DataFrame:
    """(doc, tag, keeper, spans) of the open runs that a smaller document has open too.  A document's places of one run, many where it says the same over and over, are one row."""
    opened = found.select("doc", "tag", F.inline("open")).groupBy("doc", "tag", "run").agg(F.collect_set("start").alias("starts"))
    held = to.keep(opened.groupBy("run").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper < last").select("run", "keeper"), "held")
    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + LENGTH).alias("end")))
    return opened.join(held, "run").where("doc > keeper").select("doc", "tag", "keeper", spans.alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans, joined where they touch."""

    def add(acc, x):  # noqa: ANN001, ANN202
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"])
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))))
        del last
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<start:int,end:int>>)"), add)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every duplicate passage cut out of its text, but for the smallest document's; n_chars follows, if docs has it.  Extra columns may have any names."""
    doc, tag, dup = free_names(docs, "dup_doc", "dup_tag", "dup_spans")
    spans = duplicate_passages(docs).select(F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("spans").alias(dup))
    rows = docs.join(spans, (F.col("doc_id").cast("long") == F.col(doc)) & (_tag() == F.col(tag)), "left").drop(doc, tag)

    def change(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [None] * len(texts)
        for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
            for w in W.words(texts.slice(i, 1), W.SPACE_WORDS):
                at, parts = 0, []
                for x in spans[i].as_py():
                    parts.append(w.data[at : w.start[x["start"]]].tobytes())
                    at = int(w.end[x["end"] - 1])
                out[i] = (b"".join(parts) + w.data[at:].tobytes()).decode()
        return pa.array(out, pa.string())

    return retexted(rows, change, dup)


def _word_counts(docs: DataFrame) -> DataFrame:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t-\r]+"))
    return docs.select(F.col("doc_id").cast("long"), _tag().alias("tag"), n.cast("long").alias("n_words"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = duplicate_passages(docs).withColumnRenamed("doc", "doc_id")
    dup = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return _word_counts(docs).join(found, ["doc_id", "tag"], "left").select("doc_id", "n_words", F.coalesce(dup, F.lit(0).cast("long")).alias("n_dup_words"), F.coalesce("keepers", F.expr("cast(array() as array<long>)")).alias("keepers"), F.coalesce("spans", none).alias("spans"))
