"""Phrase collocations by vertical positional lists.

Operator 11.  Texts (A-Z lower-cased) are split at SEPARATORS into pieces and those
at blanks and tabs into words.  Words of one language are packed into buckets of
about BUCKET words; a bucket's words have places, with a free place between pieces,
and an inverted list holds the places of each word.  Level by level lists grow: the
occurrences of a frequent phrase of k - 1 words are merge-joined by place with what
stands one place on, the frequent phrase of k - 1 words that ends with the adjacent
word, so what comes out are the lists of phrases of k words both of whose parts are
frequent, and no other phrase can be.

A phrase's id is a 64-bit hash of its language and word, or of its two parts' ids.  A
bucket deals the ids and lengths of its lists into ranges of ids, each packed; a range
sums the lengths of an id over buckets, which is its exact frequency, and sends back
to each bucket which of its lists are frequent, and to the first of them how frequent.
So what is shuffled is a few bytes for each bucket and phrase, in one row for each
bucket and range; there are as many ranges as keep RANGE ids in each.  (Where ranges
outnumber a bucket's lists, a row holds one list.)

Frequent phrases carry the frequencies of all their first and last words, so scores
need no look-up.  A frequent phrase within a longer one of the same frequency is
within one that is a word longer: dropping looks one level up only.

Null texts are empty, a null language is "und".  Repeated rows count.  Texts of any
length are whole: a bucket ends after a text.  Phrases are told apart by their ids:
among 10^8 frequent and 10^10 rare ones one collision is expected in 18 such corpora.
Counts are longs, products decimals of 38 digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from . import words as W
from .split import forget
from .store import Scratch, arrow, limit_batches, table, written

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Words of a bucket, but for its last text's, and words that a worker holds for all languages.
BUCKET, HELD = 1 << 19, 1 << 21
LEAST, LONGEST, FIRST = 100, 5, 2000
#: Ids of a range on average, and the least power of two of ranges.
RANGE, RANGES = 1 << 22, 6

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[list(SEPARATORS)] = True
_WORD = ~_SEPARATOR
_WORD[[0x20, 0x09]] = False


def _planes(v: np.ndarray) -> bytes:
    """Numbers of one width byte by byte, so that zstd meets the bytes of one weight together."""
    flat = np.ascontiguousarray(v).view(np.uint8).reshape(-1, v.itemsize).T
    return len(v).to_bytes(8, "little") + (pa.compress(np.ascontiguousarray(flat).tobytes(), codec="zstd", asbytes=True) if len(v) else b"")


def _of_planes(b: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    flat = np.frombuffer(pa.decompress(b[8:], width * n, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(flat.T).view(kind).ravel()


def _packed(v: np.ndarray) -> bytes:
    return _planes(v.astype("<i4"))


def _unpacked(b: bytes) -> np.ndarray:
    return _of_planes(b, "<i4")


def _packed_lists(lists: np.ndarray, length: np.ndarray) -> bytes:
    """The list of each occurrence, as its place among the lists by length: long lists, which occur most, get small numbers."""
    place = np.empty(len(length), dtype=np.int64)
    place[np.argsort(-length, kind="stable")] = np.arange(len(length))
    return _packed(place[lists])


def _unpacked_lists(lists: bytes, length: bytes) -> np.ndarray:
    return np.argsort(-_unpacked(length), kind="stable")[_unpacked(lists)]


def _packed_ids(v: np.ndarray) -> bytes:
    """64-bit numbers as the steps between them."""
    return _planes(np.diff(np.ascontiguousarray(v).view(W.U64), prepend=W.U64(0)))


def _unpacked_ids(b: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(b, "<u8"), dtype=W.U64)


def _ids(names: bytes, parts: bytes | None, lang: str) -> np.ndarray:
    """The ids of a bucket's lists: of words by their hashes, of longer phrases by the ids of their two parts (``names``: number of the first times how many there are, plus number of the rest)."""
    names = _unpacked_ids(names)
    if parts is None:
        of = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
        return W.mix(names + W.mix(np.array([of], dtype=W.U64)))
    first, rest = _parts(names, parts)
    return W.mix(W.mix(first + W.U64(1)) + rest)


def _parts(names: np.ndarray, parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = _unpacked_ids(parts)
    n = W.U64(max(len(parts), 1))
    return parts[names // n], parts[names % n]


class _Held:
    """Words of one language on their way to a bucket."""

    def __init__(self):
        self.hashes, self.places, self.text, self.n, self.last = [], [], {}, 0, -2

    def add(self, w: W.Words, a: int, z: int, step: np.ndarray) -> None:
        """The words a to z of a chunk; step: 1, or 2 where a piece begins."""
        h = w.hashes[a:z]
        places = self.last + np.cumsum(step[a:z])
        self.hashes.append(h)
        self.places.append(places)
        self.last, self.n = int(places[-1]), self.n + z - a

    def bucket(self, number: int, lang: str) -> dict:
        h, places = np.concatenate(self.hashes), np.concatenate(self.places)
        name, ids, count = np.unique(h, return_inverse=True, return_counts=True)
        return {"bucket": number, "lang": lang, "n": self.n, "places": _packed(np.diff(places, prepend=0)), "lists": _packed_lists(ids, count), "names": _packed_ids(name), "parts": None, "length": _packed(count), "size": len(name), "word": [self.text[k] for k in name.tolist()]}


def _postings(docs: DataFrame) -> DataFrame:
    """Buckets: bucket, lang, n, the place of each occurrence (as steps) and the number of its list, and each list's name, length and word."""
    kinds = pa.schema([("bucket", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *((c, pa.binary()) for c in ("places", "lists", "names", "parts", "length")), ("size", pa.int64()), ("word", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, _Held] = {}
        number = TaskContext.get().partitionId() << 32

        def out(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([held.pop(lang).bucket(number, lang)], schema=kinds)

        for b in batches:
            langs = b.column(0).to_pylist()
            for w in W.words(b.column(1), _WORD):
                if not len(w.hashes):
                    continue
                apart = np.concatenate([[0], np.cumsum(_SEPARATOR[w.data])])
                step = np.where(np.concatenate([[True], apart[w.start[1:]] > apart[w.end[:-1]]]), 2, 1)
                step[w.ptr[:-1][np.diff(w.ptr) > 0]] = 2
                raw = W.LOWER[w.data].tobytes()
                for i in range(len(w.ptr) - 1):
                    a, z = int(w.ptr[i]), int(w.ptr[i + 1])
                    if a == z:
                        continue
                    lang = langs[w.first + i]
                    to = held.setdefault(lang, _Held())
                    to.add(w, a, z, step)
                    h, s, e = w.hashes[a:z].tolist(), w.start[a:z].tolist(), w.end[a:z].tolist()
                    known = to.text
                    for k in {k: j for j, k in enumerate(h) if k not in known}.values():
                        known[h[k]] = raw[s[k] : e[k]]
                    if to.n >= BUCKET:
                        yield out(lang)
                    elif sum(x.n for x in held.values()) > HELD:
                        yield out(max(held, key=lambda x: held[x].n))
        for lang in list(held):
            yield out(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow(rows, run, "bucket long, lang string, n long, places binary, lists binary, names binary, parts binary, length binary, size long, word array<binary>")


def _dealt(lists: DataFrame, bits: int) -> DataFrame:
    """Each bucket's ids and lengths by range, the first ``bits`` bits of an id: bucket, range, ids, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, length = _ids(r["names"], r["parts"], r["lang"]), _unpacked(r["length"])
                order = np.argsort(ids, kind="stable")
                ids, length = ids[order], length[order]
                of = (ids >> W.U64(64 - bits)).astype(np.int64)
                at = np.concatenate([np.flatnonzero(np.diff(of, prepend=-1)), [len(of)]])
                out = [{"bucket": r["bucket"], "range": int(of[u]), "ids": _packed_ids(ids[u:v]), "length": _packed(length[u:v])} for u, v in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("range", pa.int64()), ("ids", pa.binary()), ("length", pa.binary())]))

    return arrow(lists.select("bucket", "lang", "names", "parts", "length"), run, "bucket long, range long, ids binary, length binary")


def _summed(dealt: DataFrame, least: int) -> DataFrame:
    """Of each bucket and range with frequent ids: which they are, in the order of ids (bits), and the frequency of those that the bucket is the first to hold, 0 of others."""

    def run(t: pa.Table) -> pa.Table:
        ids = [_unpacked_ids(x) for x in t["ids"].to_pylist()]
        end = np.cumsum([len(x) for x in ids]).tolist()
        ids, length = np.concatenate(ids), np.concatenate([_unpacked(x) for x in t["length"].to_pylist()])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        f = np.add.reduceat(length[order], head, dtype=np.int64)
        frequent = f >= least
        kept, told = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=np.int64)
        kept[order] = np.repeat(frequent, np.diff(head, append=len(ids)))
        told[order[head[frequent]]] = f[frequent]
        out = []
        for bucket, which, u, v in zip(t["bucket"].to_pylist(), t["range"].to_pylist(), [0, *end], end):  # noqa: B905
            if kept[u:v].any():
                out.append({"bucket": bucket, "range": which, "kept": np.packbits(kept[u:v]).tobytes(), "told": _packed_ids(told[u:v][kept[u:v]])})
        return pa.Table.from_pylist(out, schema=pa.schema([("bucket", pa.int64()), ("range", pa.int64()), ("kept", pa.binary()), ("told", pa.binary())]))

    ship(dealt.sparkSession)
    limit_batches(dealt.sparkSession)
    return dealt.groupBy("range").applyInArrow(run, "bucket long, range long, kept binary, told binary")


def _frequent(row: dict, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of a bucket's frequent lists in ascending order, their ids, and the frequencies that it tells (0: another bucket does)."""
    ids = _ids(row["names"], row["parts"], row["lang"])
    order = np.argsort(ids, kind="stable")
    edge = np.searchsorted((ids[order] >> W.U64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    local, told = [], []
    for x in row["known"]:
        u, v = int(edge[x["range"]]), int(edge[x["range"] + 1])
        local.append(order[u:v][np.unpackbits(np.frombuffer(x["kept"], np.uint8), count=v - u).astype(bool)])
        told.append(_unpacked_ids(x["told"]))
    local, told = np.concatenate(local), np.concatenate(told)
    order = np.argsort(local)
    return local[order], ids[local[order]], told[order].view(np.int64)


_TOLD = pa.struct([("id", pa.int64()), ("f", pa.int64()), ("word", pa.binary()), ("first", pa.int64()), ("rest", pa.int64())])


def _told(row: dict, local: np.ndarray, ids: np.ndarray, f: np.ndarray) -> pa.Array:
    """The frequent phrases that a bucket tells of: id, f, and the word or the ids of the two parts."""
    local, ids, f = local[f > 0], ids[f > 0], f[f > 0]
    none = pa.nulls(len(local), pa.int64())
    if row["parts"] is None:
        word, first, rest = pa.array([row["word"][k] for k in local.tolist()], pa.binary()), none, none
    else:
        word = pa.nulls(len(local), pa.binary())
        first, rest = (pa.array(x.view(np.int64)) for x in _parts(_unpacked_ids(row["names"])[local], row["parts"]))
    return pa.StructArray.from_arrays([pa.array(ids.view(np.int64)), pa.array(f), word, first, rest], fields=list(_TOLD))


def _extended(lists: DataFrame, bits: int, grow: bool) -> DataFrame:
    """The lists of phrases a word longer, from lists and which of them are frequent, and those that each bucket tells of; without ``grow`` these alone."""
    names = ["bucket", "lang", "places", "lists", "names", "parts", "length", "size", "word", "told"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = np.cumsum(_unpacked(r["places"] or bytes(8)), dtype=np.int64)
                which = _unpacked_lists(r["lists"] or bytes(8), r["length"] or bytes(8))
                local, ids, f = _frequent(r, bits)
                kept = np.full(int(max(which.max(initial=-1), local.max(initial=-1))) + 1, -1, dtype=np.int64)
                kept[local] = np.arange(len(local))
                which = kept[which]
                at, which = at[which >= 0], which[which >= 0]
                # occurrences are in the order of their places, so the merge-join is with the next one
                next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
                pair = which[next_to] * len(local) + which[next_to + 1]
                name, lists_, count = np.unique(pair, return_inverse=True, return_counts=True)
                told = _told(r, local, ids, f)
                cols = [pa.array([r["bucket"]], pa.int64()), pa.array([r["lang"]]), *(pa.array([x], pa.binary()) for x in (_packed(np.diff(at[next_to], prepend=0)), _packed_lists(lists_, count), _packed_ids(name), _packed_ids(ids), _packed(count)))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(name)], pa.int64()), pa.nulls(1, pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told)], names=names)

    occurrences = [c if grow else F.lit(None).cast("binary").alias(c) for c in ("places", "lists", "length")]
    return arrow(lists.select("bucket", "lang", *occurrences, "names", "parts", "word", "known"), run, "bucket long, lang string, places binary, lists binary, names binary, parts binary, length binary, size long, word array<binary>, told array<struct<id:long,f:long,word:binary,first:long,rest:long>>")


def frequent_phrases(docs: DataFrame, least: int, longest: int, to: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), and for each length the phrases that stand ``least`` times and more: id, lang, phrase, last (word), f, heads and tails (frequencies of the first and last 1, 2, ... words), from the second on first and rest (ids of the phrases without the last and the first word)."""
    lists = to.keep(_postings(docs), "postings", "zstd")
    total = to.keep(lists.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    one = F.array("f")
    levels: list[DataFrame] = []
    for k in range(1, longest + 1):
        ids = lists.agg(F.sum("size")).first()[0] or 0
        bits = max(RANGES, (ids // RANGE).bit_length())
        known = to.keep(_summed(_dealt(lists, bits), least), "known", "zstd")
        marked = lists.join(known.groupBy("bucket").agg(F.collect_list(F.struct("range", "kept", "told")).alias("known")), "bucket")
        # buckets pass a shuffle once a level: the next lists and what is told of these come together
        before, lists = lists, to.keep(_extended(marked, bits, k < longest), "lists", "zstd")
        to.drop(before, known)
        told = lists.select("lang", F.inline("told"))
        if k == 1:
            word = F.col("word").cast("string")
            levels.append(to.keep(told.select("id", "lang", word.alias("phrase"), word.alias("last"), "f", one.alias("heads"), one.alias("tails")), "phrases", "zstd"))
        else:
            a = levels[-1].select(F.col("id").alias("first"), F.col("phrase").alias("p"), "heads")
            b = levels[-1].select(F.col("id").alias("rest"), "last", "tails")
            grown = told.join(a, "first").join(b, "rest")
            levels.append(to.keep(grown.select("id", "lang", F.concat_ws(" ", "p", "last").alias("phrase"), "last", "f", F.concat("heads", one).alias("heads"), F.concat("tails", one).alias("tails"), "first", "rest"), "phrases", "zstd"))
    return total, levels


def _scored(f: Column, n: Column, heads: Column, tails: Column, longest: int) -> Column:
    """The lowest-scoring cut: score, k, l, r."""
    whole = lambda c: c.cast("decimal(38,0)")

    def cut(k: Column) -> Column:
        l, r = F.element_at(heads, k), F.element_at(tails, F.size(heads) - k)
        return F.struct(F.call_function("div", whole(F.lit(1000)) * whole(f) * whole(n), whole(l) * whole(r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(heads) - 1), cut))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (all long but the first and third): each language's phrases of 2 to ``longest`` words in the order of score, frequency and phrase."""
    with Scratch(docs.sparkSession) as to:
        total, levels = frequent_phrases(docs, least, longest, to)
        out = None
        for k in range(1, longest):
            mine = levels[k]
            if k + 1 < longest:
                up = levels[k + 1].select("first", "rest", F.col("f").alias("g"))
                within = up.select(F.col("first").alias("id"), "g").union(up.select(F.col("rest").alias("id"), "g")).groupBy("id").agg(F.max("g").alias("g"))
                mine = mine.join(within, "id", "left").where("g is null or g < f")
            mine = mine.select("lang", "phrase", "f", "heads", "tails")
            out = mine if out is None else out.union(mine)
        x = out.join(total, "lang").withColumn("cut", _scored(F.col("f"), F.col("n"), F.col("heads"), F.col("tails"), longest))
        x = x.select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        x = x.withColumn("rank", rank)
        x = x.where(F.col("rank") <= top) if top is not None else x
        return written(x.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_phrases": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
total as (select lang, sum(len(w))::bigint as n from w group by lang),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from w, range(1, 6) a(k), range(1, len(w) - k + 2) b(i) group by all),
c as (select * from grams where k > 1 and f >= 100),
kept as (select * from c where not exists (select 1 from c y where y.lang = c.lang and y.k > c.k and y.f >= c.f and contains(' ' || y.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (select lang, phrase, k, f as a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') as head, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') as tail from kept, range(1, 5) t(j) where j < k),
scored as (select cuts.lang, cuts.phrase, a, h.f as l, t.f as r, n, ((1000::hugeint * a * n) // (h.f::hugeint * t.f))::bigint as score, j
  from cuts join total using (lang) join grams h on h.lang = cuts.lang and h.k = cuts.j and h.phrase = cuts.head join grams t on t.lang = cuts.lang and t.k = cuts.k - cuts.j and t.phrase = cuts.tail),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, rank, phrase, a, l, r, n, score from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best) where rank <= 2000
"""
}
