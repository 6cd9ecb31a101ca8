"""Edit-aware token counts: a sum tree over the pre-tokens of a document.

Operator 5.  A document's pre-tokens stand in blocks; a tree over the blocks
holds the sums of their tokens and characters.  An edit finds its blocks by
descending the tree, splits again only from two pre-tokens before the edit (the
pattern looks ahead no further) until a split falls on an old boundary behind
the edit, encodes the new pre-tokens, and adds the differences up the tree.

``trees`` makes the table of trees: each document's text with the characters and
tokens of its pre-tokens.  ``edited`` applies a column of edits to such a table
and encodes nothing but what they touch; with ``keep`` it gives the table after
them, for the edits to come.  ``edit_table`` does so for a table of edits.

A null text counts as empty.  Edits apply one after the other; their offsets are
in characters of the text as it is then, clipped to it; a null edit list or
replacement is empty.  Rows may repeat; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import RANKS
from .split import Remembered, splitter
from .store import arrow, table, written

BLOCK = 64
REMEMBER = 200_000  # pre-tokens, in each of two generations


class Counter:
    """Tokens of a pre-token, by the tiktoken library, remembered."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.split = splitter(pattern)
        self.memory = Remembered(REMEMBER)

    def __call__(self, pieces: list[str]) -> list[int]:
        get = self.memory.of(set(pieces), lambda new: [len(self.encoding.encode_ordinary(p)) for p in new])
        return list(map(get, pieces))


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


class CountTree:
    """Token counts of one text under edits.  ``encoded``: pre-tokens encoded so far."""

    def __init__(self, count: Counter, text: str, leaves: tuple[list[int], list[int]] | None = None):
        """The tree of a text, or of ``leaves``, the characters and tokens of its pre-tokens as ``leaves()`` gave them."""
        self.count, self.text, self.encoded = count, text, 0
        if leaves is None:
            pieces = count.split(text)
            self.encoded = len(pieces)
            leaves = list(map(len, pieces)), count(pieces)
        sizes, tokens = leaves
        self.blocks = [[sizes[i : i + BLOCK], tokens[i : i + BLOCK]] for i in range(0, len(sizes), BLOCK)] or [[[], []]]
        self._grow()

    def _grow(self) -> None:
        """The tree over the blocks: node k has the children 2k and 2k + 1."""
        n = 1 << (len(self.blocks) - 1).bit_length()
        self.leaf = n
        self.tokens = [0] * n + [sum(b[1]) for b in self.blocks] + [0] * (n - len(self.blocks))
        self.chars = [0] * n + [sum(b[0]) for b in self.blocks] + [0] * (n - len(self.blocks))
        for k in range(n - 1, 0, -1):
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return [x for b in self.blocks for x in b[0]], [x for b in self.blocks for x in b[1]]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last one, at the text's end), and where it begins."""
        k, begin = 1, 0
        while k < self.leaf:
            k *= 2
            if at >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.leaf, begin

    def _set(self, block: int, add_tokens: int, add_chars: int) -> None:
        k = block + self.leaf
        while k:
            self.tokens[k] += add_tokens
            self.chars[k] += add_chars
            k //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts ``new`` for text[start:end]."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        text = self.text[:start] + new + self.text[end:]
        first, begin = self._find(max(0, start - 1))
        while first and start - begin < 3 or first and sum(1 for _ in self._before(first, begin, start)) < 3:
            first -= 1
            begin -= sum(self.blocks[first][0])
        # pre-tokens that end before the edit, but for the last two, stay
        sizes, at, keep = self.blocks[first][0], begin, 0
        ends = []
        for s in sizes:
            if at + s >= start:
                break
            at += s
            ends.append(at)
        keep = max(0, len(ends) - 2)
        at = ends[keep - 1] if keep else begin
        # whether old boundaries are met again
        shift = len(new) - (end - start)
        block, place = first, keep
        old_at = at
        added: list[str] = []
        match = self.count.pattern.match
        pos, pos_end = at, len(text)
        while pos < pos_end:
            m = match(text, pos)
            added.append(m.group())
            pos = m.end()
            if pos >= start + len(new):
                while block < len(self.blocks) and old_at < pos - shift:
                    b = self.blocks[block][0]
                    if place == len(b):
                        block, place = block + 1, 0
                        continue
                    old_at += b[place]
                    place += 1
                if old_at == pos - shift and old_at >= end:
                    break
        else:
            block, place = len(self.blocks) - 1, len(self.blocks[-1][0])
        self.encoded += len(added)
        tokens = self.count(added)
        head, tail = self.blocks[first], self.blocks[block]
        merged = [head[0][:keep] + list(map(len, added)) + tail[0][place:], head[1][:keep] + tokens + tail[1][place:]]
        self.text = text
        if block == first and len(merged[0]) <= 2 * BLOCK:
            self._set(first, sum(merged[1]) - sum(head[1]), sum(merged[0]) - sum(head[0]))
            self.blocks[first] = merged
        else:
            self.blocks[first : block + 1] = [[merged[0][i : i + BLOCK], merged[1][i : i + BLOCK]] for i in range(0, len(merged[0]), BLOCK)] or [[[], []]]
            self._grow()

    def _before(self, block: int, begin: int, start: int) -> Iterator[int]:
        for s in self.blocks[block][0]:
            begin += s
            if begin >= start:
                return
            yield begin


TREE = "doc_id long, text string, sizes binary, tokens binary"
COUNTS = ["doc_id", "n_pieces", "n_tokens", "n_tokens_edited", "n_reencoded"]
EDIT = "array<struct<start:long,end:long,text:string>>"
ROUND = 1000  # edits of one document that a task holds at a time


def packed(x: list[int]) -> bytes:
    """Numbers in one, two or four bytes each, as the largest needs, behind a byte that says so."""
    width = 1 if max(x, default=0) < 1 << 8 else 2 if max(x) < 1 << 16 else 4
    return bytes([width]) + np.array(x, dtype=f"<u{width}").tobytes()


def numbers(x: bytes) -> list[int]:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).tolist()


def trees(docs: DataFrame, path: str = RANKS, make: Callable[[str], Counter] = counter) -> DataFrame:
    """doc_id, text, and the characters (sizes) and tokens of its pre-tokens, packed: what a tree is grown from without encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = make(path)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            pieces = [c.split(t) for t in texts]
            sizes, tokens = [packed(list(map(len, p))) for p in pieces], [packed(c(p)) for p in pieces]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.binary()), pa.array(tokens, pa.binary())], names=["doc_id", "text", "sizes", "tokens"])

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, TREE)


def edited(table_of_trees: DataFrame, edits: str | None, path: str = RANKS, keep: bool = False, make: Callable[[str], Counter] = counter) -> DataFrame:
    """Counts of each tree before and after its ``edits`` (an expression of type EDIT), and n_reencoded, the pre-tokens encoded for them; with ``keep`` also the tree after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = make(path)
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for t, sizes, tokens, es in zip(*(b.column(i) for i in range(1, 5)), strict=True):
                leaves = numbers(sizes.as_py()), numbers(tokens.as_py())
                tree = CountTree(c, t.as_py(), leaves)
                n, before = len(leaves[0]), tree.n_tokens
                for e in es.as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                after = (tree.text, *map(packed, tree.leaves())) if keep else ()
                for col, v in zip(out, (n, before, tree.n_tokens, tree.encoded, *after), strict=False):
                    col.append(v)
            more = [pa.array(out[4], pa.string()), pa.array(out[5], pa.binary()), pa.array(out[6], pa.binary())] if keep else []
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in out[:4]), *more], names=COUNTS + ["text", "sizes", "tokens"] * keep)

    rows = table_of_trees.select("doc_id", "text", "sizes", "tokens", (F.expr(edits) if edits else F.lit(None)).cast(EDIT).alias("edits"))
    return arrow(rows, run, ", ".join(f"{c} long" for c in COUNTS) + ", text string, sizes binary, tokens binary" * keep)


def edit_table(table_of_trees: DataFrame, edits: DataFrame, path: str = RANKS) -> DataFrame:
    """The table of trees after a table of edits (doc_id, seq, start, end, text), each document's in the order of seq.

    A document's edits build on each other, so they are applied ROUND at a time,
    with the table written in between.  A document's trees that repeat are all
    edited; edits of documents that aren't there, or with a null doc_id, do
    nothing.
    """
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "start", "end", "text"))
    e = written(edits.where("doc_id is not null").select(F.col("doc_id").cast("long"), "seq", F.col("start").cast("long"), F.col("end").cast("long"), "text").withColumn("round", F.floor((n - 1) / ROUND)), "edits")
    for r in range((e.agg(F.max("round")).first()[0] or 0) + 1):
        one = e.where(F.col("round") == r).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "text"))), lambda x: F.struct(x["start"], x["end"], x["text"])).alias("edits"))
        touched = edited(table_of_trees.join(one, "doc_id"), "edits", path, keep=True).select("doc_id", "text", "sizes", "tokens")
        table_of_trees = written(table_of_trees.join(one, "doc_id", "left_anti").unionByName(touched), "trees", "zstd")
    return table_of_trees


def counted(docs: DataFrame, edits: str | None = None, path: str = RANKS) -> DataFrame:
    """doc_id, n_pieces, n_tokens of each row's text, and with ``edits`` (an expression over doc_id and text) n_tokens_edited after them and n_reencoded; by a written table of trees."""
    return edited(written(trees(docs, path), "trees", "zstd"), edits, path)


#: The query's edits of every text: forty characters in the middle give way to a phrase, a quarter in a word is put in, at three quarters ten characters go, and a line is added.
EDITS = """array(
  named_struct('start', cast(n div 2 as bigint), 'end', cast(n div 2 + 40 as bigint), 'text', ' an edited passage, 2024 '),
  named_struct('start', cast(n div 4 as bigint), 'end', cast(n div 4 as bigint), 'text', 'in\\'s'),
  named_struct('start', cast(n * 3 div 4 as bigint), 'end', cast(n * 3 div 4 + 10 as bigint), 'text', ''),
  named_struct('start', cast(n + 100 as bigint), 'end', cast(n + 100 as bigint), 'text', '\\n One more line.'))"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = written(trees(table(spark, sf_dir, "documents")), "trees", "zstd")
    return edited(kept.withColumn("n", F.length("text")), EDITS)
