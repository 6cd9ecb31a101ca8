"""Byte-level BPE by prefix dynamic programming.

Operator 9.  For each prefix of a piece there is exactly one token that can end
it: the token t = piece[j:i] for which (last token of piece[:j], t) is a pair
that BPE leaves as it is.  Storing that token for each prefix makes appending
exact and local, and after an edit only the prefixes from the edit on are
redone, until as many in a row as the longest token has bytes agree with the
stored ones.

Which tokens end a prefix is told by an automaton over the beginnings of tokens,
a step a byte.  Whether a pair stays is told by how its two tokens were merged:
undone step by step, latest first, no two parts that lie side by side between
them may have a token that would have been merged earlier.

The ids are those that merging by rank gives: each match of the split pattern on
its own, no special tokens.  A null text counts as empty and has no ids.  Text
is never normalised or cut.  Rows may repeat; other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .split import Remembered, splitter
from .store import arrow, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pieces that one Python worker remembers in each of two generations, and pairs of tokens and steps of the automaton that it remembers at all.
REMEMBER, PAIRS, STEPS = 250_000, 400_000, 400_000


def _merge(ranks: dict[bytes, int], data: bytes, below: int | None = None) -> list[bytes]:
    """data, merged by rank (only ranks under ``below``)."""
    parts = [data[i : i + 1] for i in range(len(data))]
    top = below if below is not None else 1 << 60
    while len(parts) > 1:
        best, at = top, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixCodec:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = splitter(pattern)
        self._pairs: dict[int, bool] = {}
        self._made: dict[int, tuple[int, ...] | None] = {}
        self._begun = {b[:i] for b in self.ranks for i in range(1, len(b) + 1)}
        self._no_steps()
        self.memory = Remembered(REMEMBER)
        self.decimal = {i: b"%d" % i for i in self.tokens}

    def _no_steps(self) -> None:
        """An automaton without steps.  A state is the longest end of what was read that some token begins with; it has the tokens it ends with and their lengths, longest first."""
        self._steps: dict[int, int] = {}
        self._states, self._number, self._ends = [b""], {b"": 0}, [()]

    def _step(self, step: int) -> int:
        """The state after ``step``: a state's number and a byte."""
        s = self._states[step >> 8] + bytes([step & 255])
        while s and s not in self._begun:
            s = s[1:]
        n = self._number.get(s)
        if n is None:
            n = self._number[s] = len(self._states)
            self._states.append(s)
            self._ends.append(tuple((t, len(s) - j) for j in range(len(s)) if (t := self.ranks.get(s[j:])) is not None))
        self._steps[step] = n
        return n

    def made(self, t: int) -> tuple[int, ...] | None:
        """The two tokens that were merged last for t, none for a byte; None if merges of lower ranks don't lead to two."""
        got = self._made.get(t, ())
        if got == () and t not in self._made:
            parts = _merge(self.ranks, self.tokens[t], t)
            got = self._made[t] = () if len(self.tokens[t]) == 1 else tuple(map(self.ranks.__getitem__, parts)) if len(parts) == 2 else None
        return got

    def _stay(self, a: int, b: int) -> bool:
        x, y, below = a, b, 1 << 60
        while True:
            left, right = self.made(x), self.made(y)
            if left is None or right is None:
                return _merge(self.ranks, self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]
            t = self.ranks.get(self.tokens[x] + self.tokens[y])
            if t is not None and t < below:
                return False
            # of equal merges the left one comes first
            if left and (not right or x > y):
                below, x = x, left[1]
            elif right:
                below, y = y + 1, right[0]
            else:
                return True

    def stays(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a and b, side by side, as they are; with a = -1, whether merging b's bytes gives b itself."""
        got = self._pairs.get(a << 32 | b)
        if got is None:
            got = self._pairs[a << 32 | b] = self._stay(a, b) if a >= 0 else bool(self.made(b)) or _merge(self.ranks, self.tokens[b]) == [self.tokens[b]]
        return got

    def last_token(self, data: bytes, last: list[int], i: int) -> int:
        """The one token that can end the prefix of length i, from those of the shorter ones."""
        get = self.ranks.get
        for j in range(max(0, i - self.longest), i):
            t = get(data[j:i])
            if t is not None and self.stays(last[j], t):
                return t
        raise ValueError("a byte has no token")

    def prefixes(self, data: bytes, last: list[int] | None = None, states: list[int] | None = None) -> list[int]:
        """The last token of each prefix; place 0 is unused.  ``last`` and ``states``: those of the prefixes known already, which are added to."""
        last, states = [-1] if last is None else last, [0] if states is None else states
        known, s = len(last), states[-1]
        steps, ends, pairs = self._steps.get, self._ends, self._pairs.get
        for i, byte in enumerate(data[known - 1 :], known):
            step = s << 8 | byte
            s = steps(step)
            if s is None:
                s = self._step(step)
            states.append(s)
            for t, n in ends[s]:
                before = last[i - n]
                ok = pairs(before << 32 | t)
                if ok or ok is None and self.stays(before, t):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte has no token")
        return last

    def read(self, data: bytes, last: list[int]) -> list[int]:
        """The ids, read backwards from the last tokens."""
        if data in self.ranks:  # a whole piece that is a token stays one
            return [self.ranks[data]]
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def pieces(self, pieces: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """The ids of each piece; what a piece begins with as the one before it did is not worked out again."""
        before, last, states = b"", [-1], [0]
        for data in pieces:
            t = self.ranks.get(data)
            if t is not None:
                yield (t,)
                continue
            same = next((i for i, (x, y) in enumerate(zip(before, data, strict=False)) if x != y), min(len(before), len(data)))
            del last[same + 1 :], states[same + 1 :]
            before = data
            yield tuple(self.read(data, self.prefixes(data, last, states)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; what a piece gives is remembered."""
        split = [self.split(t) for t in texts]
        if len(self._pairs) > PAIRS:
            self._pairs = {}
        if len(self._steps) > STEPS:
            self._no_steps()
        get = self.memory.of(set().union(*split), lambda new: new.sort() or self.pieces(map(str.encode, new)))
        return [list(chain.from_iterable(map(get, ps))) for ps in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditablePiece:
    """One piece whose encoding follows appends and edits."""

    def __init__(self, codec: PrefixCodec, data: bytes = b""):
        self.codec, self.data, self.last, self.redone = codec, data, codec.prefixes(data), len(data)

    def append(self, more: bytes) -> None:
        self.replace(len(self.data), len(self.data), more)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Puts ``new`` for data[start:end]; ``redone`` tells how many prefixes were worked out again."""
        old, tail = self.last, len(self.data) - end
        data = self.data[:start] + new + self.data[end:]
        last, same, self.redone = self.last[: start + 1], 0, 0
        for i in range(start + 1, len(data) + 1):
            last.append(self.codec.last_token(data, last, i))
            self.redone += 1
            before = i - len(data) + len(self.data)
            same = same + 1 if i > len(data) - tail and before > end and old[before] == last[i] and len(self.codec.tokens[last[i]]) <= i - start - len(new) else 0
            if same >= self.codec.longest:
                last += old[before + 1 :]
                break
        self.data, self.last = data, last

    def ids(self) -> list[int]:
        return self.codec.read(self.data, self.last)


_codecs: dict[tuple[str, str], PrefixCodec] = {}


def codec(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> PrefixCodec:
    """The worker's codec for a file; it keeps what it learnt from task to task."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = PrefixCodec(path, pattern)
    return _codecs[path, pattern]


def encoded(docs: DataFrame, path: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs, and ids array<int> of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                ids = c.encode_batch([t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "token_ids"])

    rows = docs.select("text", *keep)
    return arrow(rows, run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "token_ids array<int>"]))


def decoded(rows: DataFrame, path: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, and the text that token_ids stand for (bytes that aren't UTF-8 become U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = [None if x is None else c.decode(x).decode("utf-8", "replace") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*keep, "text"])

    return arrow(rows.select("token_ids", *keep), run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "text string"]))


def round_trips(docs: DataFrame, path: str = RANKS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_tokens, decoded_sha256 (of the bytes that the ids decode to) and token_ids; encoded and decoded by one worker, a few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for part in (b.slice(i, 100) for i in range(0, b.num_rows, 100)):
                ids = c.encode_batch([t or "" for t in part.column(0).to_pylist()])
                back = [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(map(len, ids), pa.int64()), pa.array(back), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "n_tokens", "decoded_sha256", "token_ids"])

    rows = docs.select("text", *keep)
    return arrow(rows, run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, decoded_sha256 string, token_ids array<int>"]))


def digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids, back = [], [], []
            for i in range(0, b.num_rows, 100):
                for got in c.encode_batch([t or "" for t in b.column(1).slice(i, 100).to_pylist()]):
                    n.append(len(got))
                    ids.append(hashlib.sha256(b" ".join(map(c.decimal.__getitem__, got))).hexdigest())
                    back.append(hashlib.sha256(c.decode(got)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
