"""Vectorised word splitting and hashing straight from Arrow string buffers.

A chunk is a run of whole texts of one Arrow column.  Texts are never cut: a
text longer than ``max_bytes`` gets a chunk of its own.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of texts for a smaller chunk than the usual one: what a worker holds while it works on one, and keeps (tables of powers), is some 100 times that.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def _mask(data: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(data)] = True
    return out


#: Byte classes.  SPACE_WORDS: anything but ASCII white space; ALNUM_WORDS: ASCII digits and letters and every byte of non-ASCII characters.
SPACE_WORDS = ~_mask(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM_WORDS = _mask(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))[LOWER]  # upper and lower case of A-Z hash alike
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        for name, b in (("_pow", _BASE), ("_inv", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, b, dtype=U64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _pow, _inv


class Words(NamedTuple):
    """Words of a chunk: hashes, byte ranges in ``data``, and where each text's words begin."""

    first: int  # row of the chunk's first text
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray  # texts + 1
    text_at: np.ndarray  # texts + 1: byte offsets of the texts in data
    data: np.ndarray


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls have length 0."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0 or off is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def spans(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of whole texts of at most max_bytes together, or of one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def words(col: pa.Array, of: np.ndarray, max_bytes: int = 2 << 20) -> Iterator[Words]:
    """Words (runs of bytes in the class ``of``, ASCII letters in lower case) of each text, by chunk."""
    offsets, data = buffers(col)
    for a, b in spans(offsets, max_bytes):
        lo, hi = int(offsets[a]), int(offsets[b])
        buf, at = data[lo:hi], offsets[a : b + 1] - lo
        inside = np.zeros(hi - lo + 1, dtype=bool)
        inside[:-1] = of[buf]
        cut = at[1:-1]  # where a text begins that isn't the chunk's first
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[cut] = inside[cut]
        ends = ~inside
        ends[1:] &= inside[:-1]
        ends[0] = False
        inner = cut[(cut > 0)]
        ends[inner] = inside[inner - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        pw, inv = _powers(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum(_BYTE[buf] * pw[: hi - lo], out=acc[1:])
        h = mix((acc[e] - acc[s]) * inv[s] + (e - s).astype(U64))
        yield Words(a, h, s, e, np.searchsorted(s, at), at, buf)


def shingles(w: Words, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n consecutive words, and where each text's begin.  A text of fewer words has its whole sequence as one, if so asked."""
    h, ptr = w.hashes, w.ptr
    count = np.diff(ptr)
    full = np.maximum(count - n + 1, 0)
    out_n = np.where(full > 0, full, (count > 0).astype(np.int64) if whole_if_short else 0)
    out_ptr = np.concatenate([[0], np.cumsum(out_n)])
    out = np.zeros(int(out_ptr[-1]), dtype=U64)
    if len(h) >= n:
        roll = np.zeros(len(h) - n + 1, dtype=U64)
        for k in range(n):
            roll = mix(roll + h[k : len(h) - n + 1 + k] + U64(n))
        has = np.repeat(full > 0, out_n)
        pos = np.arange(len(out)) - np.repeat(out_ptr[:-1], out_n) + np.repeat(ptr[:-1], out_n)
        out[has] = roll[pos[has]]
    if whole_if_short:
        for i in np.flatnonzero((full == 0) & (count > 0)):
            acc = np.zeros(1, dtype=U64)
            for x in h[ptr[i] : ptr[i + 1]]:
                acc = mix(acc + x + U64(count[i]))
            out[out_ptr[i]] = acc[0]
    return out, out_ptr
