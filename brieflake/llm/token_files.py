"""Token ids in binary shards under a minimal perfect hash index.

Operator 4.  Format of a shard, little-endian:

* ``shard-00000.bin``: the raw ids and nothing else, documents in ascending id
  order, an end id after each; 2 bytes an id if the vocabulary allows, else 4.
* ``shard-00000.idx``: ``BRIEFIDX``, uint32 version, uint32 bytes an id, uint64
  documents, keys and levels, each level's uint64 bits and place in the file; then
  the documents' ids (int64), null flags, first ids (uint64, one more than
  documents), a record for each slot (32-bit fingerprint, first document, how many
  share the key), and the levels of the hash: blocks of a rank and 512 bits.
* ``manifest.json``: shards in order with documents, ids, nulls, least and greatest key.

A key is found in constant time: the head tells where the levels lie, one block of
a level or a few gives the slot, its record's fingerprint tells strangers, the
offsets give the bytes to read.  Rows that repeat an id lie side by side and share
a slot.  A null id comes first and has a key of its own; a null or empty text has
the end id only.  An empty table gives no shards.

Ids are the tokenizers library's: a text that holds an added token goes to its
``encode`` whole; any other is split by the tokenizer's pattern, and each new
pre-token goes to the library's model.

Shards are ranges of (id, hash of the text, row), so that one id may hold any
share of the rows.  Each is written under a temporary name and renamed, so a
task that runs again puts the same file in place.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .split import Remembered, splitter
from .store import arrow, new_dir, table
from .words import U64, mix

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
REMEMBER = 600_000  # pre-tokens, in each of two generations
#: Bytes of text in a shard: at most MOST on average; where fewer shards than the session has cores would come of it, down to LEAST.
MOST, LEAST = 64 << 20, 2 << 20
_MAGIC = b"BRIEFIDX"
_NULL_KEY = np.uint64(0x6E756C6C)


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others in turn for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(rest)}


_SIGNS = _byte_level()


class Pieces:
    """The tokenizers library on pre-tokens, each remembered as its ids' bytes, and on whole texts where they hold an added token or the tokenizer changes texts first."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), *added, 0) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        whole = "" if self.tokenizer.normalizer is not None else "|".join(re.escape(x.content) for x in added.values())
        self.whole = re.compile(whole).search if whole or self.tokenizer.normalizer is not None else lambda text: None
        self.split = splitter(pattern)
        self.memory = Remembered(REMEMBER)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, end to end."""
        split = [() if self.whole(t) else self.split(t) for t in texts]
        get = self.memory.of(set().union(*split), self._encoded)
        return [array(self.code, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if self.whole(t) else b"".join(map(get, ps)) for t, ps in zip(texts, split, strict=True)]

    def _encoded(self, new: list[str]) -> list[bytes]:
        """The tokenizer's own model on each pre-token, its bytes spelt in the byte-level alphabet."""
        tokenize, code, signs = self.tokenizer.model.tokenize, self.code, _SIGNS
        spelt = ["Ġ" + p[1:] if p[0] == " " and p[1:].isalpha() and p.isascii() else p.encode().decode("latin-1").translate(signs) for p in new]
        return [array(code, [t.id for t in tokenize(s)]).tobytes() for s in spelt]


_pieces: dict[tuple[str, str], Pieces] = {}


def pieces(path: str, pattern: str) -> Pieces:
    if (path, pattern) not in _pieces:
        _pieces[path, pattern] = Pieces(path, pattern)
    return _pieces[path, pattern]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level the keys that meet no other take a bit, the rest go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        before, self.ranks = 0, []
        for bits in levels:
            r = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64) + before
            before = int(r[-1])
            self.ranks.append(r)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = max(64, 2 * len(rest))
            at = cls._place(rest, len(levels), size)
            once = np.bincount(at, minlength=size) == 1
            levels.append(once)
            rest = rest[~once[at]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64(level * 0x9E3779B9 + 1)) % U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 for some keys that aren't in it (others get a stranger's slot)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = self._place(keys[todo], k, len(bits))
            here = bits[at]
            out[todo[here]] = self.ranks[k][at[here]]
            todo = todo[~here]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)


def as_keys(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Ids as hash keys; a bijection on ids, and one more key for null."""
    return np.where(null, _NULL_KEY, mix(ids.astype(np.int64).view(U64) + U64(1)))


_BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])
_SLOT = np.dtype([("print", "<u4"), ("row", "<u8"), ("many", "<u8")])
_HEAD = 40  # bytes before the levels' places


class Index:
    """What a shard's .idx file holds."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, first: np.ndarray, width: int):
        self.ids, self.null, self.first, self.width = ids, null, first, width

    def hashed(self) -> Index:
        keys = as_keys(self.ids, self.null)
        change = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        some = keys[change]
        self.hash = PerfectHash.build(some)
        slot = self.hash.slots(some)
        self.slots = np.zeros(len(some), dtype=_SLOT)
        self.slots["print"][slot], self.slots["row"][slot], self.slots["many"][slot] = fingerprint(some), change, np.diff(np.concatenate([change, [len(keys)]]))
        return self

    def bytes(self) -> bytes:
        blocks = []
        for bits, rank in zip(self.hash.levels, self.hash.ranks, strict=True):
            b = np.zeros(-(-len(bits) // 512), dtype=_BLOCK)
            b["bits"] = np.packbits(np.pad(bits, (0, -len(bits) % 512)), bitorder="little").reshape(-1, 64)
            b["rank"] = rank[: len(bits) : 512]
            blocks.append(b)
        arrays = [self.ids.astype("<i8"), self.null.astype("u1"), self.first.astype("<u8"), self.slots, *blocks]
        at = _HEAD + 16 * len(blocks) + sum(a.nbytes for a in arrays[:4])
        places = []
        for bits, b in zip(self.hash.levels, blocks, strict=True):
            places += [len(bits), at]
            at += b.nbytes
        head = [_MAGIC, np.array([2, self.width], dtype="<u4").tobytes(), np.array([len(self.ids), len(self.slots), len(blocks), *places], dtype="<u8").tobytes()]
        return b"".join([*head, *(a.tobytes() for a in arrays)])

    @classmethod
    def read(cls, raw: bytes) -> Index:
        width, docs, keys, levels = _head(raw)
        at = _HEAD + 16 * len(levels)
        got = []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs + 1), (_SLOT, keys)):
            got.append(np.frombuffer(raw, kind, n, at))
            at += got[-1].nbytes
        x = cls(got[0], got[1].astype(bool), got[2].astype(np.int64), width)
        x.slots = got[3]
        x.hash = PerfectHash([np.unpackbits(np.frombuffer(raw, _BLOCK, -(-n // 512), place)["bits"].ravel(), count=n, bitorder="little").astype(bool) for n, place in levels])
        return x

    def rows(self, ids: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's first row and how many rows it has (0: it isn't here)."""
        keys = as_keys(ids, null)
        slot = self.hash.slots(keys)
        ok = slot >= 0
        ok[ok] = self.slots["print"][slot[ok]] == fingerprint(keys[ok])
        row, many = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        row[ok], many[ok] = self.slots["row"][slot[ok]], self.slots["many"][slot[ok]]
        return row, many


def _head(raw: bytes) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Bytes an id, documents, keys, and each level's bits and place."""
    if raw[:8] != _MAGIC or int(np.frombuffer(raw, "<u4", 1, 8)[0]) != 2:
        raise ValueError("not an index of token ids, or of another version")
    docs, keys, n = (int(x) for x in np.frombuffer(raw, "<u8", 3, 16))
    levels = np.frombuffer(raw, "<u8", min(2 * n, (len(raw) - _HEAD) // 8), _HEAD).reshape(-1, 2)
    return int(np.frombuffer(raw, "<u4", 1, 12)[0]), docs, keys, [(int(a), int(b)) for a, b in levels]


class Files:
    """Keyed access to a folder of shards.  The manifest is read once; a look-up reads a head, a block or a few, a record, two offsets and the ids, whatever the shard's size."""

    LEVELS = 64  # so many levels' places come with the head; there are hardly ever so many

    def __init__(self, folder: str):
        self.fs, self.path = filesystem(folder)
        self.shards = load_manifest(folder)
        self.keyed = [s for s in self.shards if s["greatest"] is not None]
        self.read_bytes = 0

    def _at(self, f: pa.NativeFile, kind, n: int, place: int) -> np.ndarray:
        raw = f.read_at(np.dtype(kind).itemsize * n, place)
        self.read_bytes += len(raw)
        return np.frombuffer(raw, kind)

    def _places(self, shard: dict, key: np.ndarray) -> tuple[int, np.ndarray]:
        """Bytes an id and the offsets of the key's documents in a shard, with the end of the last."""
        with self.fs.open_input_file(f"{self.path}/{shard['name']}.idx") as f:
            width, docs, keys, levels = _head(self._at(f, "u1", _HEAD + 16 * self.LEVELS, 0).tobytes())
            base = _HEAD + 16 * len(levels)
            for k, (size, place) in enumerate(levels):
                at = int(PerfectHash._place(key, k, size)[0])
                block = self._at(f, _BLOCK, 1, place + at // 512 * _BLOCK.itemsize)[0]
                bits = np.unpackbits(block["bits"], bitorder="little")
                if bits[at % 512]:
                    slot = int(block["rank"]) + int(bits[: at % 512].sum())
                    got = self._at(f, _SLOT, 1, base + 17 * docs + 8 + slot * _SLOT.itemsize)[0]
                    if got["print"] == fingerprint(key)[0]:
                        return width, self._at(f, "<u8", int(got["many"]) + 1, base + 9 * docs + 8 * int(got["row"])).astype(np.int64)
                    break
            return width, np.zeros(0, dtype=np.int64)

    def __getitem__(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that id."""
        if doc_id is None:
            shards = [s for s in self.shards if s["nulls"]]
        else:
            lo = bisect_left(self.keyed, doc_id, key=lambda s: s["greatest"])
            shards = list(takewhile(lambda s: s["least"] <= doc_id, self.keyed[lo:]))
        out = []
        for s in shards:
            width, first = self._places(s, as_keys(np.array([doc_id or 0]), np.array([doc_id is None])))
            if len(first):
                with self.fs.open_input_file(f"{self.path}/{s['name']}.bin") as f:
                    ids = self._at(f, f"<u{width}", int(first[-1] - first[0]), int(first[0]) * width)
                out += [ids[a:b] for a, b in zip(first[:-1] - first[0], first[1:] - first[0], strict=True)]
        return out


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """For file:, hdfs:, s3:, gs: and other places that Arrow knows."""
    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else os.path.abspath(uri))
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(docs: DataFrame, to: str, path: str = TOKENIZER, pattern: str = public_tokenizers.PATTERN, shards: int | None = None) -> list[dict]:
    """Writes all of docs (doc_id, text) to the folder ``to``; returns the manifest, one entry for each shard."""
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, -(-size // MOST), min(spark.sparkContext.defaultParallelism, -(-size // LEAST)))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc_nulls_first(), F.col("row").asc()]
    placed = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    fs0, folder = filesystem(to)
    fs0.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(to)
        enc = pieces(path, pattern)
        name = f"{folder}/shard-{TaskContext.get().partitionId():05d}"
        own = uuid.uuid4().hex
        end = np.array([END_ID], dtype=enc.dtype).tobytes()
        ids, null, sizes = [], [], array("q")
        with fs.open_output_stream(f"{name}.bin.{own}") as f:
            for b in batches:
                ids.append(b.column(0).fill_null(0).to_numpy())
                null.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
                for i in range(0, b.num_rows, 100):
                    for x in enc([t or "" for t in b.column(1).slice(i, 100).to_pylist()]):
                        sizes.append(len(x) // enc.dtype.itemsize + 1)
                        f.write(x + end)
        n = len(sizes)
        if not n:
            fs.delete_file(f"{name}.bin.{own}")
            return
        first = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype=np.int64))])
        index = Index(np.concatenate(ids), np.concatenate(null), first, enc.dtype.itemsize).hashed()
        with fs.open_output_stream(f"{name}.idx.{own}") as f:
            f.write(index.bytes())
        for kind in ("bin", "idx"):
            fs.move(f"{name}.{kind}.{own}", f"{name}.{kind}")
        keyed = index.ids[~index.null]
        told = {"shard": TaskContext.get().partitionId(), "docs": n, "ids": int(first[-1]), "nulls": n - len(keyed), "least": int(keyed[0]) if len(keyed) else None, "greatest": int(keyed[-1]) if len(keyed) else None}
        yield pa.RecordBatch.from_pylist([told], schema=pa.schema([(c, pa.int64()) for c in told]))

    done = arrow(placed, run, "shard long, docs long, ids long, nulls long, least long, greatest long").collect()  # one row a shard
    manifest, start = [], 0
    for r in sorted(done, key=lambda r: r["shard"]):
        manifest.append({"name": f"shard-{r['shard']:05d}", "start": start, **{k: r[k] for k in ("docs", "ids", "nulls", "least", "greatest")}})
        start += r["ids"]
    with fs0.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def load_manifest(folder: str) -> list[dict]:
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def _index(fs: pa.fs.FileSystem, path: str, name: str) -> Index:
    with fs.open_input_stream(f"{path}/{name}.idx") as f:
        return Index.read(f.read())


def lookup(folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of each document of that id, read by key.  For many keys use ``Files``, which reads the manifest once."""
    return Files(folder)[doc_id]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every document by its key, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as uint32)."""
    manifest = load_manifest(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for b in batches:
            for s in b.to_pylist():
                x = _index(fs, path, s["name"])
                row, many = x.rows(x.ids, x.null)
                again = np.arange(len(x.ids)) - row  # of rows with one key, which
                if ((many <= again) | (again < 0)).any():
                    raise ValueError(f"{s['name']}: a key is missing from its index")
                at, size = x.first[row + again], x.first[row + again + 1] - x.first[row + again]
                with fs.open_input_file(f"{path}/{s['name']}.bin") as f:
                    for lo in range(0, len(at), 1000):
                        crc = []
                        for a, n in zip(at[lo : lo + 1000].tolist(), size[lo : lo + 1000].tolist(), strict=True):
                            f.seek(a * x.width)
                            crc.append(zlib.crc32(np.frombuffer(f.read(n * x.width), f"<u{x.width}").astype("<u4").tobytes()))
                        part = slice(lo, lo + 1000)
                        yield pa.RecordBatch.from_arrays([pa.array(x.ids[part], mask=x.null[part]), pa.array(at[part] + s["start"]), pa.array(size[part]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.sparkContext.parallelize([(s["name"], s["start"]) for s in manifest], max(1, len(manifest)))
    return arrow(spark.createDataFrame(shards, "name string, start long"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
