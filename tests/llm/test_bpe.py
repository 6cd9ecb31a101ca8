from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from brieflake.llm import bpe, token_counts, token_files
from hypothesis import given, settings
from hypothesis import strategies as st

from .conftest import edge_texts

TEXT = st.text(alphabet=st.sampled_from(list("abthes 'SLdr\n\t.,!0129é漢🙂ž²\xa0\x85\x1c")), max_size=120)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    return token_counts.counter().encoding


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_prefix_programming_equals_merging(text):
    e = token_counts.counter().encoding
    c = bpe.codec()
    assert c.encode(text) == e.encode_ordinary(text)
    assert c.decode(c.encode(text)).decode() == text


@settings(max_examples=60, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 130), st.integers(0, 130), TEXT), max_size=5))
def test_edits(text, edits):
    c = bpe.codec()
    tree = token_counts.CountTree(token_counts.counter(), text)
    piece, data = bpe.EditablePiece(c, text.encode()), text.encode()
    for a, b, new in edits:
        tree.edit(a, b, new)
        a1, b1 = min(a, len(text)), max(min(a, len(text)), min(b, len(text)))
        text = text[:a1] + new + text[b1:]
        assert tree.text == text and tree.n_tokens == len(token_counts.counter().encoding.encode_ordinary(text))
        i, j = min(a, len(data)), max(min(a, len(data)), min(b, len(data)))
        piece.replace(i, j, new.encode())
        data = data[:i] + new.encode() + data[j:]
        assert piece.data == data and piece.last == c.prefixes(data)


def test_a_prefix_looks_few_tokens_up():
    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    c, data = bpe.PrefixCodec(bpe.RANKS), b"international" * 300
    c.ranks = ranks = Counted(c.ranks)
    last = c.prefixes(data)
    assert ranks.n < len(data)
    ranks.n = 0
    assert c.prefixes(data) == last and ranks.n == 0


def test_pairs_that_merging_leaves(monkeypatch):
    c, r = bpe.codec(), np.random.default_rng(5)
    pairs = r.integers(0, len(c.tokens), (3000, 2)).tolist() + r.integers(0, 600, (3000, 2)).tolist()
    want = [bpe._merge(c.ranks, c.tokens[a] + c.tokens[b]) == [c.tokens[a], c.tokens[b]] for a, b in pairs]
    assert [c.stays(a, b) for a, b in pairs] == want and 0 < sum(want) < len(want)
    # pieces in order share what they begin with, whatever was remembered or forgotten
    monkeypatch.setattr(bpe, "PAIRS", 10)
    monkeypatch.setattr(bpe, "STEPS", 10)
    e, texts = token_counts.counter().encoding, ["inter internal internation internationally in'in", "inte é international interns", ""]
    assert [c.encode_batch([t]) for t in texts * 2] == [[e.encode_ordinary(t)] for t in texts * 2]
    assert c.encode_batch(texts) == [e.encode_ordinary(t) for t in texts]


def test_an_edit_touches_little():
    tree = token_counts.CountTree(token_counts.counter(), "some words and more of them " * 5000)
    before = tree.encoded
    tree.edit(70_000, 70_003, "zz")
    assert tree.encoded - before < 12
    piece = bpe.EditablePiece(bpe.codec(), b"abcdefghij" * 3000)
    piece.replace(100, 101, b"Q")
    assert piece.redone < 1000
    piece.append(b"more")
    assert piece.redone == 4


def test_digests(spark, tables, tiktoken_encoding):
    got = sorted(map(tuple, bpe.op9_byte_bpe(spark, tables).collect()), key=str)
    want = []
    for i, t, _ in edge_texts():
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encoded_and_decoded(docs):
    back = bpe.decoded(bpe.encoded(docs, keep=("doc_id", "source")), keep=("doc_id",))
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((i, t or "")) for i, t, _ in edge_texts())


def test_counts_after_edits(spark, tables, tiktoken_encoding):
    n = lambda t: len(tiktoken_encoding.encode_ordinary(t))
    want = []
    for i, t, _ in edge_texts():
        t = t or ""
        k, e = len(t), t
        for a, b, new in ((k // 2, k // 2 + 40, " an edited passage, 2024 "), (k // 4, k // 4, "in's"), (k * 3 // 4, k * 3 // 4 + 10, ""), (k + 100, k + 100, "\n One more line.")):
            a, b = min(a, len(e)), min(b, len(e))
            e = e[:a] + new + e[b:]
        want.append((i, n(t), n(e)))
    got = [(r.doc_id, r.n_tokens, r.n_tokens_edited) for r in token_counts.op5_token_counts(spark, tables).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_edit_table(spark, docs, no_docs, tiktoken_encoding, monkeypatch):
    monkeypatch.setattr(token_counts, "ROUND", 2)
    rows = [(1, 1, 5, 9, "new words "), (1, 2, 0, 0, "'s"), (1, 3, 10**9, 10**9, " end"), (1, 4, 3, 3, None), (1, 5, 2, 20, ""), (9, 1, 70_000, 70_003, "zz"), (4, 1, 0, 5, "from nothing"), (5, 1, None, None, "x"), (424242, 1, 0, 0, "nobody"), (None, 1, 0, 0, "nobody"), (7, 1, 1, 3, None)]
    edits = spark.createDataFrame(rows, "doc_id long, seq int, start long, end long, text string")
    kept = token_counts.written(token_counts.trees(docs), "trees")
    after = token_counts.edit_table(kept, edits).collect()
    want = []
    for i, t, _ in edge_texts():
        t = t or ""
        for _, _, a, b, new in sorted((r for r in rows if r[0] == i and i is not None), key=lambda r: r[1]):
            a = min(a or 0, len(t))
            t = t[:a] + (new or "") + t[max(a, min(b or 0, len(t))) :]
        want.append((i, t, len(tiktoken_encoding.encode_ordinary(t))))
    assert sorted(((r.doc_id, r.text, sum(token_counts.numbers(r.tokens))) for r in after), key=str) == sorted(want, key=str)
    assert all(sum(token_counts.numbers(r.sizes)) == len(r.text) for r in after)
    # a stored tree encodes only what an edit touches
    long = token_counts.edited(kept.where("doc_id = 9"), "array(named_struct('start', 70000L, 'end', 70003L, 'text', 'zz'))").first()
    assert long.n_reencoded < 12 < long.n_pieces
    none = token_counts.trees(no_docs)
    assert token_counts.edited(none, None).collect() == [] and token_counts.edit_table(none, edits.limit(0)).collect() == []


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_files.TOKENIZER)
    folder = str(tmp_path / "ids")
    manifest = token_files.write(docs, folder, shards=3)
    assert sum(s["docs"] for s in manifest) == len(edge_texts()) and len(manifest) > 1
    got = sorted(map(tuple, token_files.read(spark, folder).collect()), key=lambda r: r[1])
    ids = {}
    for i, t, _ in edge_texts():
        ids.setdefault(i, []).append([*tk.encode(t or "", add_special_tokens=False).ids, 0])
    at = 0
    for i, start, n, crc in got:
        assert start == at
        assert (n, crc) in [(len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for x in ids[i]]
        at += n
    order = [r[0] for r in got]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    for i, want in ids.items():
        assert sorted(x.tolist() for x in token_files.lookup(folder, i)) == sorted(want)
    assert token_files.lookup(folder, 424242) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(TEXT, st.just("<|endoftext|>"), st.just("<|endof")), max_size=5).map("".join))
def test_ids_are_the_librarys_own(text):
    from tokenizers import Tokenizer

    p = token_files.pieces(token_files.TOKENIZER, public_tokenizers.PATTERN)
    assert np.frombuffer(p([text])[0], p.dtype).tolist() == Tokenizer.from_file(token_files.TOKENIZER).encode(text, add_special_tokens=False).ids


def test_added_tokens_are_found():
    p = token_files.pieces(token_files.TOKENIZER, public_tokenizers.PATTERN)
    assert np.frombuffer(p(["a<|endoftext|>b"])[0], p.dtype).tolist() == [64, 50256, 65]


def test_a_look_up_reads_as_much_whatever_the_size(spark, tmp_path):
    read = []
    for n in (50, 20_000):
        folder = str(tmp_path / str(n))
        token_files.write(spark.range(n).selectExpr("id * 3 as doc_id", "concat('w', id) as text"), folder, shards=2)
        files = token_files.Files(folder)
        assert [len(x) for x in files[3 * (n - 1)]] and files[1] == []
        files.read_bytes, want = 0, token_files.pieces(token_files.TOKENIZER, public_tokenizers.PATTERN)
        for k in range(0, n, max(1, n // 40)):
            (got,) = files[3 * k]
            assert got.tolist() == [*np.frombuffer(want([f"w{k}"])[0], want.dtype).tolist(), 0]
        read.append(files.read_bytes / len(range(0, n, max(1, n // 40))))
    assert max(read) < 2000


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    h = token_files.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert token_files.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]
