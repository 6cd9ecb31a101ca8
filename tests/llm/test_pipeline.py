"""The pipeline's stages one by one on the driver's smallest tables and on odd ones."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from brieflake.llm import token_counts

from .test_near_dedup import brute


def test_stages(spark, sf):
    docs = first = spark.read.parquet(f"{sf}/documents.parquet").cache()
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        after[name] = docs
        if name != "byte_bpe":
            assert docs.columns == first.columns
    assert after["language"].count() == first.count()  # nothing here is without a language
    items = [(r.doc_id, r.text) for r in after["language"].collect()]
    assert sorted(str(r.doc_id) for r in after["near_dedup"].collect()) == sorted(d for d, _, c in brute(items, 5) if d == c)
    assert after["passages"].count() == after["near_dedup"].count() == after["decontaminate"].count() == docs.count()
    texts = {r.doc_id: r.text for r in after["decontaminate"].collect()}
    e = token_counts.counter().encoding
    for r in docs.collect():
        assert r.token_ids == e.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("which", ["tables", "empty_tables"])
def test_run_on_odd_tables(spark, which, request):
    sf = request.getfixturevalue(which)
    got = corpus_pipeline.run(spark, sf).collect()
    assert len({(r.doc_id, r.decoded_sha256) for r in got}) == len(got)
    assert bool(got) == (which == "tables")


def test_documents_of_two_columns(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name == "near_dedup":
            docs = docs.select("doc_id", "text")
        docs = stage(spark, docs, tables)
    assert docs.columns == ["doc_id", "n_tokens", "decoded_sha256", "token_ids"] and docs.count() > 3
