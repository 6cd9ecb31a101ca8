"""Corpus pipeline: documents through five stages, each on all its predecessor kept.

1. language: documents whose language is unknown (no letter, or too unsure) go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity
   0.8 or more) the document with the smallest id stays.
3. passages: passages of fifty words and more that a smaller document holds are
   cut out of the text.
4. decontaminate: words inside occurrences of benchmark phrases are cut out.
5. byte_bpe: the texts as token ids, and the digest of the text decoded from them.

All but the last return the columns of documents, whatever their names beside
doc_id and text; the last returns doc_id, and lang and source where there are any,
with its own.  A null text is never kept by the first stage, an empty one neither.
Repeated rows: the first stage keeps each, the second one of them.  Texts of any
length are whole in every stage.  An empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brieflake.llm import bpe, decontaminate, language, near_dedup, passages
from brieflake.llm.store import written


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.kept_languages(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, n=5, percent=80)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_repeats(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trips(docs, keep=tuple(c for c in ("doc_id", "lang", "source") if c in docs.columns))


STAGES = [("language", _language), ("near_dedup", _near_dedup), ("passages", _passages), ("decontaminate", _decontaminate), ("byte_bpe", _byte_bpe)]

#: No SQL can express the learned language stage or the passage windows; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
