"""Interests matched with texts: 1.0 for a whole word, 0.3 for a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interest_scores(docs: DataFrame, interests: dict[str, list[str]]) -> DataFrame:
    """(doc_id, name, score) of each interest that a text meets.  Interests are a handful of literals, so each row is scored in place and nothing is joined."""
    low = F.lower("text")
    words = F.split(low, "[^a-z0-9]+")

    def one(ws: list[str]) -> Column:
        return F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(F.array_contains("words", w), 1.0).when(F.contains("low", F.lit(w)), 0.3).otherwise(0.0) for w in ws))

    rows = docs.select("doc_id", low.alias("low"), words.alias("words"))
    scored = rows.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), one(ws).alias("score")) for n, ws in interests.items()))).alias("x"))
    return scored.select("doc_id", "x.name", "x.score").where("score > 0")


def source_matches(sources: DataFrame, interest: str, aliases: dict[str, list[str]] | None = None, threshold: float = 0.1) -> DataFrame:
    """Sources (seq, source_key, keywords, tags, description) that an interest meets, with a score up to 1.

    1.0 for each keyword of the source's domain, 0.5 for each tag (or an alias of
    it) within the interest, 0.3 for each word of three letters and more that the
    description has too; divided by the interest's distinct words.  A source named
    twice counts where it comes first.
    """
    low = interest.lower()
    tokens = sorted(set(low.split()))
    text = F.lit(low)
    also = {k.lower(): [a.lower() for a in v] for k, v in (aliases or {}).items()}
    aliased = [k for k, v in also.items() if any(a in low for a in v)]
    none = F.array().cast("array<string>")
    within = lambda xs, more=(): F.size(F.filter(F.coalesce(xs, none), lambda x: F.contains(text, F.lower(x)) | F.lower(x).isin(*more)))
    words = F.split(F.lower(F.coalesce("description", F.lit(""))), r"\s+")
    said = sum((F.array_contains(words, t).cast("int") for t in tokens if len(t) >= 3), F.lit(0))
    raw = within(F.col("keywords")) + 0.5 * within(F.col("tags"), aliased) + 0.3 * said
    first = sources.groupBy("source_key").agg(F.min_by(F.struct("seq", "keywords", "tags", "description"), "seq").alias("s")).select("source_key", "s.*")
    return first.select("source_key", "seq", F.least(raw / (len(tokens) or 1), F.lit(1.0)).alias("score")).where(F.col("score") >= threshold)
