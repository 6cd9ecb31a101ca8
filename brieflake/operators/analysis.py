"""Normalising, scoring and enriching: answers of a scorer applied as columns, failures isolated in their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..schema import CATEGORIES, RISK_LEVELS
from . import calls

MARK = "\n--- Top Comments ---"

#: A scorer: one text in, a JSON object as text out, or an exception.
Scorer = Callable[[str], str]


def normalised(items: DataFrame, contracts: DataFrame) -> DataFrame:
    """Items with their source's contract: collapsed titles, first category or company_updates, zero scores, addresses by tier (official at tier 1, evidence up to tier 2)."""
    c = contracts.select("source_id", "categories", F.col("evidence_tier").alias("tier"), F.col("markets").alias("_markets"))
    j = items.join(c, "source_id", "left")
    none = F.array().cast("array<string>")
    return j.select(
        *(F.col(x) for x in items.columns if x != "title"), text.collapsed(F.col("title")).alias("title"), F.coalesce(F.get("categories", F.lit(0)), F.lit("company_updates")).alias("category"), F.coalesce("_markets", none).alias("markets"),
        *(F.lit(0.0).alias(s) for s in ("importance", "relevance", "opportunity", "evidence_quality")), F.col("tier").alias("evidence_tier"), F.col("url").alias("original_url"),
        F.when(F.col("tier") <= 2, F.array("url")).otherwise(none).alias("evidence_urls"), F.when(F.col("tier") == 1, F.array("url")).otherwise(none).alias("official_urls"), F.col("tier").isNull().alias("isolated"),
    )


def prompt(limit: int = 1000) -> Column:
    """Title, content and comments of an item as one text, each part bounded."""
    body, talk = F.split_part("content", F.lit(MARK), F.lit(1)), F.split_part("content", F.lit(MARK), F.lit(2))
    part = lambda name, c, n: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}: "), F.substring(F.trim(c), 1, n)))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), part("Content", body, limit), part("Comments", talk, 1500))


def scored_by(df: DataFrame, scorers: list[Scorer], key: str = "id", policy: calls.CallPolicy = calls.CallPolicy()) -> DataFrame:  # noqa: B008
    """(key, answer, error) of each row's ``prompt``: scorers are asked within the policy's time limit, concurrency and attempts; an error stays in its row and stops nothing."""
    return calls.called(df, scorers, key, policy=policy).select(key, "answer", "error")


ANSWER = "relevant boolean, category string, importance double, relevance double, opportunity double, evidence_quality double, risk_level string, risk_reason string, event_key string, title_zh string, summary string, markets array<string>, product_tags array<string>, ingredient_tags array<string>, technology_tags array<string>, company_tags array<string>, sponsored boolean, press_release boolean, product_launch map<string,string>"
_SCORES = ("importance", "relevance", "opportunity", "evidence_quality")
_LISTS = ("product_tags", "ingredient_tags", "technology_tags", "company_tags")
_REQUIRED = ("title_zh", "summary", "category", *_SCORES, "risk_level")
_WRITTEN = (*_SCORES, *_LISTS, "category", "risk_level", "risk_reason", "event_key", "event_key_source", "ai_score", "ai_reason", "ai_summary", "ai_tags", "title_zh", "markets", "sponsored", "press_release", "product_launch", "relevant", "isolated", "analysis_error")


def analysed(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items (id, title, url, category, markets, isolated and more) with their answers (id, answer, error).

    An answer is valid if it says whether the item is relevant, its scores are
    within 0 and 10, its category and risk level are known ones, and, for a
    relevant item, no required field is missing or empty.  A relevant item takes
    all fields; without an event key it gets its address's.  An irrelevant one
    loses its scores, key, risk and launch and keeps the rest.  Without a valid
    answer an item is isolated as it is, with the error beside it.
    """
    a = lambda c: F.col(f"_a.{c}")
    j = items.join(answers.select("id", F.col("error").alias("_error"), F.from_json("answer", ANSWER).alias("_a")), "id", "left")
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    had = lambda c, default: F.col(c) if c in items.columns else default
    empty = F.exists(F.array(*(F.coalesce(a(c).cast("string"), F.lit("")) for c in _REQUIRED)), lambda x: x == "")
    outside = F.exists(F.array(*map(a, _SCORES)), lambda x: F.coalesce(F.isnan(x) | ~x.between(0, 10), F.lit(False)))
    strange = ~F.coalesce(a("category").isin(*CATEGORIES), F.lit(True)) | ~F.coalesce(a("risk_level").isin(*RISK_LEVELS), F.lit(True))
    valid = F.coalesce(a("relevant").isNotNull() & ~outside & ~strange & (~a("relevant") | ~empty), F.lit(False))
    good, out = valid & F.coalesce(a("relevant"), F.lit(False)), valid & ~F.coalesce(a("relevant"), F.lit(True))
    pick = lambda new, old, irrelevant: F.when(good, new).when(out, irrelevant).otherwise(old)
    tags = F.array_distinct(F.concat(*(F.coalesce(a(c), none) for c in _LISTS)))
    keyed = F.coalesce(a("event_key"), F.lit("")) != ""
    return j.select(
        *(c for c in items.columns if c not in _WRITTEN), F.when(good, a("category")).otherwise(F.col("category")).alias("category"), F.when(good, F.coalesce(a("markets"), none)).otherwise(had("markets", none)).alias("markets"),
        *(pick(a(c), had(c, F.lit(0.0)), 0.0).alias(c) for c in _SCORES), *(F.when(good, F.coalesce(a(c), none)).otherwise(had(c, none)).alias(c) for c in _LISTS),
        pick(a("risk_level"), had("risk_level", nothing), "none").alias("risk_level"), pick(F.coalesce(a("risk_reason"), F.lit("")), had("risk_reason", nothing), "").alias("risk_reason"),
        pick(F.when(keyed, a("event_key")).otherwise(urls.event_url_key(F.col("url"))), had("event_key", nothing), nothing).alias("event_key"), F.when(good & ~keyed, "canonical_url_fallback").alias("event_key_source"),
        F.when(good, a("importance")).otherwise(0.0).alias("ai_score"), F.when(good, F.concat(F.lit("category: "), a("category"))).when(out, "not relevant to the industry").otherwise("analysis failed").alias("ai_reason"),
        F.when(good, a("summary")).otherwise(F.col("title")).alias("ai_summary"), F.when(good, tags).otherwise(none).alias("ai_tags"), F.when(good, a("title_zh")).otherwise(had("title_zh", nothing)).alias("title_zh"),
        F.when(good, F.coalesce(a("sponsored"), F.lit(False))).otherwise(had("sponsored", F.lit(False))).alias("sponsored"), F.when(good, F.coalesce(a("press_release"), F.lit(False))).otherwise(had("press_release", F.lit(False))).alias("press_release"),
        F.when(good, a("product_launch")).alias("product_launch"), F.when(valid, a("relevant")).alias("relevant"), (~valid | F.coalesce(had("isolated", F.lit(False)), F.lit(False))).alias("isolated"), F.when(~valid, F.coalesce("_error", F.lit("invalid answer"))).alias("analysis_error"),
    )


def cited(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Citations (id, url) that are among what was searched for the item (id, url)."""
    return answers.join(results.select("id", "url").distinct(), ["id", "url"], "left_semi")


def sub_source() -> Column:
    """The label within a source: the first filled of the known keys of ``metadata``, the author, or unknown."""
    m = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    sub = m("subreddit")
    return F.coalesce(F.concat(F.lit("r/"), sub), m("feed_name"), F.concat(F.lit("@"), m("channel")), F.concat(m("period"), F.lit("/"), m("repo")), m("repo"), m("watchlist"), m("source_name"), m("gn_query"), m("domain"), F.nullif("author", F.lit("")), F.lit("unknown"))


def tag_aliases(tags: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, tag) with each tag's canonical form where it has one; aliases (alias, tag) are a small fixed table."""
    a = aliases.select(F.lower("alias").alias("_alias"), F.col("tag").alias("_tag"))
    return tags.join(a, F.lower("tag") == F.col("_alias"), "left").select("id", F.coalesce("_tag", "tag").alias("tag")).distinct()


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Calls (seq, name, error, seconds) by name: how many, how many failed, the last one's duration."""
    return calls.groupBy("name").agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.max_by("seconds", "seq").alias("last_seconds"))


def error_counts(calls: DataFrame) -> DataFrame:
    """Failed calls by error code."""
    return calls.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def score_summary(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: items scored, and those with a score other than zero that reach the threshold."""
    s = F.col("ai_score")
    return scored.agg(F.count("*").alias("scored"), F.count_if((s >= threshold) & (s != 0)).alias("above_threshold"))


def citation_count(enriched: DataFrame) -> DataFrame:
    """One row: citations in all items' ``sources``; an item without any counts none."""
    return enriched.agg(F.coalesce(F.sum(F.coalesce(F.size(F.col("sources")), F.lit(0))), F.lit(0)).cast("long").alias("citations"))
