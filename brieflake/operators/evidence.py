"""Evidence policy: contracts, admission decisions, counters, the commercial penalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains, urls

OFFICIAL_CATEGORIES = ("regulations_standards", "food_safety_recalls")

# The buckets of the admission summary, and the reason that falls into each.
BUCKETS = {
    "accepted_authoritative": ("accepted authoritative evidence",),
    "accepted_corroborated": ("accepted corroborated discovery",),
    "accepted_single_source": ("accepted single attributable source",),
    "accepted_aggregator_fallback": ("accepted attributable aggregator fallback",),
    "rejected_not_relevant": ("not food-industry relevant",),
    "rejected_official_evidence_required": ("official evidence required",),
    "rejected_unknown_publisher": ("discovery publisher could not be identified", "discovery has no usable evidence URL"),
    "rejected_strict_evidence": ("discovery requires original source or two domains",),
}


def with_contract(items: DataFrame, contracts: DataFrame) -> DataFrame:
    """Items with their source's contract.  ``contracts`` is a configuration table of a few hundred rows; Catalyst broadcasts it by its size.  Items without one are isolated and lose their scores."""
    j = items.join(contracts, "source_id", "left")
    isolated = F.col("contract_tier").isNull()
    return j.withColumn("isolated", isolated).withColumn("ai_score", F.when(isolated, 0.0).otherwise(F.col("ai_score")))


def decide(df: DataFrame, mode: str = "loose", aggregator_fallback: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """accepted, reason and effective_tier, by rules in order; domains by the public suffix rules, unless others are given.  Reads has_food, isolated, category, official_urls, relevant, evidence_tier, original_url, evidence_urls, publisher, linked_tier."""
    official = F.col("category").isin(*OFFICIAL_CATEGORIES) & (F.size(F.coalesce("official_urls", F.array().cast("array<string>"))) == 0)
    evidence = F.coalesce("evidence_urls", F.array().cast("array<string>"))
    hosts = F.transform(F.filter(F.concat(F.array("original_url"), evidence), urls.is_web), urls.host)
    df = domains.with_domains(df, hosts, rules if rules is not None else domains.suffix_rules(df.sparkSession), "_domains")
    original = urls.is_attributable(F.col("original_url"), F.try_element_at("_domains", urls.host(F.col("original_url")))["domain"])
    web = F.exists(evidence, urls.is_web)
    corroborated = urls.domain_count(evidence, F.col("_domains")) >= 2
    publisher = F.trim(F.coalesce("publisher", F.lit(""))) != ""
    aggregator = F.exists(evidence, lambda u: urls.scheme(u).isin("http", "https") & urls.host(u).isin(*urls.AGGREGATORS))
    linked = (F.coalesce("original_url", F.lit("")) != "") & F.coalesce(F.col("linked_tier").between(1, 3), F.lit(False))
    if mode == "strict":
        third = F.when(original | corroborated, "+accepted corroborated discovery").otherwise("discovery requires original source or two domains")
    else:
        third = F.when(original & web, "+accepted single attributable source").when(corroborated, "+accepted corroborated discovery")
        if aggregator_fallback:
            third = third.when(publisher & aggregator, "+accepted attributable aggregator fallback")
        third = third.when(~publisher, "discovery publisher could not be identified").otherwise("discovery has no usable evidence URL")
    verdict = (
        F.when(~F.col("has_food"), "missing food analysis")
        .when(F.col("isolated"), "isolated analysis")
        .when(official, "official evidence required")
        .when(F.col("relevant").eqNullSafe(False), "not food-industry relevant")
        .when(F.col("evidence_tier").isin(1, 2), "+accepted authoritative evidence")
        .when(F.col("evidence_tier") == 3, third)
        .when(linked, "+accepted linked weak signal")
        .otherwise("weak signal requires original source and linked evidence")
    )
    v = df.withColumn("_verdict", verdict)
    tier = F.when(~F.col("has_food"), 4).when(F.col("_verdict") == "+accepted linked weak signal", F.col("linked_tier")).otherwise(F.col("evidence_tier"))
    return v.withColumn("accepted", F.col("_verdict").startswith("+")).withColumn("reason", F.regexp_replace("_verdict", r"^\+", "")).withColumn("effective_tier", tier.cast("int")).drop("_verdict", "_domains")


def summary(decisions: DataFrame) -> DataFrame:
    """One row with a count for each bucket, zero where nothing fell into it; every other reason, accepted or not, counts as rejected_other."""
    known = [r for rs in BUCKETS.values() for r in rs]
    return decisions.agg(*(F.count_if(F.col("reason").isin(*rs)).alias(b) for b, rs in BUCKETS.items()), F.count_if(~F.col("reason").isin(*known)).alias("rejected_other"))


def penalised(quality: Column, accepted: Column, sponsored: Column, press: Column) -> Column:
    """Evidence quality, two less (not under 0) for accepted commercial messages; applied once, here."""
    return F.when(accepted & (sponsored | press), F.greatest(F.lit(0.0), quality - 2)).otherwise(quality)
