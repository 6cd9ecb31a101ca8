"""Source outcomes, run metrics, trial summaries, token cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fetch_report(outcomes: DataFrame) -> DataFrame:
    """One row: sources attempted, successful, empty, failed, their items, and the status these make.  An empty source counts as successful, one that the rotation skipped isn't attempted."""
    outcomes = outcomes.where("status <> 'skipped_rotation'")
    failed = F.col("status") == "failure"
    r = outcomes.agg(F.count("*").alias("attempted"), F.count_if(~failed).alias("successful"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(failed).alias("failed"), F.coalesce(F.sum("item_count"), F.lit(0)).cast("long").alias("item_count"))
    return r.withColumn("status", F.when(F.col("attempted") == 0, "not_attempted").when(F.col("failed") == F.col("attempted"), "failure").when(F.col("failed") > 0, "partial_failure").otherwise("success"))


def outcome_json(*allowed: str) -> Column:
    """An outcome as JSON with the allowed columns only, nulls left out."""
    return F.to_json(F.struct(*allowed))


def score_distribution(df: DataFrame) -> DataFrame:
    """One row with five bins of scores; a null score counts as 0."""
    s = F.coalesce("ai_score", F.lit(0.0))
    return df.agg(F.count_if(s < 3).alias("b0_2"), F.count_if((s >= 3) & (s < 5)).alias("b3_4"), F.count_if((s >= 5) & (s < 7)).alias("b5_6"), F.count_if((s >= 7) & (s < 9)).alias("b7_8"), F.count_if(s >= 9).alias("b9_10"))


def source_run_metrics(sources: DataFrame, outcomes: DataFrame, items: DataFrame, run_tokens: int, run_cost: float | None) -> DataFrame:
    """For each eligible source its outcome (``skipped_rotation`` if it has none), item counts, and its share of the run's tokens and cost by candidates.

    items: source_id, relevant, admitted, commercial, sponsored, duplicates, event_key.
    """
    per = items.groupBy("source_id").agg(
        F.count_if("relevant").alias("relevant_count"), F.count_if("admitted").alias("admitted_count"), F.count_if(F.col("admitted") & F.col("commercial")).alias("commercial_count"), F.count_if(F.col("admitted") & F.col("sponsored")).alias("sponsored_count"),
        F.coalesce(F.sum(F.when(F.col("admitted"), F.col("duplicates"))), F.lit(0)).cast("long").alias("duplicate_count"), F.count_distinct(F.when(F.col("admitted"), F.col("event_key"))).alias("unique_count"),
    )
    total = outcomes.agg(F.sum("candidate_count").alias("total"))  # one row
    j = sources.join(outcomes, "source_id", "left").join(per, "source_id", "left").join(F.broadcast(total))
    here, some = F.coalesce(F.col("status") != "skipped_rotation", F.lit(False)), F.coalesce("total", F.lit(0)) > 0
    share = F.try_divide(F.col("candidate_count").cast("double"), F.col("total"))
    tokens = F.when(here & some, F.bround(run_tokens * F.col("candidate_count") / F.col("total"))).otherwise(0).cast("long")
    cost = F.when(~here, F.lit(0.0)).when(some, F.lit(run_cost).cast("double") * share)
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("relevant_count", "admitted_count", "commercial_count", "sponsored_count", "duplicate_count", "unique_count")]
    return j.select("source_id", F.coalesce("status", F.lit("skipped_rotation")).alias("fetch_status"), F.coalesce("candidate_count", F.lit(0).cast("long")).alias("candidate_count"), *counts, tokens.alias("ai_tokens"), F.round(cost, 8).alias("estimated_cost"))


def islands(days: DataFrame) -> DataFrame:
    """(source_id, start, end, length) of the longest run of consecutive days of each source, the latest of equals.  days: distinct (source_id, day)."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy("day"))
    runs = days.withColumn("island", F.date_sub("day", n)).groupBy("source_id", "island").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("length"))
    best = runs.groupBy("source_id").agg(F.max_by(F.struct("start", "end", "length"), F.struct("length", "end")).alias("r"))
    return best.select("source_id", "r.*")


def trial_summary(m: DataFrame, days: int = 14, attempts: int = 4) -> DataFrame:
    """One row for each source over its run metrics.

    Complete: a run of at least ``days`` scheduled days whose last ``days`` hold
    ``attempts`` tries.  Then those days' scheduled rows count; otherwise all
    scheduled rows, or the manual ones if there are none; skipped rows never.
    """
    tried = F.col("fetch_status") != "skipped_rotation"
    scheduled = F.col("provenance") == "scheduled"
    dates = m.where(scheduled & F.col("day").isNotNull()).select("source_id", "day").distinct()
    run = islands(dates).select("source_id", F.col("length").alias("consecutive_days"), F.date_sub("end", days - 1).alias("from"), "start", "end")
    window = run.select("source_id", "consecutive_days", F.greatest("from", "start").alias("lo"), F.col("end").alias("hi"))
    j = m.join(window, "source_id", "left")
    inside = F.coalesce(F.col("day").between(F.col("lo"), F.col("hi")), F.lit(False))
    state = j.groupBy("source_id").agg(
        F.count_distinct(F.when(scheduled, F.col("day"))).alias("trial_days"), F.coalesce(F.max("consecutive_days"), F.lit(0).cast("long")).alias("consecutive_days"),
        F.count_distinct(F.when(scheduled & inside & tried, F.col("day"))).alias("attempt_days"), F.bool_or(scheduled & tried).alias("any_scheduled"),
    ).withColumn("complete", (F.col("consecutive_days") >= days) & (F.col("attempt_days") >= attempts))
    rows = j.drop("consecutive_days").withColumn("_in", inside).join(state, "source_id")
    counts = F.when(F.col("complete"), scheduled & F.col("_in") & tried).when(F.col("any_scheduled"), scheduled & tried).otherwise((F.col("provenance") == "manual") & tried)
    e = rows.withColumn("_e", counts)
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("_e"), F.col(c))), F.lit(0)).cast("long")
    agg = e.groupBy("source_id", "trial_days", "consecutive_days", "attempt_days", "complete").agg(
        F.count_if("_e").alias("run_count"), F.count_if(F.col("_e") & F.col("fetch_status").isin("success", "empty")).alias("_ok"), F.sum(F.when(F.col("_e"), F.col("parse_rate"))).alias("_parse"),
        pick("candidate_count").alias("candidate_count"), pick("admitted_count").alias("admitted_count"), pick("commercial_count").alias("commercial_count"), pick("duplicate_count").alias("duplicate_count"), pick("unique_count").alias("unique_count"),
        F.bool_or(F.col("_e") & F.col("access_mode").isin("robots_denied", "terms_denied")).alias("_denied"), F.bool_or(F.col("_e") & F.col("access_mode").isin("paywall", "login_required", "robots_denied", "terms_denied")).alias("_restricted"),
        F.bool_or(F.col("_e") & F.col("cost").isNull()).alias("_open"), F.sum(F.when(F.col("_e"), F.col("cost"))).alias("_cost"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    ok, parse = rate(F.col("_ok").cast("double"), F.col("run_count")), rate(F.col("_parse"), F.col("run_count"))
    tier = F.when(~F.col("complete"), "pending").when(F.col("_denied") | (ok < 0.5) | (F.col("unique_count") == 0), "disable").when((ok >= 0.9) & (parse >= 0.9) & (F.col("unique_count") >= 5), "core").when((ok >= 0.7) & (F.col("unique_count") >= 2), "extended").otherwise("discovery")
    mode = F.when(tier == "pending", "pending").when(tier == "disable", "disabled").when(F.col("_restricted"), "metadata_or_query").otherwise("direct_metadata")
    return agg.select(
        "source_id", "trial_days", "consecutive_days", "attempt_days", F.when(F.col("complete"), "complete").otherwise("provisional").alias("trial_status"), "run_count", F.round(ok, 6).alias("success_rate"), F.round(parse, 6).alias("parse_rate"), "candidate_count", "admitted_count", "unique_count",
        F.round(rate(F.col("commercial_count").cast("double"), F.col("admitted_count")), 6).alias("commercial_share"), F.round(rate(F.col("duplicate_count").cast("double"), F.col("duplicate_count") + F.col("unique_count")), 6).alias("duplicate_rate"),
        F.when(F.col("_open"), F.lit(None)).otherwise(F.round(F.coalesce("_cost", F.lit(0.0)), 6)).alias("estimated_cost"), tier.alias("recommended_tier"), mode.alias("recommended_mode"),
    )


def trial_order() -> list[Column]:
    """The order of a trial report: most unique events, then the commercial share, the success rate, the id."""
    return [F.desc("unique_count"), F.desc("commercial_share"), F.desc("success_rate"), F.asc("source_id")]


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: tokens in all, models with tokens but no full price, and the cost, null if any is unpriced.

    usage: provider, model, input_tokens, output_tokens.  prices: provider, model, in_price, out_price for a million.
    """
    per = usage.groupBy("provider", "model").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    full = prices.where("in_price is not null and out_price is not null")
    j = per.join(full, ["provider", "model"], "left")
    missing = F.when(F.col("in_price").isNull() & (F.col("i") + F.col("o") > 0), F.concat_ws("/", "provider", "model"))
    a = j.agg(F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("output_tokens"), F.array_join(F.sort_array(F.collect_set(missing)), ",").alias("unpriced"), F.coalesce(F.sum((F.col("i") * F.col("in_price") + F.col("o") * F.col("out_price")) / 1_000_000), F.lit(0.0)).alias("_cost"))
    return a.select("input_tokens", "output_tokens", "unpriced", F.when(F.col("unpriced") == "", F.round("_cost", 8)).alias("estimated_cost"))


def usage_delta(now: DataFrame, base: DataFrame) -> DataFrame:
    """Tokens of each model since a snapshot, never under 0."""
    b = base.select("provider", "model", F.col("input_tokens").alias("i0"), F.col("output_tokens").alias("o0"))
    since = lambda a, z: F.greatest(F.lit(0), F.col(a) - F.coalesce(z, F.lit(0))).alias(a)
    return now.join(b, ["provider", "model"], "left").select("provider", "model", since("input_tokens", "i0"), since("output_tokens", "o0"))
