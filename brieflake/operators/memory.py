"""Seven-day event memory, delivery ledger, isolation list, retention: state tables and anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import clusters

DAYS = 7


def unseen(events: DataFrame, memory: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """Events whose key is not in memory (event_key, seen_at) within the days before ``now``.  Keys are distinct before the join, so a hot key costs one row on that side."""
    live = memory.where(F.col("seen_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days")).select("event_key").distinct()
    return events.join(live, "event_key", "left_anti")


def unlike(events: DataFrame, memory: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """Events that no remembered report of the days before ``now`` is like, by the rules of clusters.similar_events.  memory: reports with seen_at."""
    live = memory.where(F.col("seen_at") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))
    return events.join(clusters.remembered_events(events, live, 24 * days), "seq", "left_anti")


def remembered(memory: DataFrame, events: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """The memory after a run: live entries and the new ones, the latest sight of each key."""
    at = F.lit(now).cast("timestamp")
    both = memory.select("event_key", "seen_at").where(F.col("seen_at") >= at - F.expr(f"interval {days} days")).unionByName(events.where("event_key is not null").select("event_key", at.alias("seen_at")))
    return both.groupBy("event_key").agg(F.max("seen_at").alias("seen_at"))


def undelivered(artifacts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Artifacts (run_id, channel, hash) with no successful delivery in the ledger."""
    return artifacts.join(ledger.where("status = 'success'").select("run_id", "channel", "hash").distinct(), ["run_id", "channel", "hash"], "left_anti")


def isolated_once(known: DataFrame, new: DataFrame) -> DataFrame:
    """The isolation list with new (item_id, stage) pairs that it doesn't have."""
    return known.unionByName(new.dropDuplicates(["item_id", "stage"]).join(known.select("item_id", "stage"), ["item_id", "stage"], "left_anti").select(*known.columns))


def expired(files: DataFrame, now: str, stage_days: int = 30, brief_days: int = 180) -> DataFrame:
    """Files (run_id, kind, written_at) past their age; a run goes as a whole once its brief is past."""
    age = F.datediff(F.lit(now).cast("timestamp"), F.col("written_at"))
    gone = files.where((F.col("kind") == "brief") & (age > brief_days)).select("run_id").distinct().withColumn("_gone", F.lit(True))
    return files.join(gone, "run_id", "left").where(F.col("_gone").isNotNull() | ((F.col("kind") == "stage") & (age > stage_days))).drop("_gone")


def with_enriched(selected: DataFrame, enriched: DataFrame) -> DataFrame:
    """Selected rows with their enrichment where there is one; rows it isolated go."""
    e = enriched.select("id", F.col("summary").alias("_summary"), F.col("isolated").alias("_isolated"))
    j = selected.join(e, "id", "left").where("not coalesce(_isolated, false)")
    return j.withColumn("summary", F.coalesce("_summary", "summary")).drop("_summary", "_isolated")
