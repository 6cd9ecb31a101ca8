"""Which sources run on a day: rotation by tier, fallback order, minimum fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_bucket


def fallback_order(day: str) -> list[Column]:
    """Extended sources first, then by the hash of day and id."""
    return [F.when(F.col("tier") == "extended", 0).otherwise(1).asc(), F.sha2(F.concat(F.lit(f"{day}:"), F.col("source_id")), 256).asc(), F.col("source_id").asc()]


def fetch_order() -> list[Column]:
    """Core sources are fetched first, then extended ones, then discovery, each in the order given (``seq``)."""
    rank = F.when(F.col("tier") == "core", 0).when(F.col("tier") == "extended", 1).otherwise(2)
    return [rank.asc(), F.col("seq").asc()]


def rotated(sources: DataFrame, day: str, extended_days: int, discovery_days: int) -> DataFrame:
    """``due``: core always, others when the bucket of their id is the day's."""
    from datetime import date

    n = date.fromisoformat(day).toordinal()
    due = F.when(F.col("tier") == "core", True)
    for tier, every in (("extended", extended_days), ("discovery", discovery_days)):
        due = due.when(F.col("tier") == tier, hash_bucket(F.col("source_id"), every) == n % every)
    return sources.where("enabled").withColumn("due", due.otherwise(False))


def sources_for(sources: DataFrame, day: str, minimum: int, extended_days: int, discovery_days: int) -> DataFrame:
    """The day's sources, filled up to a minimum from those that aren't due, in fallback order."""
    r = rotated(sources, day, extended_days, discovery_days)
    chosen = r.where("due")
    missing = max(0, minimum - chosen.count())
    return chosen.unionByName(r.where(~F.col("due")).orderBy(*fallback_order(day)).limit(missing)).drop("due")


def fallback_wave(eligible: DataFrame, outcomes: DataFrame, day: str, most: int) -> DataFrame:
    """For sources that failed or came back empty, as many of the sources not yet tried, in fallback order, at most ``most``."""
    short = outcomes.where("status in ('failure', 'empty')").limit(most).count()
    return eligible.join(outcomes.select("source_id"), "source_id", "left_anti").orderBy(*fallback_order(day)).limit(min(most, short))
