"""Time windows, thresholds and freshness.  ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ship import checkpoint_dir

MOST_HOURS = 720


def in_window(df: DataFrame, since: str, until: str, ts: str = "published_at") -> DataFrame:
    """Closed interval; a null time is outside."""
    return df.where(F.col(ts).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))


def since_only(df: DataFrame, since: str, ts: str = "published_at", strict: bool = False) -> DataFrame:
    bound = F.lit(since).cast("timestamp")
    return df.where(F.col(ts) > bound if strict else F.col(ts) >= bound)


def resolve_window(now: str, hours: float | None = None, since: str | None = None, until: str | None = None) -> tuple[str, str]:
    """Either hours before ``now``, or both ends with an explicit offset; longer than nothing and at most MOST_HOURS."""
    from datetime import datetime, timedelta

    if (hours is None) == (since is None and until is None) or (since is None) != (until is None):
        raise ValueError("give either hours or both since and until")
    end = datetime.fromisoformat(now if hours is not None else until)
    start = end - timedelta(hours=hours) if hours is not None else datetime.fromisoformat(since)
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("times need an offset")
    if not timedelta(0) < end - start <= timedelta(hours=MOST_HOURS):
        raise ValueError("the window must be positive and at most 720 hours")
    return start.isoformat(), end.isoformat()


def above_threshold(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("ai_score").isNotNull() & (F.col("ai_score") >= threshold))


def by_score() -> list[Column]:
    return [F.coalesce("ai_score", F.lit(0.0)).desc(), F.col("seq").asc()]


def page(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in order with their place, and whether there are more (``truncated``).  One row beyond the page is read, so nothing is counted."""
    top = df.orderBy(*order).limit(limit + 1)
    placed = top.select("*", F.row_number().over(Window.orderBy(*order)).alias("place"), (F.count("*").over(Window.partitionBy()) > limit).alias("truncated"))  # one page, so one partition may number it
    return placed.where(F.col("place") <= limit)


def first_wins(df: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The first row of each key by ``order``.  An aggregate, so copies of a hot key meet map-side first."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def latest(df: DataFrame, value: str, *order: str, by: list[str] | None = None) -> DataFrame:
    """The value with the greatest order, for each key in ``by`` or over all."""
    return df.groupBy(*(by or [])).agg(F.max_by(value, F.struct(*order)).alias(value))


def sliding_counts(df: DataFrame, length: str, step: str, ts: str = "published_at", key: str = "category") -> DataFrame:
    """Look-back windows that overlap: rows of each key in windows of ``length`` every ``step``."""
    w = F.window(ts, length, step)
    return df.groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def freshness(runs: DataFrame, due_before: str) -> DataFrame:
    """One row: the last completed scheduled run, and whether it began no earlier than the due time two intervals back."""
    last = runs.where("provenance = 'scheduled' and status = 'completed'").agg(F.max("started_at").alias("last_completed"))
    return last.select("last_completed", F.coalesce(F.col("last_completed") >= F.lit(due_before).cast("timestamp"), F.lit(False)).alias("healthy"))


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each key; Spark keeps k rows of each key map-side before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def numbered(df: DataFrame, order: list[Column], by: str | None = None, out: str = "place") -> DataFrame:
    """df with each row's place (int, from 1) in the order, within ``by`` if it is given.

    No task sees all rows, however few values ``by`` has: rows are dealt by ranges of
    the order, numbered in their partition, and the sizes of the partitions before are
    added; a row a partition is all that is summed up.  The order must leave no ties.
    """
    checkpoint_dir(df.sparkSession)
    full = [F.asc(by), *order] if by else order
    low = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = df.repartitionByRange(*full).sortWithinPartitions(*full).select("*", F.spark_partition_id().alias("_part"), low.alias("_at")).checkpoint()
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_at") + 1
    rows = dealt.join(F.broadcast(before), "_part").withColumn(out, number)  # a row for each partition
    if by:
        first = rows.groupBy(by).agg(F.min(out).alias("_first")).withColumnRenamed(by, "_by")
        rows = rows.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, F.col(out) - F.col("_first") + 1).drop("_by", "_first")
    return rows.withColumn(out, F.col(out).cast("int")).drop("_part", "_at", "_before")
