"""Keyed memory and window counts as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..ship import checkpoint_dir


#: Groups that keys are dealt into: one call of Python and one state serve all keys of a group, as a call for each key costs far more than its rows.
GROUPS = 1024


def unremembered(stream: DataFrame, key: str, ts: str, days: int = 7, late: str = "1 day") -> DataFrame:
    """The rows whose key was not let through within the days before them.

    A row that is let through is remembered for ``days`` of event time; those held
    back don't prolong that.  State is one time for each key, kept by groups of keys,
    and goes once the watermark (the latest time seen, less ``late``) is past it.  Of
    rows with one key and time one is let through.  Rows without a key or time don't pass.
    """
    held = days * 86_400_000

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
            out = []
            for name, at in zip(rows[key].tolist(), rows[ts].astype("datetime64[us]").astype("int64").tolist(), strict=True):
                before = last.get(name)
                out.append(before is None or at - before > held * 1000)
                if out[-1]:
                    last[name] = at
            yield rows[out][columns]
        ends = {name: at // 1000 + held + 1 for name, at in last.items()}
        kept = [name for name, end in ends.items() if end > state.getCurrentWatermarkMs()]
        if kept:
            state.update((kept, [last[name] for name in kept]))
            state.setTimeoutTimestamp(min(ends[name] for name in kept))
        elif state.exists:
            state.remove()

    marked = stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    columns, kind = marked.columns, marked.schema[key].dataType.simpleString()
    return marked.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS))).groupBy("_group").applyInPandasWithState(step, marked.schema, f"names array<{kind}>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def window_counts(stream: DataFrame, ts: str, length: str, late: str, key: str) -> DataFrame:
    """Tumbling counts of each key, rows later than ``late`` dropped."""
    w = F.window(ts, length)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def commit_then_remember(write: Callable[[DataFrame, int], None], remember: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch before memory learns of it, so a batch that fails is seen again."""

    def batch(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            write(df, epoch)
            remember(df, epoch)
        finally:
            df.unpersist()

    return batch


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into a Parquet folder (append) or, for totals that change, by foreachBatch; returns the result."""
    import uuid

    spark: SparkSession = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = f"{base}/out"
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").outputMode(mode)
    if mode == "append":
        w.format("parquet").option("path", out).start().awaitTermination()
    else:
        w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
