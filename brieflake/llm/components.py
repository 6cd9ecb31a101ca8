"""Connected components by smallest label with pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(edges: DataFrame, to: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each end of ``edges`` (a, b), kept in ``to``; label: the smallest node that can be reached.

    Each round takes the least label of a node and its neighbours, and then jumps
    to the label's label, so the rounds grow with the logarithm of a component's
    diameter.  Everything stays distributed; only one flag a round reaches the driver.
    """
    both = to.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ends")
    labels = to.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")).withColumn("old", F.lit(None).cast("long")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        met = near.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        after = to.keep(met.join(up, "label").select("node", F.least("label", "upper").alias("label"), "old"), "labels")
        to.drop(labels)
        labels = after
        if after.where("label <> old").isEmpty():
            to.drop(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def joined(labels: DataFrame, links: DataFrame, to: Scratch) -> DataFrame:
    """``labels`` (node, label) after more links (a, b), kept in ``to``: components of what the links join, a component standing for its nodes."""
    of = labels.select("node", "label")
    ends = links.select("a", "b").join(of.toDF("a", "part_a"), "a", "left").join(of.toDF("b", "part_b"), "b", "left")
    edges = to.keep(ends.select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")).where("a <> b").distinct(), "edges")
    if edges.isEmpty():
        to.drop(edges)
        return labels
    more = components(edges, to)
    new = more.select(F.col("node").alias("label"), F.col("label").alias("upper"))
    out = of.join(new, "label", "left").select("node", F.coalesce("upper", "label").alias("label"))
    alone = more.select("node", "label").join(of.select("node"), "node", "left_anti")
    out = to.keep(out.union(alone), "labels")
    to.drop(edges, more, labels)
    return out
