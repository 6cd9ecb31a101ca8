"""Balanced digest: quotas by group, then a global cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analysis import sub_source
from .windows import by_score


def category_group(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """``grp``: the first group, in the order given, that lists the row's category; else ``default``."""
    first: dict[str, str] = {}
    for g, categories in groups.items():
        for c in categories:
            first.setdefault(c, g)
    table = F.create_map(*[x for c, g in first.items() for x in (F.lit(c), F.lit(g))]) if first else None
    return df.withColumn("grp", F.coalesce(F.try_element_at(table, "category"), F.lit("default")) if table is not None else F.lit("default"))


def balanced_digest(df: DataFrame, groups: dict[str, tuple[list[str], int]], default_limit: int, cap: int | None = None) -> DataFrame:
    """Rows by score, at most a group's limit from each, at most ``cap`` in all; ``place`` is the order.

    The rank is filtered by the largest limit first, so that each task keeps no more of a group than could survive.
    """
    limits = {g: n for g, (_, n) in groups.items()}
    most = max([default_limit, *limits.values()])
    limit = F.lit(default_limit)
    for g, n in limits.items():
        limit = F.when(F.col("grp") == g, n).otherwise(limit)
    ranked = category_group(df, {g: c for g, (c, _) in groups.items()}).withColumn("in_group", F.row_number().over(Window.partitionBy("grp").orderBy(*by_score())))
    kept = ranked.where(F.col("in_group") <= most).where(F.col("in_group") <= limit).orderBy(*by_score())
    kept = kept.limit(cap if cap is not None else most * (len(limits) + 1))
    # bounded by the limits, so one partition may number it
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*by_score())))


def group_counts(digest: DataFrame) -> DataFrame:
    return digest.groupBy("grp").agg(F.count("*").alias("n"))


def type_counts(items: DataFrame) -> DataFrame:
    """(source_type, sub_source, n): items by source type and the label within it."""
    return items.groupBy("source_type", sub_source().alias("sub_source")).agg(F.count("*").alias("n"))
