"""Merging of copies: by URL key, by event key, by components of similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..ship import checkpoint_dir


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("url_key", urls.dedup_key(F.col("url")))


def _metadata(row: Column) -> Column:
    return F.from_json(row["meta"], "map<string,string>")


def merge_by_url(df: DataFrame) -> DataFrame:
    """One row for each URL key, in first-seen order.

    The longest content is primary (the first of equals); the others' contents
    are appended in order unless what has been gathered so far holds them;
    metadata the primary lacks, or has empty, come from the others in order.
    Groups are copies of one page: a group's distinct contents are gathered, and
    equal rows of one source count once, so a page fetched very often stays small.
    """
    k = keyed(df)
    size = F.length(F.coalesce("content", F.lit("")))
    one = k.groupBy("url_key", "source_type", "content", F.to_json("metadata").alias("meta")).agg(F.min(F.struct("seq", "id", "title", "url")).alias("head"), F.count("*").alias("copies"))
    rows = one.select("url_key", F.struct(F.col("head.seq").alias("seq"), F.col("head.id").alias("id"), F.col("head.title").alias("title"), F.col("head.url").alias("url"), "source_type", "content", "meta", size.alias("size")).alias("r"), "copies")
    g = rows.groupBy("url_key").agg(F.array_sort(F.collect_list("r")).alias("rows"), F.sum("copies").alias("n_members"))
    primary = F.aggregate(F.slice("rows", 2, 1_000_000_000), F.element_at("rows", 1), lambda acc, r: F.when(r["size"] > acc["size"], r).otherwise(acc))
    g = g.withColumn("primary", primary)

    def grow(acc: Column, r: Column) -> Column:
        add = (r["seq"] != F.col("primary.seq")) & (r["size"] > 0) & ~F.contains(acc, r["content"])
        mark = F.concat(F.lit("\n\n--- From "), r["source_type"], F.lit(" ---\n"), r["content"])
        return F.when(add, F.when(acc == "", r["content"]).otherwise(F.concat(acc, mark))).otherwise(acc)

    def fill(acc: Column, r: Column) -> Column:
        return F.map_zip_with(acc, F.coalesce(_metadata(r), F.create_map().cast("map<string,string>")), lambda _, a, b: F.coalesce(F.nullif(a, F.lit("")), b, a))

    first = F.coalesce(_metadata(F.col("primary")), F.create_map().cast("map<string,string>"))
    types = F.array_distinct(F.transform("rows", lambda r: r["source_type"]))
    return g.select(
        F.col("primary.seq").alias("seq"),
        F.col("primary.id").alias("id"),
        F.col("primary.title").alias("title"),
        F.col("primary.url").alias("url"),
        F.aggregate("rows", F.coalesce("primary.content", F.lit("")), grow).alias("content"),
        F.aggregate("rows", first, fill).alias("metadata"),
        F.when(F.col("n_members") > 1, types).alias("merged_sources"),
        F.element_at("rows", 1)["seq"].alias("first_seq"),
        F.col("n_members"),
    )


def merge_by_event(df: DataFrame, key: str = "event_key") -> DataFrame:
    """One row for each event key: the primary has the least (tier, -quality, url); sources and evidence of all are united.  Rows without a key stay as they are.

    What is gathered is distinct first, so it grows with a key's different sources and addresses, not with its rows.
    """
    order = F.struct("evidence_tier", (-F.col("evidence_quality")).alias("q"), "url", "seq")
    heads = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("id", "seq", "url", "evidence_tier", "evidence_quality"), order).alias("p"), F.count("*").alias("members"), F.sort_array(F.collect_set("source_id")).alias("sources"), F.sort_array(F.collect_set("url")).alias("evidence"))
    alone = df.where(F.col(key).isNull()).select(F.lit(None).cast("string").alias(key), F.struct("id", "seq", "url", "evidence_tier", "evidence_quality").alias("p"), F.lit(1).cast("long").alias("members"), F.array("source_id").alias("sources"), F.array("url").alias("evidence"))
    return heads.unionByName(alone).select(key, "p.*", "members", "sources", "evidence")


def apply_topic_groups(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drops rows that ``pairs`` (keep, drop: ids) give up, and appends their contents to those that stay, in order."""
    lost = pairs.join(df.select(F.col("id").alias("drop"), "seq", "source_type", "content"), "drop")
    parts = lost.where("content is not null and content <> ''").groupBy("keep").agg(F.array_sort(F.collect_list(F.struct("seq", "source_type", "content"))).alias("parts"))
    kept = df.join(pairs.select(F.col("drop").alias("id")).distinct(), "id", "left_anti").join(parts.withColumnRenamed("keep", "id"), "id", "left")
    tail = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("\n\n--- From "), p["source_type"], F.lit(" ---\n"), p["content"])), "")
    return kept.withColumn("content", F.when(F.col("parts").isNotNull(), F.concat(F.coalesce("content", F.lit("")), tail)).otherwise(F.col("content"))).drop("parts")


def merge_source_specs(specs: DataFrame) -> DataFrame:
    """Source specifications of one id: the first definition, with the sorted union of all packs, ordered by id."""
    first = specs.groupBy("id").agg(F.min_by(F.struct("adapter", "tier", "url"), "seq").alias("d"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("packs")))).alias("packs"))
    return first.select("id", "d.*", "packs")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of each node: the smallest node that edges (a, b) reach.  Labels spread along edges and jump, each round cut by a checkpoint."""
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        after = met.join(upper, "label").select("node", "old", F.least("label", "upper").alias("label")).checkpoint()
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
