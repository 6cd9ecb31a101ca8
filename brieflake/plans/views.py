"""The item model over the driver's tables: deterministic projections, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..schema import CATEGORIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EV = """ev as (select event_id as seq, user_id as source_id, event_type as category, ts as published_at, least(value / 50, 10) as ai_score,
  cast(1 + user_id % 4 as integer) as evidence_tier, cast(event_id % 5 as integer) as risk_ord, cast(json_extract_string(props, '$.k') as bigint) as k from events)"""


def items_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored items."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("source_id"), F.col("event_type").alias("category"), F.col("ts").alias("published_at"), F.least(F.col("value") / 50, F.lit(10.0)).alias("ai_score"),
        (1 + F.col("user_id") % 4).cast("int").alias("evidence_tier"), (F.col("event_id") % 5).cast("int").alias("risk_ord"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


_CATS = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
FOOD = f"""food as (select seq, source_id, published_at, evidence_tier, k, ai_score, cast(seq as varchar) as id,
  ({_CATS})[cast(seq % 8 as integer) + 1] as category, (['none','low','medium','high','severe'])[cast((seq // 3) % 5 as integer) + 1] as risk_level,
  case seq % 4 when 0 then ['US'] when 1 then ['IN', 'US'] when 2 then ['JP', 'IN', 'IN'] else [] end as markets,
  ai_score as importance, k / 10.0 as relevance, cast(seq % 11 as double) as opportunity, cast(seq % 10 as double) as evidence_quality,
  seq % 13 <> 0 as has_food, seq % 17 = 0 as isolated, case when seq % 7 = 0 then false when seq % 7 = 1 then null else true end as relevant,
  case when seq % 3 = 0 then ['https://agency.gov.example/n' || k] else [] end as official_urls,
  case seq % 6 when 0 then 'https://news.google.com/a/' || k when 1 then 'http://u:p@pub.example.com/x' when 2 then 'https://10.0.0.' || (k % 9) || '/x' when 3 then null when 4 then 'https://www.pub' || (k % 5) || '.co.uk/s' else 'https://pub' || (k % 7) || '.example.com/s' end as original_url,
  case seq % 5 when 0 then [] when 1 then ['https://a.example.com/1', 'https://b.example.com/2'] when 2 then ['https://a.example.com/1', 'https://c.example.org/2'] when 3 then ['https://news.google.com/r/1'] else ['ftp://x.example.net/f'] end as evidence_urls,
  case when seq % 4 = 0 then null when seq % 4 = 1 then '  ' else 'Publisher ' || k end as publisher, case when seq % 9 < 5 then cast(seq % 9 as integer) end as linked_tier,
  seq % 19 = 0 as sponsored, seq % 23 = 0 as press_release, case when seq % 10 = 0 then null else 'event-' || (k % 40) || '-' || (source_id % 7) end as event_key,
  'https://site' || (source_id % 50) || '.example.com/a/' || k as url from ev)"""


def food_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analysed items with categories, markets, evidence and event keys."""
    s, k = F.col("seq"), F.col("k")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    none = F.array().cast("array<string>")
    arr = lambda *xs: F.array(*map(F.lit, xs))
    return items_ev(spark, sf_dir).select(
        "seq", "source_id", "published_at", "evidence_tier", "k", "ai_score", s.cast("string").alias("id"),
        pick(CATEGORIES, s % 8).alias("category"), pick(("none", "low", "medium", "high", "severe"), F.expr("seq div 3") % 5).alias("risk_level"),
        F.when(s % 4 == 0, arr("US")).when(s % 4 == 1, arr("IN", "US")).when(s % 4 == 2, arr("JP", "IN", "IN")).otherwise(none).alias("markets"),
        F.col("ai_score").alias("importance"), (k / 10.0).alias("relevance"), (s % 11).cast("double").alias("opportunity"), (s % 10).cast("double").alias("evidence_quality"),
        (s % 13 != 0).alias("has_food"), (s % 17 == 0).alias("isolated"), F.when(s % 7 == 0, False).when(s % 7 == 1, None).otherwise(True).alias("relevant"),
        F.when(s % 3 == 0, F.array(F.concat(F.lit("https://agency.gov.example/n"), k))).otherwise(none).alias("official_urls"),
        F.when(s % 6 == 0, F.concat(F.lit("https://news.google.com/a/"), k)).when(s % 6 == 1, "http://u:p@pub.example.com/x").when(s % 6 == 2, F.concat(F.lit("https://10.0.0."), k % 9, F.lit("/x"))).when(s % 6 == 3, None)
        .when(s % 6 == 4, F.concat(F.lit("https://www.pub"), k % 5, F.lit(".co.uk/s"))).otherwise(F.concat(F.lit("https://pub"), k % 7, F.lit(".example.com/s"))).alias("original_url"),
        F.when(s % 5 == 0, none).when(s % 5 == 1, arr("https://a.example.com/1", "https://b.example.com/2")).when(s % 5 == 2, arr("https://a.example.com/1", "https://c.example.org/2")).when(s % 5 == 3, arr("https://news.google.com/r/1")).otherwise(arr("ftp://x.example.net/f")).alias("evidence_urls"),
        F.when(s % 4 == 0, None).when(s % 4 == 1, "  ").otherwise(F.concat(F.lit("Publisher "), k)).alias("publisher"), F.when(s % 9 < 5, (s % 9).cast("int")).alias("linked_tier"),
        (s % 19 == 0).alias("sponsored"), (s % 23 == 0).alias("press_release"), F.when(s % 10 == 0, None).otherwise(F.concat(F.lit("event-"), k % 40, F.lit("-"), F.col("source_id") % 7)).alias("event_key"),
        F.concat(F.lit("https://site"), F.col("source_id") % 50, F.lit(".example.com/a/"), k).alias("url"),
    )


PG = """pg as (select page_id * 2 as seq, 'p' || page_id as id, 'rss' as source_type, url, html as content, 'p' as tag from pages
  union all select page_id * 2 + 1, 'q' || page_id, 'reddit', case when contains(url, '?') then replace(url, '?', '?utm_medium=x&') when contains(url, '#') then url else url || '?fbclid=1' end, case when page_id % 3 = 0 then '' else 'comment ' || page_id end, 'q' from pages)"""


def items_pg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages twice: as they are, and once more under a tracked address with another content."""
    p = table(spark, sf_dir, "pages")
    meta = lambda tag: F.create_map(F.lit("tag"), F.lit(tag), F.lit(f"only_{tag}"), F.lit("1"))
    first = p.select((F.col("page_id") * 2).alias("seq"), F.concat(F.lit("p"), "page_id").alias("id"), F.lit("rss").alias("source_type"), "url", F.col("html").alias("content"), meta("p").alias("metadata"))
    tracked = F.when(F.contains("url", F.lit("?")), F.replace("url", F.lit("?"), F.lit("?utm_medium=x&"))).when(F.contains("url", F.lit("#")), F.col("url")).otherwise(F.concat("url", F.lit("?fbclid=1")))
    second = p.select((F.col("page_id") * 2 + 1).alias("seq"), F.concat(F.lit("q"), "page_id").alias("id"), F.lit("reddit").alias("source_type"), tracked.alias("url"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("comment "), "page_id")).alias("content"), meta("q").alias("metadata"))
    return first.unionByName(second).withColumn("title", stripped(F.col("content")))
