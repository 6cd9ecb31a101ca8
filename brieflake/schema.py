"""The item row and the enumerations that order matters in."""

from __future__ import annotations

from pyspark.sql import types as T

# Category names in brief order.
CATEGORIES = ("product_innovation", "ingredients_technology", "packaging_labeling", "consumer_trends", "regulations_standards", "food_safety_recalls", "retail_foodservice", "company_updates")
RISK_LEVELS = ("none", "low", "medium", "high", "severe")
STAGES = ("raw", "normalized", "scored", "filtered", "enriched", "summary")

INTELLIGENCE = T.StructType([
    T.StructField("category", T.StringType()),
    *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("markets", "product_tags", "ingredient_tags", "technology_tags", "company_tags")),
    *(T.StructField(n, T.DoubleType()) for n in ("importance_score", "profile_relevance_score", "opportunity_score", "evidence_quality_score")),
    T.StructField("risk_level", T.StringType()),
    T.StructField("evidence_tier", T.IntegerType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("event_key", T.StringType()),
    T.StructField("original_source_url", T.StringType()),
    T.StructField("evidence_urls", T.ArrayType(T.StringType())),
    T.StructField("official_evidence_urls", T.ArrayType(T.StringType())),
    T.StructField("sponsored", T.BooleanType()),
    T.StructField("press_release", T.BooleanType()),
])

#: Lists have an order that rows have not: ``seq`` carries it, and breaks every tie last.
ITEM = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("content", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("ai_score", T.DoubleType()),
    T.StructField("ai_summary", T.StringType()),
    T.StructField("title_zh", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("food", INTELLIGENCE),
])
