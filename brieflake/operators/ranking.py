"""Profile ranking and quota selection."""

from __future__ import annotations

import statistics
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed_point
from ..schema import RISK_LEVELS
from ..ship import ship
from . import windows

# Categories that count as commercial.
COMMERCIAL = ("product_innovation", "ingredients_technology", "packaging_labeling", "consumer_trends", "retail_foodservice", "company_updates")


@dataclass(frozen=True)
class Profile:
    """Ranking parameters; the topic weights sum to 1."""

    max_items: int = 20
    max_per_source: int = 3
    exploration_slots: int = 2
    commercial_min_ratio: float = 0.7
    minimum_score: float = 0.0
    risk_override_min: str = "high"
    # Default weights of topics and penalties of markets.
    topic_weights: dict[str, float] = field(
        default_factory=lambda: {"product_innovation": 0.2, "ingredients_technology": 0.2, "packaging_labeling": 0.1, "consumer_trends": 0.15, "regulations_standards": 0.08, "food_safety_recalls": 0.07, "retail_foodservice": 0.1, "company_updates": 0.1}
    )
    market_weights: dict[str, float] = field(default_factory=dict)
    market_penalties: dict[str, float] = field(default_factory=lambda: {"IN": 0.5})

    def __post_init__(self) -> None:
        if abs(sum(self.topic_weights.values()) - 1) > 1e-4:
            raise ValueError("topic weights must sum to 1")


def _looked_up(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(0.0))


def _market(p: Profile) -> Column:
    """The market multiplier: the best boost, and the mean penalty, of a row's distinct markets."""
    markets = F.array_distinct(F.coalesce("markets", F.array().cast("array<string>")))
    boost = F.coalesce(F.array_max(F.transform(markets, lambda m: _looked_up(p.market_weights, m))), F.lit(0.0))
    total = F.aggregate(markets, F.lit(0.0), lambda acc, m: acc + _looked_up(p.market_penalties, m))
    penalty = F.coalesce(F.try_divide(total, F.size(markets)), F.lit(0.0))
    return (1 + boost) * (1 - penalty)


def ranked(df: DataFrame, p: Profile) -> DataFrame:
    """base_rank, final_rank and risk_alert of rows with category, markets, four scores and risk_level."""
    base = 0.45 * F.col("importance") + 0.25 * F.col("relevance") + 0.20 * F.col("opportunity") + 0.10 * F.col("evidence_quality")
    risk = F.array_position(F.array(*map(F.lit, RISK_LEVELS)), F.col("risk_level")) - 1
    out = df.withColumn("base_rank", base).withColumn("risk_alert", risk >= RISK_LEVELS.index(p.risk_override_min))
    return out.withColumn("final_rank", F.col("base_rank") * (1 + _looked_up(p.topic_weights, F.col("category"))) * _market(p))


def reason(p: Profile, name: str) -> Column:
    """Why a ranked row was chosen: scores with two decimals, multipliers and the final rank with four."""
    topic = 1 + _looked_up(p.topic_weights, F.col("category"))
    parts = [("importance", 2, F.col("importance")), ("profile_relevance", 2, F.col("relevance")), ("opportunity", 2, F.col("opportunity")), ("evidence_quality", 2, F.col("evidence_quality"))]
    parts += [("topic_multiplier", 4, topic), ("market_multiplier", 4, _market(p)), ("evidence_tier", 0, F.col("effective_tier")), ("final_rank", 4, F.col("final_rank"))]
    said = [F.concat(F.lit(f"{k}="), fixed_point(c, n) if n else c.cast("string")) for k, n, c in parts]
    return F.concat_ws("; ", F.lit(f"profile={name}"), *said)


def rank_order() -> list[Column]:
    return [F.desc("final_rank"), F.asc("effective_tier"), F.desc("published_at"), F.asc("url"), F.asc("seq")]


def explored(df: DataFrame, p: Profile) -> DataFrame:
    """The regular selection: up to exploration_slots rows of categories weighted under the median first, then all in order, both under the source cap and max_items.

    Every window ranks by source, and Spark keeps max_per_source rows of a
    source map-side; what is left after that is bounded by sources, and the
    global cuts are limits.
    """
    cutoff = statistics.median(p.topic_weights.values())
    low = [c for c, w in p.topic_weights.items() if w < cutoff]
    by_source = Window.partitionBy("source_id").orderBy(*rank_order())
    first = df.where(F.col("category").isin(*low)).withColumn("_n", F.row_number().over(by_source)).where(F.col("_n") <= p.max_per_source).drop("_n")
    first = first.orderBy(*rank_order()).limit(min(p.exploration_slots, p.max_items))
    taken = first.groupBy("source_id").agg(F.count("*").alias("_taken"))
    # bounded by exploration_slots, a small constant
    rest = df.join(F.broadcast(first.select("seq")), "seq", "left_anti").withColumn("_n", F.row_number().over(by_source)).where(F.col("_n") <= p.max_per_source)
    rest = rest.join(F.broadcast(taken), "source_id", "left").where(F.col("_n") + F.coalesce("_taken", F.lit(0)) <= p.max_per_source).drop("_n", "_taken")
    both = first.withColumn("exploration", F.lit(True)).unionByName(rest.orderBy(*rank_order()).limit(p.max_items).withColumn("exploration", F.lit(False)))
    return both.orderBy(F.desc("exploration"), *rank_order()).limit(p.max_items)


def source_capped(df: DataFrame, per_source: int, k: int) -> DataFrame:
    """The k best rows with at most per_source of each source."""
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(*rank_order()))
    return df.withColumn("in_source", n).where(F.col("in_source") <= per_source).orderBy(*rank_order()).limit(k)


def commercial_mix(selected: DataFrame, pool: DataFrame, p: Profile) -> DataFrame:
    """Swaps the worst non-commercial rows for the next commercial ones until their share is reached, under the source cap.

    The repair is a sequence of dependent steps, so it runs on one small frame:
    the selection (max_items rows) and the candidates that could enter it (at
    most max_per_source of each source, and no more than max_items times that).
    """
    ship(pool.sparkSession)
    commercial = F.col("category").isin(*COMMERCIAL)
    n = F.row_number().over(Window.partitionBy("source_id").orderBy(*rank_order()))
    spare = pool.where(commercial).join(F.broadcast(selected.select("seq")), "seq", "left_anti").withColumn("_n", n).where(F.col("_n") <= 2 * p.max_per_source).drop("_n").orderBy(*rank_order()).limit(p.max_items * 2 * p.max_per_source)
    columns = ["seq", "source_id", "category", "final_rank", "effective_tier", "published_at", "url"]
    frame = selected.select(*columns).withColumn("chosen", F.lit(True)).unionByName(spare.select(*columns).withColumn("chosen", F.lit(False))).withColumn("commercial", commercial)
    have = pool.where(commercial).limit(p.max_items + 1).count()

    def repair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["final_rank", "effective_tier", "published_at", "url", "seq"], ascending=[False, True, False, True, True]).reset_index(drop=True)
        inside = set(pdf.index[pdf.chosen])
        target = -(-int(round(len(inside) * p.commercial_min_ratio * 1e9)) // 10**9)
        count = int(pdf.commercial[list(inside)].sum())
        if have >= target:
            per = pdf.loc[list(inside)].groupby("source_id").size().to_dict()
            for i in pdf.index[~pdf.chosen & pdf.commercial]:
                if count >= target:
                    break
                source = pdf.source_id[i]
                for j in sorted((x for x in inside if not pdf.commercial[x]), reverse=True):
                    if per.get(source, 0) - (pdf.source_id[j] == source) < p.max_per_source:
                        inside.remove(j)
                        inside.add(i)
                        per[pdf.source_id[j]] -= 1
                        per[source] = per.get(source, 0) + 1
                        count += 1
                        break
        out = pdf.loc[sorted(inside), ["seq", "source_id", "category", "final_rank", "commercial"]].reset_index(drop=True)
        out["place"] = range(1, len(out) + 1)
        return out

    kinds = dict(frame.dtypes)
    return frame.groupBy(F.lit(1).alias("one")).applyInPandas(repair, f"seq {kinds['seq']}, source_id {kinds['source_id']}, category string, final_rank double, commercial boolean, place long")


def must_read(brief: DataFrame, bar: float = 6.0) -> DataFrame:
    """The brief in order, alerts first where an id repeats, split at the bar into must_read and news with a place in each."""
    order = F.struct((~F.col("risk_alert")).alias("a"), F.col("seq").alias("s"))
    rest = [c for c in brief.columns if c != "id"]
    once = brief.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("id", "r.*")
    part = F.when(F.col("base_rank") >= bar, "must_read").otherwise("news")
    return windows.numbered(once.withColumn("part", part), [F.desc("final_rank"), F.desc("published_at"), F.asc("url"), F.asc("seq")], by="part")
