"""The industry edition's stage chain: window, URL merge, contracts, analysis, event merge, evidence, memory, ranking, brief."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis, clusters, evidence, memory, merge, ranking, windows
from ..ship import checkpoint_dir
from . import render


@dataclass
class Brief:
    """What a run gives: the brief's rows (bounded by the profile, and the alerts), counts, and the document with its hash."""

    rows: list[dict]
    counts: dict[str, int]
    document: dict
    memory: DataFrame = field(repr=False)


def run(raw: DataFrame, contracts: DataFrame, scorers: list, seen: DataFrame, profile: ranking.Profile, since: str, until: str, known: DataFrame | None = None) -> Brief:
    """raw: items (seq, id, source_id, source_type, title, url, content, metadata, published_at); seen: memory (event_key, seen_at); known: remembered reports (clusters.reports, and seen_at), against which events are held by likeness too."""
    checkpoint_dir(raw.sparkSession)
    inside = windows.in_window(raw, since, until)
    one = merge.merge_by_url(inside).select("id", F.col("content").alias("merged"))
    unique = inside.join(one, "id").withColumn("content", F.col("merged")).drop("merged")
    normal = analysis.normalised(unique, contracts)
    answers = analysis.scored_by(normal.where("not isolated").withColumn("prompt", analysis.prompt(6000)), scorers)
    scored = analysis.analysed(normal, answers).checkpoint()  # scorers are called once
    live = scored.where("not isolated").withColumns({"has_food": F.lit(True), "publisher": F.col("source_id"), "linked_tier": F.lit(None).cast("int")})
    seen_urls = merge.keyed(live)
    reports = clusters.reports(seen_urls).checkpoint()
    labels = merge.components(clusters.similar_events(reports), reports.select(F.col("seq").alias("node"))).withColumnsRenamed({"node": "seq", "label": "_same"})
    # exact keys and likeness together: the keys of what is alike count as one
    one_key = live.join(labels, "seq").select("seq", "event_key", "_same")
    links = one_key.groupBy("event_key").agg(F.min("_same").alias("a")).join(one_key.select("event_key", F.col("_same").alias("b")).distinct(), "event_key").select("a", "b").where("a <> b")
    groups = merge.components(links, one_key.select(F.col("_same").alias("node")).distinct()).withColumnsRenamed({"node": "_same", "label": "_group"})
    grouped = live.join(one_key.join(groups, "_same").select("seq", F.col("_group").cast("string").alias("_group")), "seq")
    events = merge.merge_by_event(grouped.drop("evidence"), "_group")
    merged = live.join(events.select("id", F.col("evidence").alias("_all"), "members"), "id").withColumn("evidence_urls", F.sort_array(F.array_union("evidence_urls", "_all"))).drop("_all")
    decided = evidence.decide(merged).checkpoint()
    fresh = memory.unseen(decided.where("accepted"), seen, until)
    if known is not None:
        fresh = fresh.join(memory.unlike(reports, known, until).select("seq"), "seq", "left_semi")
    ranked = ranking.ranked(fresh, profile).where((F.col("base_rank") >= profile.minimum_score) | F.col("risk_alert")).checkpoint()
    regular = ranked.where("not risk_alert")
    chosen = ranking.explored(regular, profile).drop("exploration")
    mixed = ranking.commercial_mix(chosen, regular, profile).select("seq")
    brief = ranking.must_read(ranked.join(mixed, "seq", "left_semi").unionByName(ranked.where("risk_alert")))
    rows = [{"part": r["part"], "title": r["title"], "url": r["url"], "summary": r["ai_summary"], "final_score": round(r["final_rank"], 4)} for r in brief.orderBy("part", "place").collect()]
    totals = decided.agg(F.count("*").alias("events"), F.count_if("accepted").alias("admitted")).first().asDict()
    counts = {"isolated": scored.where("isolated").count(), "scored": scored.count(), **totals, "selected": len(rows)}
    return Brief(rows, counts, render.facts(rows, {"title": "Brief", "until": until}), memory.remembered(seen, ranked, until))
