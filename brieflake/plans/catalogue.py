"""Every query of the engine's own operators over the driver's tables, and its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import clusters, digest, evidence, memory, merge, metrics, ranking, rotation, windows
from ..sources.interests import interest_scores
from ..streaming import dedup
from .registry import oracle_sql, queries, query
from .views import EV, FOOD, PG, food_ev, items_ev, items_pg, table

SINCE, UNTIL, NOW = "2024-01-03 00:00:00", "2024-01-20 12:00:00", "2024-01-25 00:00:00"
GROUPS = {"commerce": (["purchase", "signup"], 12), "traffic": (["view", "click", "purchase"], 7)}
PROFILE = ranking.Profile(market_weights={"JP": 0.2, "US": 0.05})
WEIGHTS = ", ".join(f"('{c}', {w})" for c, w in PROFILE.topic_weights.items())

__all__ = ["oracle_sql", "queries"]

# --- windows, thresholds, digest


@query(f"with {EV} select seq, source_id, category, ai_score from ev where published_at between timestamp '{SINCE}' and timestamp '{UNTIL}'")
def window_filter(spark: SparkSession, sf: str) -> DataFrame:
    return windows.in_window(items_ev(spark, sf), SINCE, UNTIL).select("seq", "source_id", "category", "ai_score")


@query(f"with {EV} select seq, ai_score from ev where ai_score >= 7")
def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return windows.above_threshold(items_ev(spark, sf), 7.0).orderBy(*windows.by_score()).select("seq", "ai_score")


@query(f"with {EV}, p as (select seq, ai_score, (select count(*) > 500 from ev) as truncated from ev order by coalesce(ai_score, 0) desc, seq limit 500) select seq, ai_score, truncated, row_number() over (order by coalesce(ai_score, 0) desc, seq)::integer as place from p")
def score_page(spark: SparkSession, sf: str) -> DataFrame:
    return windows.page(items_ev(spark, sf), windows.by_score(), 500).select("seq", "ai_score", "truncated", "place")


_DIGEST = f"""with {EV}, g as (select *, case when category in ('purchase', 'signup') then 'commerce' when category in ('view', 'click') then 'traffic' else 'default' end as grp from ev where ai_score >= 1),
r as (select *, row_number() over (partition by grp order by ai_score desc, seq) as in_group from g),
d as (select * from r where in_group <= case grp when 'commerce' then 12 when 'traffic' then 7 else 5 end order by ai_score desc, seq limit 20)"""


def _digest(spark: SparkSession, sf: str) -> DataFrame:
    return digest.balanced_digest(windows.above_threshold(items_ev(spark, sf), 1.0), GROUPS, default_limit=5, cap=20)


@query(_DIGEST + " select seq, grp, ai_score, in_group::integer as in_group, row_number() over (order by ai_score desc, seq)::integer as place from d")
def balanced_digest(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(spark, sf).select("seq", "grp", "ai_score", "in_group", "place")


@query(_DIGEST + " select grp, count(*) as n from d group by grp")
def digest_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    return digest.group_counts(_digest(spark, sf))


@query(f"with {EV} select count_if(ai_score < 3) as b0_2, count_if(ai_score >= 3 and ai_score < 5) as b3_4, count_if(ai_score >= 5 and ai_score < 7) as b5_6, count_if(ai_score >= 7 and ai_score < 9) as b7_8, count_if(ai_score >= 9) as b9_10 from ev".replace("count_if(", "count(*) filter (where "))
def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.score_distribution(items_ev(spark, sf))


# --- URL keys and merges

_KEY = """lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) as scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host,
  coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') as path,
  array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: not (starts_with(lower(split_part(p, '=', 1)), 'utm_') or lower(split_part(p, '=', 1)) in ('_ga','dclid','fbclid','gclid','igshid','li_fat_id','mc_cid','mc_eid','msclkid','ttclid','twclid','vero_id'))), '&') as q"""
_PKEY = f"pk as (select *, {_KEY} from pg), pz as (select *, scheme || chr(31) || chr(31) || chr(31) || host || chr(31) || chr(31) || path || chr(31) || q as url_key from pk)"


@query(f"with {PG}, {_PKEY} select seq, url_key from pz")
def url_key(spark: SparkSession, sf: str) -> DataFrame:
    return merge.keyed(items_pg(spark, sf)).select("seq", "url_key")


@query(
    f"""with {PG}, {_PKEY},
o as (select *, row_number() over (partition by url_key order by length(content) desc, seq) as pr, min(seq) over (partition by url_key) as first_seq, count(*) over (partition by url_key) as n_members from pz),
h as (select url_key, seq, id, url, content, first_seq, n_members, source_type from o where pr = 1),
t as (select url_key, string_agg(chr(10) || chr(10) || '--- From ' || o.source_type || ' ---' || chr(10) || o.content, '' order by o.seq) as tail from o join h using (url_key) where o.seq <> h.seq and o.content <> '' and not contains(h.content, o.content) group by url_key),
m as (select url_key, string_agg(distinct source_type, ',' order by source_type desc) as types from o group by url_key)
select h.seq, h.id, h.first_seq, h.n_members, h.content || coalesce(t.tail, '') as content, case when n_members > 1 then m.types end as merged_sources from h left join t using (url_key) join m using (url_key)"""
)
def cross_source_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_by_url(items_pg(spark, sf)).select("seq", "id", "first_seq", "n_members", "content", F.array_join("merged_sources", ",").alias("merged_sources"))


@query(
    f"""with {PG}, p as (select seq, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) as scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host,
  coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') as path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' and not (starts_with(lower(split_part(p, '=', 1)), 'utm_') or lower(split_part(p, '=', 1)) in ('dclid','fbclid','gclid','mc_cid','mc_eid','msclkid')))), '&') as q from pg)
select seq, 'url:' || sha256(scheme || '://' || host || path || case when q = '' then '' else '?' || q end) as event_url_key from p"""
)
def url_event_hash(spark: SparkSession, sf: str) -> DataFrame:
    return items_pg(spark, sf).select("seq", urls.event_url_key(F.col("url")).alias("event_url_key"))


@query("select min(doc_id) as doc_id, count(*) as copies, sha256(text) as text_hash from documents group by text")
def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    first = windows.first_wins(d.withColumn("seq", F.col("doc_id")), "text_hash").select("doc_id", "text_hash")
    return first.join(d.groupBy("text_hash").agg(F.count("*").alias("copies")), "text_hash").select("doc_id", "copies", "text_hash")


@query(
    f"""with {EV}, {FOOD}, r as (select *, row_number() over (partition by event_key order by evidence_tier, -evidence_quality, url, seq) as n from food where event_key is not null),
g as (select event_key, count(*) as members, list_sort(list(distinct source_id)) as sources, list_sort(list(distinct url)) as evidence from food where event_key is not null group by event_key)
select g.event_key, r.id, r.seq, r.url, g.members, len(sources)::integer as n_sources, array_to_string(evidence, ' ') as evidence from g join r on r.event_key = g.event_key and r.n = 1
union all select null, id, seq, url, 1, 1, url from food where event_key is null"""
)
def exact_event_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = merge.merge_by_event(food_ev(spark, sf))
    return m.select("event_key", "id", "seq", "url", "members", F.size("sources").alias("n_sources"), F.array_join("evidence", " ").alias("evidence"))


@query(
    """with s as (select ps_seq as seq, id, tier, pack from (select o_orderkey as ps_seq, 'S' || (o_custkey % 200) as id, o_orderpriority as tier, 'pack' || (o_orderkey % 9) as pack from orders)),
f as (select id, tier, row_number() over (partition by id order by seq) as n from s)
select f.id, f.tier, (select string_agg(distinct pack, ',' order by pack) from s where s.id = f.id) as packs from f where n = 1"""
)
def source_spec_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    specs = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("S"), F.col("o_custkey") % 200).alias("id"), F.col("o_orderpriority").alias("tier"), F.lit("rss").alias("adapter"), F.lit(None).cast("string").alias("url"), F.array(F.concat(F.lit("pack"), F.col("o_orderkey") % 9)).alias("packs"))
    return merge.merge_source_specs(specs).select("id", "tier", F.array_join("packs", ",").alias("packs"))


# --- contracts and evidence


@query(f"with {EV} select seq, source_id, case when source_id % 5 = 0 then null when source_id % 5 < 3 then 'core' else 'extended' end as contract_tier, source_id % 5 = 0 as isolated, case when source_id % 5 = 0 then 0.0 else ai_score end as ai_score from ev")
def contract_join(spark: SparkSession, sf: str) -> DataFrame:
    items = items_ev(spark, sf)
    contracts = items.select("source_id").distinct().where("source_id % 5 <> 0").withColumn("contract_tier", F.when(F.col("source_id") % 5 < 3, "core").otherwise("extended"))
    return evidence.with_contract(items, contracts).select("seq", "source_id", "contract_tier", "isolated", "ai_score")


# in the view: attributable originals are those of seq % 6 in (4, 5); two domains those of seq % 5 = 2; web evidence is there unless seq % 5 in (0, 4); an aggregator for seq % 5 = 3
_DECISION = f"""{EV}, {FOOD}, dec as (select *, case
  when not has_food then '-missing food analysis' when isolated then '-isolated analysis'
  when category in ('regulations_standards', 'food_safety_recalls') and len(official_urls) = 0 then '-official evidence required'
  when relevant is not distinct from false then '-not food-industry relevant'
  when evidence_tier in (1, 2) then '+accepted authoritative evidence'
  when evidence_tier = 3 then case when seq % 6 in (4, 5) and seq % 5 not in (0, 4) then '+accepted single attributable source' when seq % 5 = 2 then '+accepted corroborated discovery'
    when seq % 4 in (2, 3) and seq % 5 = 3 then '+accepted attributable aggregator fallback' when seq % 4 in (0, 1) then '-discovery publisher could not be identified' else '-discovery has no usable evidence URL' end
  when original_url is not null and linked_tier between 1 and 3 then '+accepted linked weak signal' else '-weak signal requires original source and linked evidence' end as v from food),
decided as (select *, starts_with(v, '+') as accepted, substr(v, 2) as reason, case when not has_food then 4 when v = '+accepted linked weak signal' then linked_tier else evidence_tier end as effective_tier from dec)"""


@query(f"with {_DECISION} select seq, accepted, reason, effective_tier, case when accepted and (sponsored or press_release) then greatest(0.0, evidence_quality - 2) else evidence_quality end as quality from decided")
def evidence_decision(spark: SparkSession, sf: str) -> DataFrame:
    d = evidence.decide(food_ev(spark, sf))
    return d.select("seq", "accepted", "reason", "effective_tier", evidence.penalised(F.col("evidence_quality"), F.col("accepted"), F.col("sponsored"), F.col("press_release")).alias("quality"))


@query(
    f"with {_DECISION} select "
    + ", ".join(f"count(*) filter (where reason in ({', '.join(chr(39) + r + chr(39) for r in rs)})) as {b}" for b, rs in evidence.BUCKETS.items())
    + f", count(*) filter (where reason not in ({', '.join(chr(39) + r + chr(39) for rs in evidence.BUCKETS.values() for r in rs)})) as rejected_other from decided"
)
def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.summary(evidence.decide(food_ev(spark, sf)))


# --- ranking and selection

RANK = f"""{EV}, {FOOD}, tw(category, w) as (values {WEIGHTS}),
rk as (select f.*, f.evidence_tier as effective_tier, (0.45::double * importance + 0.25::double * relevance + 0.2::double * opportunity + 0.1::double * evidence_quality) as base_rank, tw.w::double as w,
  case when 'JP' = any(markets) then 0.2::double when 'US' = any(markets) then 0.05::double else 0.0::double end as boost,
  case when len(markets) = 0 then 0.0::double else (case when 'IN' = any(markets) then 0.5::double else 0.0::double end) / len(list_distinct(markets)) end as pen from food f join tw using (category)),
ranked as (select *, base_rank * (1 + w) * ((1 + boost) * (1 - pen)) as final_rank, risk_level in ('high', 'severe') as risk_alert from rk)"""
_ORDER = "final_rank desc, effective_tier, published_at desc, url, seq"


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked(food_ev(spark, sf), PROFILE).withColumn("effective_tier", F.col("evidence_tier"))


@query(f"with {RANK} select seq, floor(base_rank * 1000000 + 0.5::double) / 1000000 as base_rank, floor(final_rank * 1000000 + 0.5::double) / 1000000 as final_rank, risk_alert from ranked")
def profile_rank(spark: SparkSession, sf: str) -> DataFrame:
    six = lambda c: (F.floor(F.col(c) * 1_000_000 + 0.5) / 1_000_000.0).alias(c)  # noqa: E731  one way of rounding in both engines
    return ranked(spark, sf).select("seq", six("base_rank"), six("final_rank"), "risk_alert")


@query(f"with {RANK} select risk_alert, risk_level, count(*) as n from ranked group by all")
def risk_partition(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf).groupBy("risk_alert", "risk_level").agg(F.count("*").alias("n"))


@query(f"with {RANK}, s as (select *, row_number() over (partition by source_id order by {_ORDER}) as in_source from ranked where not risk_alert) select seq, source_id, in_source::integer as in_source from s where in_source <= 3 order by {_ORDER} limit 20")
def source_cap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.source_capped(ranked(spark, sf).where("not risk_alert"), 3, 20).select("seq", "source_id", "in_source")


_EXPLORE = f"""{RANK}, reg as (select * from ranked where not risk_alert),
e1 as (select *, row_number() over (partition by source_id order by {_ORDER}) as n from reg where w < (select median(w) from tw)),
e as (select * exclude (n) from e1 where n <= 3 order by {_ORDER} limit 2),
r1 as (select *, row_number() over (partition by source_id order by {_ORDER}) as n from reg where seq not in (select seq from e)),
r2 as (select r1.* exclude (n) from r1 where n + (select count(*) from e where e.source_id = r1.source_id) <= 3),
sel as (select *, true as exploration from e union all select * from (select *, false as exploration from r2 order by {_ORDER} limit 18))"""


@query(f"with {_EXPLORE} select seq, source_id, category, exploration from sel")
def exploration_select(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.explored(ranked(spark, sf).where("not risk_alert"), PROFILE).select("seq", "source_id", "category", "exploration")


@query()
def commercial_mix(spark: SparkSession, sf: str) -> DataFrame:
    pool = ranked(spark, sf).where("not risk_alert")
    return ranking.commercial_mix(ranking.explored(pool, PROFILE).drop("exploration"), pool, PROFILE)


@query(
    f"""with {RANK}, b as (select cast(k as varchar) as id, * exclude (id) from ranked where final_rank >= 2), o as (select *, row_number() over (partition by id order by not risk_alert, seq) as n from b),
p as (select *, case when base_rank >= 3 then 'must_read' else 'news' end as part from o where n = 1)
select id, seq, part, row_number() over (partition by part order by final_rank desc, published_at desc, url, seq)::integer as place from p"""
)
def must_read_partition(spark: SparkSession, sf: str) -> DataFrame:
    brief = ranked(spark, sf).where("final_rank >= 2").withColumn("id", F.col("k").cast("string"))
    return ranking.must_read(brief, 3.0).select("id", "seq", "part", "place")


# --- similarity


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as reports: the first line is the title, the whole text the summary; tags are the title's first longer words."""
    d = table(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", "lang", "source")
    title = F.coalesce("title", F.lit(""))
    low = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N} ]", "")
    ws = F.filter(F.split(low, " +"), lambda w: F.length(w) >= 8)
    r = d.select(
        F.col("doc_id").alias("seq"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600).alias("published_at"), F.concat(F.lit("u"), F.col("doc_id")).alias("url_key"), title.alias("title"), F.lit(None).cast("string").alias("title_zh"),
        F.col("text").alias("summary"), F.col("source").alias("category"), F.array("lang").alias("markets"), F.slice(ws, 1, 1).alias("companies"), F.slice(ws, 2, 3).alias("subjects"), clusters.event_kinds(low).alias("kinds"), F.slice(ws, 1, 2).alias("key_parts"),
        F.array(F.regexp_replace(low, " ", "")).alias("folded"),
    )
    return r.withColumn("blocks", clusters.blocks(F.col("folded"), F.col("companies"), F.col("subjects"))).drop("folded")


@query()
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.similar_events(_reports(spark, sf))


@query()
def event_clusters(spark: SparkSession, sf: str) -> DataFrame:
    r = _reports(spark, sf)
    return merge.components(clusters.similar_events(r), r.select(F.col("seq").alias("node"))).select(F.col("node").alias("seq"), F.col("label").alias("cluster"))


@query(
    """with t as (select p_partkey as seq, p_name as title, p_size, p_brand from part),
p as (select x.seq as a, y.seq as b from t x join t y on x.p_brand = y.p_brand and x.p_size = y.p_size and x.seq < y.seq where levenshtein(x.title, y.title) <= 3),
e as (select a, b from p union all select b, a from p), r as (select seq as a, seq as b from t union select r.a, e.b from r join e on r.b = e.a)
select a as seq, min(b) as cluster from r group by a""".replace("with t as", "with recursive t as")
)
def blocked_levenshtein_clusters(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("title"), "p_brand", "p_size")
    return clusters.near_titles(t, 3, "p_brand", "p_size").select("seq", "cluster")


@query("select doc_id, array_to_string(list_filter([" + ", ".join("case when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{k}' end" for k, ws in sorted(clusters.EVENT_KINDS.items())) + "], lambda x: x is not null), ',') as kinds from documents")
def event_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(clusters.event_kinds(F.lower("text")), ",").alias("kinds"))


@query(
    "select p_partkey, array_to_string(list_sort(list_distinct(list_filter([regexp_replace(lower(n), '[^a-z0-9]', '', 'g'), case when length(array_to_string(w, '')) >= 4 then array_to_string(w, '') else '' end, case when len(w) between 3 and 8 then array_to_string(list_transform(w, lambda x: x[1]), '') else '' end], lambda x: x <> ''))), ',') as tags "
    f"from (select p_partkey, n, list_filter(string_split_regex(lower(n), '[^a-z0-9]+'), lambda x: x <> '' and x not in ({', '.join(chr(39) + w + chr(39) for w in clusters.COMPANY_STOP_WORDS)})) as w from (select p_partkey, p_name || ' ' || p_type || ' Group of Co.' as n from part))"
)
def company_tags(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array_join(clusters.company_tags(F.array(F.concat("p_name", F.lit(" "), "p_type", F.lit(" Group of Co.")))), ",").alias("tags"))


# --- memory and ledgers


@query(f"with {EV}, {FOOD} select seq, event_key from food where published_at >= timestamp '2024-01-20' and (event_key is null or event_key not in (select event_key from food where event_key is not null and published_at >= timestamp '{NOW}' - interval 7 day and published_at < timestamp '2024-01-20'))")
def memory_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    f = food_ev(spark, sf)
    old = f.where("event_key is not null and published_at < timestamp_ntz '2024-01-20 00:00:00'").select("event_key", F.col("published_at").alias("seen_at"))
    return memory.unseen(f.where("published_at >= timestamp_ntz '2024-01-20 00:00:00'"), old, NOW).select("seq", "event_key")


@query("select o_custkey % 50 as run_id, o_orderpriority as channel, o_orderkey as hash from orders where not (o_orderstatus = 'F' and o_orderkey % 2 = 0)")
def undelivered(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderpriority").alias("channel"), F.col("o_orderkey").alias("hash"), F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0), "success").otherwise("failed").alias("status"))
    return memory.undelivered(o.drop("status"), o)


@query("select o_orderkey as file_id, run_id from (select *, o_custkey % 20 as run_id, case when o_orderkey % 40 = 0 then 'brief' else 'stage' end as kind, datediff('day', o_orderdate, timestamp '2002-01-01') as age from orders) f where (kind = 'stage' and age > 2000) or run_id in (select o_custkey % 20 from orders where o_orderkey % 40 = 0 and datediff('day', o_orderdate, timestamp '2002-01-01') > 2520)")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 20).alias("run_id"), F.when(F.col("o_orderkey") % 40 == 0, "brief").otherwise("stage").alias("kind"), F.col("o_orderdate").alias("written_at"))
    return memory.expired(o, "2002-01-01", 2000, 2520).select("file_id", "run_id")


@query("select doc_id, case when toxic is null then 'plain' else 'scored ' || toxic end as summary from documents left join (select doc_id, max(toxic) as toxic, min(quality) as quality from labels group by doc_id) using (doc_id) where coalesce(quality, 1) = 1")
def enrichment_join(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("plain").alias("summary"))
    e = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q")).select(F.col("doc_id").alias("id"), F.concat(F.lit("scored "), "t").alias("summary"), (F.col("q") == 0).alias("isolated"))
    return memory.with_enriched(d, e).select(F.col("id").alias("doc_id"), "summary")


# --- metrics

OUT = "o as (select user_id as source_id, case when user_id % 7 = 0 then 'skipped_rotation' when user_id % 6 = 0 then 'failure' when user_id % 6 = 1 then 'empty' else 'success' end as status, case when user_id % 7 = 0 or user_id % 6 < 2 then 0 else count(*) end as item_count from events group by user_id)"


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.count("*").alias("n"))
    m, skipped = F.col("source_id") % 6, F.col("source_id") % 7 == 0
    n = F.when(skipped | (m < 2), 0).otherwise(F.col("n")).cast("long")
    return c.select("source_id", F.when(skipped, "skipped_rotation").when(m == 0, "failure").when(m == 1, "empty").otherwise("success").alias("status"), n.alias("item_count"), n.alias("candidate_count"))


@query(f"with {OUT} select count(*) filter (where status <> 'skipped_rotation') as attempted, count(*) filter (where status in ('success', 'empty')) as successful, count(*) filter (where status = 'empty') as empty, count(*) filter (where status = 'failure') as failed, sum(item_count)::bigint as item_count, 'partial_failure' as status from o")
def fetch_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.fetch_report(outcomes(spark, sf))


@query(
    f"""with {EV}, {FOOD}, {OUT}, t as (select sum(item_count) as total from o), s as (select distinct source_id from ev),
i as (select source_id, not isolated and relevant is distinct from false as rel, ai_score >= 1 as adm, category not in ('regulations_standards', 'food_safety_recalls') as com, sponsored, seq % 3 as dup, coalesce(event_key, id) as event_key from food),
p as (select source_id, count(*) filter (where rel) as relevant_count, count(*) filter (where adm) as admitted_count, count(*) filter (where adm and com) as commercial_count, count(*) filter (where adm and sponsored) as sponsored_count, coalesce(sum(dup) filter (where adm), 0)::bigint as duplicate_count, count(distinct event_key) filter (where adm) as unique_count from i group by source_id)
select s.source_id, o.status as fetch_status, coalesce(o.item_count, 0)::bigint as candidate_count, relevant_count, admitted_count, commercial_count, sponsored_count, duplicate_count, unique_count,
  case when o.status = 'skipped_rotation' then 0 else round_even(1000000 * o.item_count::double / total, 0)::bigint end as ai_tokens, round(case when o.status = 'skipped_rotation' then 0.0 else 12.5::double * (o.item_count::double / total) end, 8) as estimated_cost
from s left join o using (source_id) left join p using (source_id), t"""
)
def source_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    f = food_ev(spark, sf)
    i = f.select("source_id", (~F.col("isolated") & ~F.col("relevant").eqNullSafe(False)).alias("relevant"), (F.col("ai_score") >= 1).alias("admitted"), F.col("category").isin(*ranking.COMMERCIAL).alias("commercial"), "sponsored", (F.col("seq") % 3).alias("duplicates"), F.coalesce("event_key", "id").alias("event_key"))
    return metrics.source_run_metrics(f.select("source_id").distinct(), outcomes(spark, sf), i, 1_000_000, 12.5)


_TRIAL = """tr as (select user_id % 40 as source_id, cast(ts as date) as day, case when gap or event_id % 11 = 0 then 'manual' else 'scheduled' end as provenance,
  case when gap or event_id % 9 = 2 then 'skipped_rotation' when event_id % 9 = 0 then 'failure' when event_id % 9 = 1 then 'empty' else 'success' end as fetch_status, case when user_id % 40 = 7 then 'paywall' when user_id % 40 = 9 then 'robots_denied' else 'open' end as access_mode,
  (100 - event_id % 13) / 100.0::double as parse_rate, event_id % 20 as candidate_count, event_id % 5 as admitted_count, event_id % 3 as commercial_count, event_id % 2 as duplicate_count, event_id % 4 as unique_count,
  case when user_id % 40 = 3 then null else value / 8 end as cost from (select *, (user_id + cast(epoch(date_trunc('day', ts)) / 86400 as bigint)) % 23 = 0 as gap from events) e)"""


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    # on its gap days a source has no scheduled run and nothing is fetched
    e = table(spark, sf, "events").withColumn("gap", F.expr("(user_id + unix_date(cast(ts as date))) % 23 = 0"))
    i, u = F.col("event_id"), F.col("user_id") % 40
    return e.select(
        u.alias("source_id"), F.to_date("ts").alias("day"), F.when(F.col("gap") | (i % 11 == 0), "manual").otherwise("scheduled").alias("provenance"), F.when(F.col("gap") | (i % 9 == 2), "skipped_rotation").when(i % 9 == 0, "failure").when(i % 9 == 1, "empty").otherwise("success").alias("fetch_status"),
        F.when(u == 7, "paywall").when(u == 9, "robots_denied").otherwise("open").alias("access_mode"), ((100 - i % 13) / 100.0).cast("double").alias("parse_rate"), (i % 20).alias("candidate_count"), (i % 5).alias("admitted_count"), (i % 3).alias("commercial_count"), (i % 2).alias("duplicate_count"), (i % 4).alias("unique_count"), F.when(u != 3, F.col("value") / 8).alias("cost"),
    )


@query(
    f"""with {_TRIAL}, ds as (select distinct source_id, day from tr where provenance = 'scheduled'),
g as (select *, day - cast(row_number() over (partition by source_id order by day) as integer) as isl from ds), rn as (select source_id, isl, min(day) as s, max(day) as e, count(*) as len from g group by all),
b as (select * from (select *, row_number() over (partition by source_id order by len desc, e desc) as n from rn) where n = 1), w as (select source_id, len as consecutive_days, greatest(e - 13, s) as lo, e as hi from b),
j as (select tr.*, w.consecutive_days, coalesce(day between lo and hi, false) as inside from tr left join w using (source_id)),
st as (select source_id, count(distinct day) filter (where provenance = 'scheduled') as trial_days, coalesce(max(consecutive_days), 0) as consecutive_days, count(distinct day) filter (where provenance = 'scheduled' and inside and fetch_status <> 'skipped_rotation') as attempt_days, bool_or(provenance = 'scheduled' and fetch_status <> 'skipped_rotation') as anys from j group by source_id),
c as (select *, consecutive_days >= 14 and attempt_days >= 4 as complete from st),
ev2 as (select j.*, c.complete, fetch_status <> 'skipped_rotation' and case when c.complete then provenance = 'scheduled' and inside when c.anys then provenance = 'scheduled' else provenance = 'manual' end as x from j join c using (source_id)),
a as (select source_id, count(*) filter (where x) as run_count, count(*) filter (where x and fetch_status in ('success', 'empty')) as okc, sum(parse_rate) filter (where x) as ps, coalesce(sum(candidate_count) filter (where x), 0)::bigint as candidate_count, coalesce(sum(admitted_count) filter (where x), 0)::bigint as admitted_count, coalesce(sum(commercial_count) filter (where x), 0)::bigint as cc, coalesce(sum(duplicate_count) filter (where x), 0)::bigint as dc, coalesce(sum(unique_count) filter (where x), 0)::bigint as unique_count,
  bool_or(x and access_mode in ('robots_denied', 'terms_denied')) as denied, bool_or(x and access_mode in ('paywall', 'login_required', 'robots_denied', 'terms_denied')) as restr, bool_or(x and cost is null) as open_, sum(cost) filter (where x) as co from ev2 group by source_id),
f as (select *, case when run_count > 0 then okc / run_count::double else 0 end as okr, case when run_count > 0 then ps / run_count else 0 end as pr from a join c using (source_id)),
t as (select *, case when not complete then 'pending' when denied or okr < 0.5 or unique_count = 0 then 'disable' when okr >= 0.9 and pr >= 0.9 and unique_count >= 5 then 'core' when okr >= 0.7 and unique_count >= 2 then 'extended' else 'discovery' end as tier from f)
select source_id, trial_days, consecutive_days, attempt_days, case when complete then 'complete' else 'provisional' end as trial_status, run_count, round(okr, 6) as success_rate, round(pr, 6) as parse_rate, candidate_count, admitted_count, unique_count,
  round(case when admitted_count > 0 then cc / admitted_count::double else 0 end, 6) as commercial_share, round(case when dc + unique_count > 0 then dc / (dc + unique_count)::double else 0 end, 6) as duplicate_rate, case when open_ then null else round(coalesce(co, 0), 6) end as estimated_cost,
  tier as recommended_tier, case tier when 'pending' then 'pending' when 'disable' then 'disabled' else case when restr then 'metadata_or_query' else 'direct_metadata' end end as recommended_mode from t"""
)
def trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.trial_summary(_trials(spark, sf))


@query(
    """with u as (select 'p' || (user_id % 3) as provider, event_type as model, event_id % 1000 as i, event_id % 300 as o from events), p(provider, model, ip, op) as (values ('p0', 'view', 2.0, 4.0), ('p1', 'view', 1.5, 3.0), ('p2', 'click', 0.5, 1.0), ('p0', 'click', 1.0, null)),
g as (select provider, model, sum(i) as i, sum(o) as o from u group by all), j as (select g.*, p.ip, p.op from g left join p on g.provider = p.provider and g.model = p.model and p.ip is not null and p.op is not null)
select sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, coalesce(string_agg(provider || '/' || model, ',' order by provider || '/' || model) filter (where ip is null and i + o > 0), '') as unpriced, case when count(*) filter (where ip is null and i + o > 0) = 0 then round(coalesce(sum((i * ip::double + o * op::double) / 1000000), 0), 8) end as estimated_cost from j"""
)
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").select(F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 300).alias("output_tokens"))
    prices = spark.createDataFrame([("p0", "view", 2.0, 4.0), ("p1", "view", 1.5, 3.0), ("p2", "click", 0.5, 1.0), ("p0", "click", 1.0, None)], "provider string, model string, in_price double, out_price double")
    return metrics.token_cost(u, prices)


@query("select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as run_id from orders where o_orderstatus <> 'P' group by o_custkey".replace("max_by(o_orderkey, (o_orderdate, o_orderkey))", "arg_max(o_orderkey, row(o_orderdate, o_orderkey))"))
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'").withColumn("run_id", F.col("o_orderkey"))
    return windows.latest(o, "run_id", "o_orderdate", "o_orderkey", by=["o_custkey"])


# --- rotation

@query(
    """with s as (select 'src-' || c_custkey as source_id, case c_custkey % 3 when 0 then 'core' when 1 then 'extended' else 'discovery' end as tier from customer where c_custkey % 10 <> 9),
h as (select *, list_reduce(list_prepend(0::bigint, list_transform(string_split(sha256(source_id), ''), lambda d: (instr('0123456789abcdef', d) - 1)::bigint)), lambda a, d: (a * 16 + d) % case when tier = 'extended' then 3 else 7 end) as bucket from s)
select source_id, tier from h where tier = 'core' or bucket = (date_diff('day', date '0001-01-01', date '2026-07-24') + 1) % case when tier = 'extended' then 3 else 7 end"""
)
def source_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return rotation.rotated(sources(spark, sf), "2026-07-24", 3, 7).where("due").select("source_id", "tier")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.concat(F.lit("src-"), c).alias("source_id"), F.when(c % 3 == 0, "core").when(c % 3 == 1, "extended").otherwise("discovery").alias("tier"), (c % 10 != 9).alias("enabled"))


@query("select source_id, tier from (select 'src-' || c_custkey as source_id, case c_custkey % 3 when 0 then 'core' when 1 then 'extended' else 'discovery' end as tier from customer where c_custkey % 10 <> 9) order by case when tier = 'extended' then 0 else 1 end, sha256('2026-07-24:' || source_id), source_id limit 40")
def fallback_order(spark: SparkSession, sf: str) -> DataFrame:
    return sources(spark, sf).where("enabled").orderBy(*rotation.fallback_order("2026-07-24")).limit(40).select("source_id", "tier")


@query("select max(o_orderdate) filter (where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') as last_completed, coalesce(max(o_orderdate) filter (where o_orderpriority = '1-URGENT' and o_orderstatus = 'F') >= timestamp '1998-01-01', false) as healthy from orders")
def freshness_check(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "scheduled").otherwise("manual").alias("provenance"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.col("o_orderdate").alias("started_at"))
    return windows.freshness(runs, "1998-01-01")


@query("select w as window_start, event_type as category, count(*) as n from (select event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as w, ts from events) where ts < w + interval 30 hour group by all")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sliding_counts(items_ev(spark, sf), "30 hours", "24 hours")


# --- comments, interests, text


@query("select conv_id, turn, length(text) as score, place::integer as place from (select *, row_number() over (partition by conv_id order by length(text) desc, turn) as place from conversations where role = 'user' and text <> '') where place <= 3")
def top_comments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'user' and text <> ''").withColumn("score", F.length("text").cast("long"))
    return windows.top_per_key(c, "conv_id", [F.desc("score"), F.asc("turn")], 3).select("conv_id", "turn", "score", F.col("rank").alias("place"))


@query(
    """with i(name, words) as (values ('law', ['licensed', 'apache']), ('talk', ['user', 'assistant', 'token']), ('the', ['the', 'with'])), d as (select doc_id, lower(text) as t, list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')) as w from documents),
s as (select doc_id, name, list_max(list_transform(words, lambda x: case when list_contains(w, x) then 1.0::double when contains(t, x) then 0.3::double else 0.0::double end)) as score from d, i)
select doc_id, name, score from s where score > 0"""
)
def interest_match(spark: SparkSession, sf: str) -> DataFrame:
    return interest_scores(table(spark, sf, "documents"), {"law": ["licensed", "apache"], "talk": ["user", "assistant", "token"], "the": ["the", "with"]})


@query("select doc_id, nullif(left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1200), '') as bounded, length(text) as n from documents")
def text_bound(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.bounded(F.col("text")).alias("bounded"), F.length("text").cast("long").alias("n"))


@query("select page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') as title from pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query(
    """with x as (select event_id, 'Up ' || value || ' million, then ' || (event_id % 90) || '.50% and ' || (event_id % 7) || 'bn' as t from events),
m as (select event_id, list_transform(regexp_extract_all(lower(t), '(?:^|[^0-9.])([0-9]+(?:\\.[0-9]+)?\\s*(?:%|％|亿|万|千|trillion|billion|million|bn|mn))', 1), lambda s: case when contains(s, '.') then regexp_replace(regexp_replace(regexp_extract(s, '^([0-9.]+)', 1), '0+$', ''), '\\.$', '') else regexp_extract(s, '^([0-9.]+)', 1) end || replace(replace(replace(regexp_replace(s, '^[0-9.]+\\s*', ''), '％', '%'), 'bn', 'billion'), 'mn', 'million')) as l from x)
select event_id, array_to_string(list_sort(list_distinct(l)), ' ') as signatures from m"""
)
def metric_signatures(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("Up "), F.col("value").cast("string"), F.lit(" million, then "), F.col("event_id") % 90, F.lit(".50% and "), F.col("event_id") % 7, F.lit("bn"))
    return table(spark, sf, "events").select("event_id", F.array_join(text.metric_signatures(t), " ").alias("signatures"))


@query("select event_type, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total, count(*) as n from events group by event_type")
def json_path(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count("*").alias("n"))


# --- streams, drained


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    batch = table(spark, sf, "events")
    # one file of the store, or a folder of them: the reader takes a pattern either way
    path = f"{sf}/events.parquet"
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf}/events.parque[t]")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(
    "with recursive e as (select distinct user_id, event_type, ts from events), r as (select user_id, event_type, min(ts) as ts from e group by all union all "
    "select e.user_id, e.event_type, min(e.ts) from r join e on e.user_id = r.user_id and e.event_type = r.event_type and e.ts > r.ts + interval 7 day group by e.user_id, e.event_type, r.ts) "
    "select user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at from r"
)
def stream_dedup_7d(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf).select("user_id", "event_type", F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("seen"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    return dedup.drained(dedup.unremembered(s, "key", "seen").select("user_id", "event_type", "at"), "stream-dedup")


@query("select epoch(date_trunc('day', ts))::bigint as day_start, event_type, count(*) as n from events group by all")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = _stream(spark, sf).select("event_type", F.col("ts").cast("timestamp").alias("at"))
    out = dedup.drained(dedup.window_counts(s, "at", "1 day", "2 days", "event_type"), "stream-counts", mode="complete")
    return out.select(F.unix_timestamp("window_start").alias("day_start"), "event_type", "n")


from . import source_queries  # noqa: E402, F401  registers its queries
