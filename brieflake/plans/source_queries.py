"""Queries of sources, services and reports over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains, text, urls
from ..operators import analysis, digest, memory, metrics, ranking, rotation, windows
from ..sources import adapters, attempts, interests, original, readers
from . import catalogue, constraints, service
from .registry import oracle_sql, query
from .views import EV, FOOD, food_ev, items_ev, table

# --- reports of runs and sources


@query(f"select source_id, row_number() over (order by unique_count desc, commercial_share desc, success_rate desc, source_id)::integer as place from ({oracle_sql()['trial_summary']})")
def trial_report(spark: SparkSession, sf: str) -> DataFrame:
    return windows.numbered(catalogue.trial_summary(spark, sf), metrics.trial_order()).select("source_id", "place")


@query("select 'src-' || c_custkey as source_id, row_number() over (order by case c_custkey % 3 when 0 then 0 when 1 then 1 else 2 end, c_custkey)::integer as place from customer where c_custkey % 10 <> 9")
def fetch_priority(spark: SparkSession, sf: str) -> DataFrame:
    s = catalogue.sources(spark, sf).where("enabled").withColumn("seq", F.regexp_extract("source_id", r"(\d+)$", 1).cast("long"))
    return windows.numbered(s, rotation.fetch_order()).select("source_id", "place")


@query("select o_orderkey as run_id, (select count(*) > 30 from orders) as truncated, row_number() over (order by o_orderdate desc, o_orderkey desc)::integer as place from orders order by o_orderdate desc, o_orderkey desc limit 30")
def runs_newest(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return windows.page(runs, [F.desc("started_at"), F.desc("run_id")], 30).select("run_id", "truncated", "place")


@query("select case when status = 'failure' then '{\"source_id\":' || source_id || ',\"status\":\"failure\"}' else '{\"source_id\":' || source_id || ',\"status\":\"' || status || '\",\"item_count\":' || item_count || '}' end as outcome from (" + f"with {catalogue.OUT} select * from o)")
def outcome_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = catalogue.outcomes(spark, sf).withColumn("item_count", F.when(F.col("status") != "failure", F.col("item_count")))
    return o.select(metrics.outcome_json("source_id", "status", "item_count").alias("outcome"))


_CALLS = "c as (select event_id as seq, event_type as name, case event_id % 9 when 0 then 'timeout' when 1 then 'bad_limit' end as error, value as seconds from events)"


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select(i.alias("seq"), F.col("event_type").alias("name"), F.when(i % 9 == 0, "timeout").when(i % 9 == 1, "bad_limit").alias("error"), F.col("value").alias("seconds"))


@query(f"with {_CALLS} select name, count(*) as calls, count(error) as errors, arg_max(seconds, seq) as last_seconds from c group by name")
def tool_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.tool_metrics(_calls(spark, sf))


@query(f"with {_CALLS} select error, count(*) as n from c where error is not null group by error")
def tool_errors(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.error_counts(_calls(spark, sf))


@query(f"with {EV} select count(*) as scored, count(*) filter (where ai_score >= 1 and ai_score <> 0) as above_threshold from ev")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.score_summary(items_ev(spark, sf), 1.0)


@query(f"with {EV}, {FOOD} select coalesce(sum(len(evidence_urls)), 0)::bigint as citations from food")
def citation_count(spark: SparkSession, sf: str) -> DataFrame:
    return analysis.citation_count(food_ev(spark, sf).withColumnRenamed("evidence_urls", "sources"))


@query(
    """select event_type as source_type, case when user_id % 5 = 0 then 'r/s' || (user_id % 7) when user_id % 5 = 1 then 'feed ' || (user_id % 3) when user_id % 5 = 2 then 'daily/repo' when user_id % 5 = 3 then 'author ' || (user_id % 2) else 'unknown' end as sub_source, count(*) as n
from events group by all"""
)
def type_counts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    meta = F.when(u % 5 == 0, F.create_map(F.lit("subreddit"), F.concat(F.lit("s"), u % 7))).when(u % 5 == 1, F.create_map(F.lit("feed_name"), F.concat(F.lit("feed "), u % 3))).when(u % 5 == 2, F.create_map(F.lit("period"), F.lit("daily"), F.lit("repo"), F.lit("repo"))).otherwise(F.create_map(F.lit("channel"), F.lit("")))
    author = F.when(u % 5 == 3, F.concat(F.lit("author "), u % 2)).otherwise("")
    return digest.type_counts(table(spark, sf, "events").select(F.col("event_type").alias("source_type"), meta.alias("metadata"), author.alias("author")))


@query("select 'p' || (user_id % 3) as provider, event_type as model, greatest(0, sum(event_id % 1000) - sum(event_id % 700))::bigint as input_tokens, greatest(0, sum(event_id % 300) - sum(event_id % 400))::bigint as output_tokens from events group by all")
def usage_since(spark: SparkSession, sf: str) -> DataFrame:
    i, model = F.col("event_id"), [F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), F.col("event_type").alias("model")]
    total = lambda a, b: table(spark, sf, "events").groupBy(*model).agg(F.sum(i % a).alias("input_tokens"), F.sum(i % b).alias("output_tokens"))
    return metrics.usage_delta(total(1000, 300), total(700, 400))


# as a formatter rounds the binary value of a double
_FIX = lambda x, n: "format('{:." + str(n) + f"f}}', ({x})::double)"


@query(
    f"""with {catalogue.RANK} select seq, 'profile=daily; importance=' || {_FIX('importance', 2)} || '; profile_relevance=' || {_FIX('relevance', 2)} || '; opportunity=' || {_FIX('opportunity', 2)} || '; evidence_quality=' || {_FIX('evidence_quality', 2)}
  || '; topic_multiplier=' || {_FIX('1 + w::double', 4)} || '; market_multiplier=' || {_FIX('(1 + boost::double) * (1 - pen::double)', 4)} || '; evidence_tier=' || effective_tier || '; final_rank=' || {_FIX('final_rank', 4)} as reason from ranked"""
)
def selection_reason(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.ranked(spark, sf).select("seq", ranking.reason(catalogue.PROFILE, "daily").alias("reason"))


# --- sources


@query(
    """with s as (select p_partkey, lower(p_brand) as k, string_split(lower(p_type), ' ') as tags, string_split_regex(lower(p_name), '\\s+') as words from part),
r as (select p_partkey, (case when contains('promo steel brand#11', k) then 1 else 0 end) + 0.5::double * len(list_filter(tags, lambda x: x = 'plated' or contains('promo steel brand#11', x))) + 0.3::double * ((case when list_contains(words, 'promo') then 1 else 0 end) + (case when list_contains(words, 'steel') then 1 else 0 end) + (case when list_contains(words, 'brand#11') then 1 else 0 end)) as raw from s)
select 'part:' || p_partkey as source_key, round(least(raw / 3, 1), 9) as score from r where raw / 3 >= 0.1"""
)
def source_match(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("part:"), "p_partkey").alias("source_key"), F.array("p_brand").alias("keywords"), F.split("p_type", " ").alias("tags"), F.col("p_name").alias("description"))
    return interests.source_matches(s, "Promo steel Brand#11", {"plated": ["steel"]}).select("source_key", F.round("score", 9).alias("score"))


@query("select distinct user_id as source_id, user_id in (select c_custkey from customer) as known from events")
def asked_sources(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "events").select(F.col("user_id").alias("source_id")).distinct()
    known, unknown = readers.unknown_sources(asked, table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id")))
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@query("select c_custkey, case c_custkey % 4 when 0 then 'rss:https://f.example/' || c_custkey when 1 then 'reddit:r' || c_nationkey when 2 then 'github_repo:o' || c_nationkey || '/p' else 'telegram:ch' || c_nationkey end as source_key from customer")
def source_keys(spark: SparkSession, sf: str) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    of = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    kind = F.when(c % 4 == 0, "rss").when(c % 4 == 1, "reddit_subreddit").when(c % 4 == 2, "github_repo").otherwise("telegram")
    config = F.when(c % 4 == 0, of("url", F.concat(F.lit("https://f.example/"), c))).when(c % 4 == 1, of("subreddit", F.concat(F.lit("r"), n))).when(c % 4 == 2, of("owner", F.concat(F.lit("o"), n), "repo", "p")).otherwise(of("channel", F.concat(F.lit("ch"), n)))
    return table(spark, sf, "customer").select("c_custkey", service.source_key(kind, config).alias("source_key"))


@query("select c_custkey, case c_custkey % 5 when 0 then 'custom' when 1 then 'metadata_only' when 2 then 'paywall' when 3 then 'login_required' else 'direct_metadata' end as access_mode from customer")
def access_modes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    of = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    options = F.when(c % 5 == 0, of("access_mode", "custom")).when(c % 5 == 1, of("retention_mode", "metadata_only")).when(c % 5 == 2, of("trial_note", "需付费")).when(c % 5 == 3, of("trial_note", "需要登录")).otherwise(of("access_mode", ""))
    return table(spark, sf, "customer").select("c_custkey", service.access_mode(options).alias("access_mode"))


@query("select event_id, case when event_id % 3 = 0 then least(greatest(value, 0), 60) else least(30, 0.5::double * pow(2, event_id % 9)) end as seconds from events")
def retry_delays(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", text.retry_delay(i % 9 + 1, F.when(i % 3 == 0, F.col("value"))).alias("seconds"))


# addresses from the digits of each page's hash: two of four parts, one of eight groups, one of a host's name
_HOPS = """hops as (select page_id, h, list_transform([1, 3, 5, 7], lambda i: ('0x' || h[i:i + 1])::int) as a, [10, 100, 127, 169, 172, 192, 198, 203, 224, 255][1 + ('0x' || h[9:10])::int % 10] as first,
  list_transform([11, 13, 15], lambda i: ('0x' || h[i:i + 1])::int) as b, ['fe80', 'fc00', '2001', '2002', '2a00', '2606', 'ff02', '0064'][1 + ('0x' || h[17:18])::int % 8] || ':' || h[19:22] || ':0:0:0:0:' || h[23:26] || ':' || h[27:30] as six from (select page_id, md5(url) as h from pages))"""


def _hops(spark: SparkSession, sf: str) -> DataFrame:
    h = F.md5(F.col("url").cast("binary"))
    byte = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    of = lambda xs, i: F.get(F.array(*map(F.lit, xs)), byte(i) % len(xs))
    four = lambda first, at: F.concat_ws(".", first, *(byte(i).cast("string") for i in at))
    six = F.concat_ws(":", of(("fe80", "fc00", "2001", "2002", "2a00", "2606", "ff02", "0064"), 17), F.substring(h, 19, 4), F.lit("0:0:0:0"), F.substring(h, 23, 4), F.substring(h, 27, 4))
    return table(spark, sf, "pages").select("page_id", F.array("url", *(F.concat(F.lit("http://"), x, F.lit(":8080/a?b")) for x in (four(byte(1).cast("string"), (3, 5, 7)), four(of((10, 100, 127, 169, 172, 192, 198, 203, 224, 255), 9).cast("string"), (11, 13, 15)), F.concat(F.lit("["), six, F.lit("]"))))).alias("hops"))


_NOT4 = "({0} in (0, 10, 127) or {0} >= 224 or {0} = 100 and {1} between 64 and 127 or {0} = 169 and {1} = 254 or {0} = 172 and {1} between 16 and 31 or {0} = 192 and {1} = 168 or {0} = 192 and {1} = 0 and {2} in (0, 2) or {0} = 198 and ({1} in (18, 19) or {1} = 51 and {2} = 100) or {0} = 203 and {1} = 0 and {2} = 113)"


@query(
    f"""with {_HOPS} select page_id, not {_NOT4.format('a[1]', 'a[2]', 'a[3]')} as plain, not {_NOT4.format('first', 'b[1]', 'b[2]')} as dealt,
  not (h[17:18] is null or six[1:4] in ('fe80', 'fc00', '2002', 'ff02') or six[1:4] = '2001' and (six[6:9] < '0200' and not six[6:9] between '0020' and '003f' and six[6:9] <> '0003' or six[6:9] = '0db8') or six[1:4] = '0064' and six[6:9] = 'ff9b' and false) as groups,
  plain and dealt and groups as safe from hops"""
)
def url_safety(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda i: urls.is_safe(F.get("hops", F.lit(i)))
    return _hops(spark, sf).select("page_id", one(1).alias("plain"), one(2).alias("dealt"), one(3).alias("groups"), urls.all_safe(F.col("hops")).alias("safe"))


#: Rules of every kind for the hosts that this query makes of the pages' hosts.
_RULES = [("com", "plain"), ("uk", "plain"), ("co.uk", "plain"), ("jp", "plain"), ("kawasaki.jp", "wildcard"), ("city.kawasaki.jp", "exception")]


@query(
    """with r(suffix, kind) as (values ('com', 'plain'), ('uk', 'plain'), ('co.uk', 'plain'), ('jp', 'plain'), ('kawasaki.jp', 'wildcard'), ('city.kawasaki.jp', 'exception')),
h as (select page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), 'example[.](com|org|net)$', case regexp_extract(url, '^https?://[^/]*/(..)/', 1) when 'en' then 'co.uk' when 'de' then 'kawasaki.jp' when 'fr' then 'city.kawasaki.jp' when 'es' then 'test' else 'com' end) as host from pages),
l as (select page_id, host, string_split(host, '.') as l from h),
m as (select page_id, kind, len(string_split(suffix, '.')) + case kind when 'wildcard' then 1 when 'exception' then -1 else 0 end as n from l join r on host = suffix or ends_with(host, '.' || suffix)),
b as (select page_id, coalesce(max(n) filter (where kind = 'exception'), max(n) filter (where kind <> 'exception')) as n from (select m.* from m join l using (page_id) where m.n <= len(l)) group by page_id)
select page_id, host, case when n is null then '' else array_to_string(l[len(l) - n + 1:], '.') end as suffix, case when n is null or len(l) <= n then '' else array_to_string(l[len(l) - n:], '.') end as domain from l left join b using (page_id)"""
)
def registrable_domains(spark: SparkSession, sf: str) -> DataFrame:
    lang, url = F.regexp_extract("url", "^https?://[^/]*/(..)/", 1), F.col("url")
    end = F.when(lang == "en", "co.uk").when(lang == "de", "kawasaki.jp").when(lang == "fr", "city.kawasaki.jp").when(lang == "es", "test").otherwise("com")
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(urls.host(url), F.lit(r"example\.(com|org|net)$"), end).alias("host"))
    return p.join(domains.domains(p, spark.createDataFrame(_RULES, domains.RULES)), "host").select("page_id", "host", "suffix", "domain")


#: Pages as fetched responses.  A page with a query is a redirect to the first link of its menu or, where its host goes on, to the next page of the host; others name their address without a query as the canonical one.
_AGGREGATORS = ("m", "www", "blog")


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("host", urls.host(F.col("url")))
    following = F.lead("url").over(windows.Window.partitionBy("host").orderBy("url"))
    https = lambda u: F.regexp_replace(u, "^http:", "https:")
    asked = F.contains("url", F.lit("?"))
    link = F.when(F.contains("url", F.lit("page=")), F.regexp_extract("html", '<nav><ul><li><a href="([^"]*)"', 1)).otherwise(https(following))
    canonical = F.concat(F.lit("<html><head><link href='"), F.concat(F.lit("//pub-"), F.col("host"), F.lit("/"), F.regexp_extract("url", "([^/?#]*)([?#].*)?$", 1)), F.lit("' rel='alternate canonical'></head>"))
    return p.select(https(F.col("url")).alias("url"), F.when(asked, 302).otherwise(200).alias("status"), F.when(asked, link).alias("location"), canonical.alias("html"))


@query(
    """with recursive p as (select page_id, regexp_replace(url, '^http:', 'https:') as url, html, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, contains(url, '?') as asked, contains(url, 'page=') as paged,
  lead(regexp_replace(url, '^http:', 'https:')) over (partition by regexp_extract(url, '^https?://([^/?#]*)', 1) order by url) as following from pages),
agg as (select distinct host from p where string_split(host, '.')[1] in ('m', 'www', 'blog')),
q as (select *, host in (select host from agg) as through, case when not asked then null when paged then 'https://' || host || regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1) else following end as link from p),
r as (select url as start, url, 0 as n, case when asked then null else 'https://pub-' || host || '/' || regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) end as out, case when asked and link is null then 'redirect_without_location' end as error, link from q where through
  union all select r.start, q.url, r.n + 1, case when not q.asked then 'https://pub-' || q.host || '/' || regexp_extract(q.url, '([^/?#]*)([?#].*)?$', 1) end, case when q.url is null then 'request_failed' when q.asked and q.link is null then 'redirect_without_location' end, q.link
  from r left join q on q.url = r.link where r.out is null and r.error is null and r.n <= 5),
e as (select start, arg_max(out, n) as out, arg_max(coalesce(error, ''), n) as error, max(n) as n, arg_max(out is null, n) as open from r group by start)
select page_id, case when through and n <= 5 and error = '' and not open then out end as original_url, case when not through then 'unsupported_aggregator' when n > 5 then 'too_many_redirects' when error <> '' then error end as original_error,
  case when through and n <= 5 and error = '' and not open then 'resolved' when contains(q.url, '?') then 'fallback' else 'failed' end as original_status from q left join e on e.start = q.url"""
)
def original_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("host", urls.host(F.col("url")))
    # the queries' host names are a fixed list of the tables' makers, a few of each table
    through = tuple(sorted(r[0] for r in pages.where(F.split("host", r"\.")[0].isin(*_AGGREGATORS)).select("host").distinct().collect()))
    items = pages.select("page_id", F.regexp_replace("url", "^http:", "https:").alias("url"), F.when(F.contains("url", F.lit("?")), F.col("host")).alias("publisher"))
    done = original.resolved_items(items, _responses(spark, sf), spark.createDataFrame(_RULES, domains.RULES), aggregators=through)
    return done.select("page_id", "original_url", "original_error", "original_status")


# --- answers of services as items


@query("select 'gdelt:article:' || left(sha256(strftime(ts, '%Y%m%dT%H%M%SZ') || '::https://n.example/' || event_id), 16) as id, event_type as title, 'https://n.example/' || event_id as url, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at from events where date_trunc('second', ts) between timestamp '2024-01-03' and timestamp '2024-01-20'")
def monitored_news(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.concat(F.lit("https://n.example/"), "event_id").alias("url"), F.col("event_type").alias("title"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.lit("n.example").alias("domain"), F.lit("en").alias("language"))
    return adapters.monitored_news(rows, "2024-01-03 00:00:00", "2024-01-20 00:00:00").select("id", "title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    """with c as (select *, conv_id || '-' || turn as tid from conversations where coalesce(text, '') <> ''), d as (select distinct tid, role, text from c)
select 'twitter:tweet:' || tid as id, '@' || role || ': ' || trim(replace(left(text, 50), chr(10), ' '), ' ') || case when length(text) > 50 then '...' else '' end as title, 'https://twitter.com/' || role || '/status/' || tid as url from d"""
)
def tweets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("tweet_id"), F.col("role").alias("screen_name"), F.lit(None).cast("string").alias("name"), "text", F.lit(None).cast("string").alias("url"), F.lit("2024-01-05").cast("timestamp").alias("created_at"), F.lit(1).alias("favorite_count"), F.lit(0).alias("reply_count"))
    return adapters.tweets(rows, "2024-01-03 00:00:00").select("id", "title", "url")


@query(
    """with r as (select conv_id, turn, role, trim(text, ' ') as t, length(text) % 50 as likes, turn % 7 as replies from conversations where turn <> conv_id and role <> 'system' and trim(text, ' ') <> '' and length(text) % 50 >= 5),
n as (select *, row_number() over (partition by conv_id order by likes * 2 + replies desc, turn) as n from r)
select conv_id as tweet_id, string_agg('[@' || role || ' | ' || likes || ' | ' || replies || '] ' || left(t, 280), chr(10) order by n) as replies from n where n <= 3 group by conv_id"""
)
def top_replies(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("tweet_id"), F.lit("@System").alias("author"), F.col("turn").alias("reply_id"), F.col("role").alias("handle"), "text", (F.length("text") % 50).alias("likes"), (F.col("turn") % 7).alias("replies"))
    return adapters.top_replies(rows, 3, 5).select("tweet_id", F.array_join("replies", "\n").alias("replies"))


@query(
    """with n as (select user_id, event_type, min(event_id) as event_id from events where ts > timestamp '2024-01-03' group by all)
select 'openbb:news:' || left(sha256('https://n.example/' || user_id || '/' || event_type), 16) as id, 'Title ' || event_id as title, 'S' || (event_id % 5) as author, case when event_id % 5 = event_id % 3 then 'S' || (event_id % 5) else 'S' || (event_id % 5) || ',S' || (event_id % 3) end as symbols from n"""
)
def company_news(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(i.alias("seq"), F.lit("w").alias("watchlist"), F.concat_ws("/", F.lit("https://n.example"), "user_id", "event_type").alias("url"), F.concat(F.lit(" Title "), i).alias("title"), F.lit("").alias("body"), F.lit(None).cast("string").alias("author"), F.concat(F.lit("s"), i % 5, F.lit(" , ,S"), i % 3).alias("symbols"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("date"))
    return adapters.company_news(rows, "2024-01-03 00:00:00").select("id", "title", "author", F.array_join("symbols", ",").alias("symbols"))


# --- analysis, ledgers, text


@query("select doc_id, 'Title: ' || source || case when trim(text, ' ') <> '' then chr(10) || 'Content: ' || substring(trim(text, ' '), 1, 1000) else '' end || chr(10) || 'Comments: note ' || doc_id as prompt from documents")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.concat(F.coalesce("text", F.lit("")), F.lit(analysis.MARK + " note "), "doc_id").alias("content"))
    return d.select("doc_id", analysis.prompt().alias("prompt"))


@query(
    f"""with {EV}, {FOOD}, a as (select *, case when seq % 13 = 0 then 'gone' when seq % 7 = 0 and importance > 9.9 then 'broken' when seq % 7 = 0 then 'irrelevant' when importance > 9.9 or seq % 29 = 0 then 'broken' else 'good' end as kind from food)
select id, case when kind in ('good', 'gone', 'broken') then importance else 0.0::double end as importance, case kind when 'good' then 'p,c' else '' end as tags, case when kind = 'good' then coalesce(event_key, 'url:' || sha256(url)) end as event_key, case kind when 'good' then risk_level when 'irrelevant' then 'none' end as risk_level,
  case kind when 'good' then 'summary' else 'title ' || id end as ai_summary, case kind when 'good' then importance else 0.0::double end as ai_score, kind in ('gone', 'broken') as isolated, case kind when 'good' then true when 'irrelevant' then false end as relevant from a"""
)
def analysis_answers(spark: SparkSession, sf: str) -> DataFrame:
    f = food_ev(spark, sf)
    s, many = F.col("seq"), F.col("importance") > 9.9
    items = f.select("id", "url", F.concat(F.lit("title "), "id").alias("title"), "category", "importance", "relevance", "opportunity", "evidence_quality", F.lit(False).alias("isolated"))
    word = lambda c, x: F.lit(x).alias(c)
    # a score out of range breaks any answer, a missing summary only a relevant one
    answer = F.to_json(F.struct((s % 7 != 0).alias("relevant"), "category", F.when(many, 99.0).otherwise(F.col("importance")).alias("importance"), *(F.lit(n).alias(c) for c, n in (("relevance", 1.0), ("opportunity", 2.0), ("evidence_quality", 3.0))), "risk_level", "event_key", word("title_zh", "t"), F.when(s % 29 != 0, "summary").alias("summary"), F.array(F.lit("p")).alias("product_tags"), F.array(F.lit("c"), F.lit("p")).alias("company_tags")))
    answers = f.where("has_food").select("id", answer.alias("answer"), F.lit(None).cast("string").alias("error"))
    return analysis.analysed(items, answers).select("id", "importance", F.array_join("ai_tags", ",").alias("tags"), "event_key", "risk_level", "ai_summary", "ai_score", "isolated", "relevant")


@query("select distinct p_partkey as id, case lower(w) when 'anodized' then 'finish' when 'plated' then 'finish' when 'promo' then 'sale' else w end as tag from (select p_partkey, unnest(string_split(p_type, ' ')) as w from part)")
def tag_aliases(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split("p_type", " ")).alias("tag"))
    return analysis.tag_aliases(tags, spark.createDataFrame([("Anodized", "finish"), ("plated", "finish"), ("PROMO", "sale")], "alias string, tag string"))


@query("select distinct item_id, stage from (select doc_id as item_id, 'score' as stage from labels where toxic = 1 union select doc_id, 'score' from documents where length(text) < 200 union select doc_id, 'enrich' from documents where length(text) < 200)")
def isolation_list(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"), F.lit("score").alias("stage")).distinct()
    short = table(spark, sf, "documents").where(F.length("text") < 200)
    new = short.select(F.col("doc_id").alias("item_id"), F.explode(F.array(F.lit("score"), F.lit("enrich"))).alias("stage"))
    return memory.isolated_once(known, new)


@query("select l_orderkey as id, l_partkey as url from lineitem l where exists (select 1 from lineitem r where r.l_orderkey = l.l_orderkey and r.l_partkey = l.l_partkey and r.l_returnflag = 'R')")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    pair = lambda d: d.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("url"))
    return analysis.cited(pair(line), pair(line.where("l_returnflag = 'R'")))


@query("select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d') as day from events")
def business_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.business_date(F.col("ts"), "Asia/Shanghai").cast("string").alias("day"))


@query("select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as body from pages")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.stripped(F.col("html")).alias("body"))


@query("select doc_id, regexp_replace(text, '([\\\\`*_\\[\\]<>|])', '\\\\\\1', 'g') as escaped from documents")
def markdown_safe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.markdown_escaped(F.col("text")).alias("escaped"))


# --- attempts and constraints


def _ways(spark: SparkSession, sf: str, *ways: tuple) -> DataFrame:
    """Attempts made from pages: for each way a kind, a status and how much it found."""
    each = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), status.alias("status"), found.alias("found")) for i, (k, status, found) in enumerate(ways)))
    return table(spark, sf, "pages").select("page_id", F.inline(each))


def _long() -> Column:
    return F.length(F.coalesce("html", F.lit("")))


def _times(mark: str) -> Column:
    return F.regexp_count(F.coalesce("html", F.lit("")), F.lit(mark))


@query(
    """with p as (select page_id, coalesce(html, '') as h from pages), n as (select page_id, greatest(len(string_split(h, '<p>')) - 1 - 6, 0) as posts, length(h) as listed, len(string_split(h, '<li')) - 1 as fed, length(h) > 2115 as blocked, length(h) < 1582 as broken from p)
select page_id, case when posts > 0 then 'page' when blocked then 'feed' else 'json' end as kind, (case when posts > 0 then posts when blocked then fed when broken then 0 else listed end)::integer as found from n"""
)
def listing_reads(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.lit(200)
    a = _ways(spark, sf, ("page", ok, F.greatest(_times("<p>") - 6, F.lit(0))), ("json", F.when(_long() > 2115, 403).when(_long() < 1582, 500).otherwise(200), _long()), ("feed", ok, _times("<li")))
    s = attempts.settled(a, "page_id", "place", attempts.listing_open(F.col("kind"), F.col("status"), F.col("found")))
    return s.select("page_id", "kind", F.when(F.col("status") < 400, F.col("found")).otherwise(0).alias("found"))


@query(
    """with p as (select page_id, coalesce(html, '') as h from pages), s as (select page_id, case when length(h) > 1582 then 500 else 200 end as a, case when len(string_split(h, '<p>')) - 1 > 6 then 429 else 200 end as b, case when length(h) > 3754 then null else 200 end as c from p)
select page_id, case when a < 400 then 'first' when b < 400 then 'second' else 'third' end as kind, case when a < 400 then a when b < 400 then b else c end as status, a >= 400 and b >= 400 and c is null as failed from s"""
)
def mirror_reads(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("int")
    a = _ways(spark, sf, ("first", F.when(_long() > 1582, 500).otherwise(200), none), ("second", F.when(_times("<p>") > 6, 429).otherwise(200), none), ("third", F.when(_long() <= 3754, 200), none))
    return attempts.settled(a, "page_id", "place", attempts.mirror_failed(F.col("status"))).select("page_id", "kind", "status", "failed")


_SETTINGS = (*constraints.ANALYSIS, constraints.Rule("$.max_attempts", "number"), constraints.Rule("$.groups[].tier", "required"), constraints.Rule("$.groups[].tier", "oneof", ("STANDARD", "PROMO", "ECONOMY")), *constraints.DIGEST)


@query(
    """with c as (select p_partkey as id, p_size as s, p_brand like '%1' as w, split_part(p_type, ' ', 1) as tier from part), g as (select * from c where s <> 50)
select id, '$' as path, 'json' as rule from c where s = 50
union all select id, '$.concurrency', 'le' from g where s + 20 > 64
union all select id, '$.timeout_seconds', 'gt' from g where s <= 1
union all select id, '$.max_attempts', 'number' from g where w
union all select id, '$.max_attempts', 'ge' from g where not w and s % 13 < 1
union all select id, '$.max_attempts', 'le' from g where not w and s % 13 > 10
union all select id, '$.max_items', 'gt' from g where s - 5 <= 0
union all select id, '$.groups[0].limit', 'gt' from g where s - 10 <= 0
union all select id, '$.groups[0].tier', 'oneof' from g where tier not in ('STANDARD', 'PROMO', 'ECONOMY')
union all select id, '$.groups[1].' || unnest(['limit', 'tier']), 'required' from g"""
)
def config_violations(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    tries = F.when(F.col("p_brand").endswith("1"), F.lit('"many"')).otherwise((s % 13).cast("string"))
    parts = ('{"concurrency":', s + 20, ',"timeout_seconds":', s - 1, ',"max_attempts":', tries, ',"max_items":', s - 5, ',"groups":[{"limit":', s - 10, ',"tier":"', F.get(F.split("p_type", " "), F.lit(0)), '"},{"limit":null}]}', F.when(s == 50, "}").otherwise(""))
    config = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return constraints.violations(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), config.alias("config")), _SETTINGS).select("id", "path", "rule")
