from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import pytest
from brieflake.functions import domains, text, urls
from brieflake.functions.similarity import event_key_parts, loose_json, text_ratio
from brieflake.operators import clusters, digest, evidence, memory, merge, metrics, ranking, rotation, windows
from brieflake.ship import checkpoint_dir, ship
from pyspark.sql import functions as F


def keys(spark, *addresses):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(addresses)], "i int, url string")
    return df.select(F.count_distinct(urls.dedup_key(F.col("url")))).first()[0]


def test_url_keys(spark):
    assert keys(spark, "https://EXAMPLE.com:443/story/#first", "https://example.com/story#second") == 1
    assert keys(spark, "https://example.com/a", "http://example.com/a", "https://example.com:8443/a") == 3
    assert keys(spark, "https://e.com/s?page=1&sort=new", "https://e.com/s?page=2&sort=new", "https://e.com/s?sort=new&page=1") == 3
    assert keys(spark, "https://e.com/s?id=42&utm_source=x&fbclid=1&GCLID=2", "https://e.com/s?id=42", "https://e.com/s?id=42&source=newsletter") == 2


def test_event_url_key_sorts_parameters(spark):
    df = spark.createDataFrame([("https://u:p@E.com/s/?b=2&a=1&utm_x=3#f",), ("https://e.com/s?a=1&b=2",)], "url string")
    a, b = [r[0] for r in df.select(urls.event_url_key(F.col("url"))).collect()]
    assert a == b and a.startswith("url:")


def test_url_predicates(spark):
    rows = [("https://www.bbc.co.uk/x", True), ("https://localhost/x", False), ("https://10.0.0.1/x", False), ("https://u:p@a.com/", False), ("ftp://a.com/", False), ("https://news.google.com/x", False), ("https://co.uk/", False), (None, False)]
    df = spark.createDataFrame(rows, "url string, want boolean").withColumn("host", urls.host(F.col("url")))
    known = df.join(domains.domains(df, domains.suffix_rules(spark)), "host", "left")
    assert known.where(urls.is_attributable(F.col("url"), F.col("domain")) != F.col("want")).count() == 0


ITEM = "seq long, id string, source_type string, title string, url string, content string, metadata map<string,string>"


def test_url_merge_keeps_the_richest(spark):
    df = spark.createDataFrame([(0, "short", "rss", "t", "https://e.com/s", "short", {"score": "12"}), (1, "rich", "reddit", "t", "https://e.com/s/", "the richer primary content", {"comments": "4"})], ITEM)
    r = merge.merge_by_url(df).collect()
    assert len(r) == 1 and r[0].id == "rich" and r[0].content == "the richer primary content\n\n--- From rss ---\nshort"
    assert r[0].metadata == {"comments": "4", "score": "12"} and r[0].merged_sources == ["rss", "reddit"]


def test_url_merge_of_one_and_of_none(spark):
    one = spark.createDataFrame([(0, "a", "rss", "t", "https://e.com/s", None, None)], ITEM)
    r = merge.merge_by_url(one).first()
    assert r.merged_sources is None and r.content == ""
    assert merge.merge_by_url(one.where("false")).count() == 0


def test_balanced_digest_golden(spark):
    rows = [("ai-low", 7.0, "ai"), ("finance-low", 6.0, "finance"), ("other-high", 9.5, "world"), ("ai-high", 9.0, "ml"), ("finance-high", 8.5, "finance"), ("ai-mid", 8.0, "ai"), ("other-low", 5.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, id string, ai_score double, category string")
    d = digest.balanced_digest(df, {"ai": (["ai", "ml"], 2), "finance": (["finance"], 1)}, 1)
    assert [r.id for r in d.orderBy("place").collect()] == ["other-high", "ai-high", "finance-high", "ai-mid"]
    assert {r.grp: r.n for r in digest.group_counts(d).collect()} == {"default": 1, "ai": 2, "finance": 1}
    assert [r.id for r in digest.balanced_digest(df, {"ai": (["ai", "ml"], 2)}, 1, cap=1).collect()] == ["other-high"]


def test_first_group_wins(spark):
    df = spark.createDataFrame([("x",)], "category string")
    assert digest.category_group(df, {"a": ["x"], "b": ["x"]}).first().grp == "a"


def test_windows():
    assert windows.resolve_window("2026-07-24T00:00:00+00:00", hours=24)[0] == "2026-07-23T00:00:00+00:00"
    for bad in ({"hours": 721}, {"hours": 0}, {"since": "2026-07-01T00:00:00+00:00"}, {"since": "2026-07-01T00:00:00", "until": "2026-07-02T00:00:00"}):
        with pytest.raises(ValueError):
            windows.resolve_window("2026-07-24T00:00:00+00:00", **bad)


FOOD = "seq long, category string, markets array<string>, importance double, relevance double, opportunity double, evidence_quality double, risk_level string, source_id string, effective_tier int, published_at timestamp, url string"


def food(seq, category="company_updates", markets=("US",), score=8.0, risk="none", source="s"):
    return (seq, category, list(markets), score, score, score, score, risk, source, 1, None, f"https://e.com/{seq}")


def test_rank_golden(spark):
    p = ranking.Profile(topic_weights={c: 0.2 if c == "company_updates" else 0.8 / 7 for c in ("company_updates", "a", "b", "c", "d", "e", "f", "g")})
    df = spark.createDataFrame([food(0, markets=["IN"]), food(1, markets=["US", "CN", "JP", "KR", "IN"]), food(2)], FOOD)
    assert [round(r.final_rank, 6) for r in ranking.ranked(df, p).orderBy("seq").collect()] == [4.8, 8.64, 9.6]


def test_source_cap_and_exploration(spark):
    p = ranking.Profile(max_items=6, max_per_source=2, exploration_slots=1, commercial_min_ratio=0.5)
    df = spark.createDataFrame([food(i, score=9 - i * 0.1, source=f"s{i // 4}") for i in range(12)] + [food(20, "food_safety_recalls", score=1.0, source="z"), food(21, "food_safety_recalls", score=0.9, source="z")], FOOD)
    got = ranking.explored(ranking.ranked(df, p), p).collect()
    assert len(got) == 6 and {r.seq for r in got if r.exploration} == {20}
    assert max(sum(1 for r in got if r.source_id == s) for s in {r.source_id for r in got}) <= 2
    pool = ranking.ranked(df, p)
    sel = ranking.source_capped(pool.where("category = 'food_safety_recalls'"), 2, 2).drop("in_source")
    assert [r.commercial for r in ranking.commercial_mix(sel, pool, p).collect()].count(True) == 1


def test_profile_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        ranking.Profile(topic_weights={"a": 0.5})


EV = "has_food boolean, isolated boolean, category string, official_urls array<string>, relevant boolean, evidence_tier int, original_url string, evidence_urls array<string>, publisher string, linked_tier int"


def decide(spark, mode="loose", fallback=True, **kw):
    base = dict(has_food=True, isolated=False, category="company_updates", official_urls=[], relevant=True, evidence_tier=3, original_url=None, evidence_urls=[], publisher=None, linked_tier=None) | kw
    r = evidence.decide(spark.createDataFrame([tuple(base[c.split()[0]] for c in EV.split(", "))], EV), mode, fallback).first()
    return r.accepted, r.reason, r.effective_tier


def test_evidence_rules(spark):
    assert decide(spark, has_food=False) == (False, "missing food analysis", 4)
    assert decide(spark, isolated=True)[1] == "isolated analysis"
    assert decide(spark, category="food_safety_recalls")[1] == "official evidence required"
    assert decide(spark, category="food_safety_recalls", official_urls=["https://x.gov/a"], evidence_tier=1)[0]
    assert decide(spark, relevant=False, evidence_tier=1)[1] == "not food-industry relevant"
    assert decide(spark, relevant=None, evidence_tier=2) == (True, "accepted authoritative evidence", 2)
    assert decide(spark, original_url="https://a.com/x", evidence_urls=["https://a.com/x"])[1] == "accepted single attributable source"
    assert decide(spark, evidence_urls=["https://a.com/x", "https://b.com/x"])[1] == "accepted corroborated discovery"
    assert decide(spark, evidence_urls=["https://x.a.com/", "https://y.a.com/"])[1] == "discovery publisher could not be identified"
    google = ["https://news.google.com/x"]
    assert decide(spark, evidence_urls=google, publisher="P")[1] == "accepted attributable aggregator fallback"
    assert decide(spark, fallback=False, evidence_urls=google, publisher="P")[1] == "discovery has no usable evidence URL"
    assert decide(spark, "strict", original_url="https://a.com/x")[0] and decide(spark, "strict")[1] == "discovery requires original source or two domains"
    assert decide(spark, evidence_tier=4, original_url="https://a.com", linked_tier=2) == (True, "accepted linked weak signal", 2)
    assert not decide(spark, evidence_tier=4, original_url="https://a.com")[0]


def test_penalty_once_and_not_below_zero(spark):
    df = spark.createDataFrame([(5.0, True, True, True), (1.0, True, True, False), (5.0, False, True, True), (5.0, True, False, False)], "q double, a boolean, s boolean, p boolean")
    assert [r[0] for r in df.select(evidence.penalised(F.col("q"), F.col("a"), F.col("s"), F.col("p"))).collect()] == [3.0, 0.0, 5.0, 5.0]


def metric(day, status="success", provenance="scheduled", source="s", unique=1, cost=0.5, **kw):
    return (source, day, provenance, status, kw.get("mode", "open"), 1.0, 10, kw.get("admitted", 4), 3, 0, unique, cost)


METRIC = "source_id string, day date, provenance string, fetch_status string, access_mode string, parse_rate double, candidate_count long, admitted_count long, commercial_count long, duplicate_count long, unique_count long, cost double"


def trial(spark, rows):
    return metrics.trial_summary(spark.createDataFrame(rows, METRIC)).first()


def test_trial_summary(spark):
    days = [date(2026, 7, 1) + timedelta(i) for i in range(15)]
    r = trial(spark, [metric(d, "failure" if i == 0 else "success") for i, d in enumerate(days[:14])])
    assert (r.trial_status, r.recommended_tier, round(r.success_rate, 4), r.commercial_share) == ("complete", "core", 0.9286, 0.75)
    r = trial(spark, [metric(d) for d in days[:7] + days[8:]])
    assert (r.consecutive_days, r.trial_status, r.recommended_tier) == (7, "provisional", "pending")
    r = trial(spark, [metric(d, "skipped_rotation" if i % 2 else "success") for i, d in enumerate(days[:14])])
    assert (r.trial_status, r.run_count) == ("complete", 7)
    assert trial(spark, [metric(d, cost=None) for d in days[:3]]).estimated_cost is None
    assert trial(spark, [metric(d, mode="robots_denied") for d in days[:14]]).recommended_tier == "disable"
    assert trial(spark, [metric(days[0], provenance="manual")]).run_count == 1


def test_token_cost(spark):
    u = "provider string, model string, input_tokens long, output_tokens long"
    p = spark.createDataFrame([("a", "m", 2.0, 4.0)], "provider string, model string, in_price double, out_price double")
    r = metrics.token_cost(spark.createDataFrame([("a", "m", 120, 60)], u), p).first()
    assert r.estimated_cost == 0.00048 and r.unpriced == ""
    r = metrics.token_cost(spark.createDataFrame([("a", "m", 120, 60), ("b", "m", 1, 0)], u), p).first()
    assert r.estimated_cost is None and r.unpriced == "b/m"
    assert metrics.token_cost(spark.createDataFrame([], u), p).first().estimated_cost == 0.0
    d = metrics.usage_delta(spark.createDataFrame([("a", "m", 5, 1)], u), spark.createDataFrame([("a", "m", 2, 3)], u)).first()
    assert (d.input_tokens, d.output_tokens) == (3, 0)


def test_fetch_report_states(spark):
    s = "status string, item_count long"
    status = lambda *x: metrics.fetch_report(spark.createDataFrame([(v, 1) for v in x], s)).first().status
    assert [status(), status("failure"), status("failure", "empty"), status("empty", "success")] == ["not_attempted", "failure", "partial_failure", "success"]


def test_rotation(spark):
    import hashlib

    rows = [(f"id{i}", ["core", "extended", "discovery"][i % 3], i != 4) for i in range(30)]
    df = spark.createDataFrame(rows, "source_id string, tier string, enabled boolean")
    n = date(2026, 7, 24).toordinal()
    due = {s for s, t, e in rows if e and (t == "core" or int(hashlib.sha256(s.encode()).hexdigest(), 16) % (3 if t == "extended" else 7) == n % (3 if t == "extended" else 7))}
    assert {r.source_id for r in rotation.rotated(df, "2026-07-24", 3, 7).where("due").collect()} == due
    got = [r.source_id for r in rotation.sources_for(df, "2026-07-24", len(due) + 2, 3, 7).collect()]
    assert len(got) == len(due) + 2 and due < set(got)
    day = spark.sql("select date'2026-07-24' as d").select(text.ordinal(F.col("d"))).first()[0]
    assert day == n
    tried = df.where("source_id in ('id0', 'id1')").select("source_id", F.lit("failure").alias("status"))
    assert rotation.fallback_wave(df.where("enabled"), tried, "2026-07-24", 5).count() == 2


def test_memory(spark):
    events = spark.createDataFrame([("k",), ("new",), (None,)], "event_key string")
    seen = spark.createDataFrame([("k", "2026-07-01 00:00:00")], "event_key string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    fresh = lambda day: {r.event_key for r in memory.unseen(events, seen, f"2026-07-{day:02d} 00:00:00").collect()}
    assert fresh(7) == {"new", None} and fresh(9) == {"k", "new", None}
    assert {r.event_key for r in memory.remembered(seen, events.where("event_key = 'new'"), "2026-07-09 00:00:00").collect()} == {"new"}
    known = spark.createDataFrame([("a", "scored")], "item_id string, stage string")
    assert memory.isolated_once(known, spark.createDataFrame([("a", "scored"), ("b", "scored"), ("b", "scored")], "item_id string, stage string")).count() == 2


def test_topic_groups_and_source_specs(spark):
    df = spark.createDataFrame([(0, "a", "rss", "A"), (1, "b", "hn", "B"), (2, "c", "rss", None)], "seq long, id string, source_type string, content string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "keep string, drop string")
    got = merge.apply_topic_groups(df, pairs).collect()
    assert len(got) == 1 and got[0].content == "A\n\n--- From hn ---\nB"


def test_dates(spark):
    forms = [("Fri, 24 Jul 2026 08:00:00 GMT", "2026-07-24 08:00:00"), ("2026-07-24T08:00:00+02:00", "2026-07-24 06:00:00"), ("20260724T080000Z", "2026-07-24 08:00:00"), ("2026年7月4日", "2026-07-04 00:00:00"), ("nonsense", None), (None, None)]
    df = spark.createDataFrame(forms, "t string, want string")
    assert df.where(~text.parsed_date(F.col("t")).eqNullSafe(F.col("want").cast("timestamp"))).count() == 0


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.bounded(F.lit("  a \n b  "), 3)) == "a b" and one(text.bounded(F.lit("  "))) is None
    assert one(text.retry_delay(F.lit(3), F.lit(None).cast("double"))) == 2.0 and one(text.retry_delay(F.lit(1), F.lit(90.0))) == 60.0
    assert one(text.metric_signatures(F.lit("1.50% and 3 bn"))) == ["1.5%", "3billion"]
    assert one(text.spaced_scripts(F.lit("新品ABC发布"))) == "新品 ABC 发布"
    assert one(clusters.company_tags(F.array(F.lit("Acme Foods Company Ltd"), F.lit("United Dairy Farms")))) == sorted({"acmefoodscompanyltd", "acmefoods", "uniteddairyfarms", "udf"})
    assert one(clusters.event_kinds(F.lit("fundingforanewfactory"))) == ["capacity", "investment"]


def test_arrow_functions(spark):
    from difflib import SequenceMatcher

    ship(spark)
    df = spark.createDataFrame([("Ｎｅｗ &amp; Drink", "new drink"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(text_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, "newdrink", "newdrink").ratio(), 0.0]
    j = spark.createDataFrame([('```json\n{"b": 1, "a": [1,],}\n```',), ("no",), (None,)], "t string").select(loose_json("t")).collect()
    assert [r[0] for r in j] == ['{"a": [1], "b": 1}', None, None]


REPORT = "seq long, at string, url_key string, title string, title_zh string, summary string, category string, markets array<string>, companies array<string>, subjects array<string>, kinds array<string>, key_parts array<string>"


def reports(spark, rows):
    df = spark.createDataFrame(rows, REPORT).withColumn("published_at", F.col("at").cast("timestamp")).drop("at")
    from brieflake.functions.similarity import folded_all

    df = df.withColumn("folded", folded_all(F.array("title", "title_zh"))).checkpoint()
    return df.withColumn("blocks", clusters.blocks(F.col("folded"), F.col("companies"), F.col("subjects"))).drop("folded")


def closure(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_copies_cross_bucket_borders(spark):
    checkpoint_dir(spark)
    at = [f"2026-07-{d:02d} {h:02d}:00:00" for d, h in [(1, 0), (2, 23), (3, 1), (9, 0)]]
    rows = [(i, t, f"u{i}", "One title of many words", None, "s", "c", ["US"], [], [], [], []) for i, t in enumerate(at)]
    rows += [(10 + i, at[0], f"v{i}", "!", "", "no title", "c", ["US"], ["acme"], ["milk"], [], []) for i in range(2)]
    links = {(r.a, r.b) for r in clusters.similar_events(reports(spark, rows)).collect()}
    assert closure(links, range(4)) == {0: 0, 1: 0, 2: 0, 3: 3} and not any(a >= 10 for a, _ in links)


def rule_table(x, y, hours=48):
    """The rules as they are written down, every ratio in full."""
    from difflib import SequenceMatcher

    from brieflake.functions.similarity import figures, fold

    full = lambda a, b: SequenceMatcher(None, a, b).ratio() if a and b else 0.0
    age = abs(datetime.fromisoformat(x[1]) - datetime.fromisoformat(y[1])).total_seconds() / 3600
    if x[2] == y[2] or age > hours:
        return x[2] == y[2]

    def over(a, b, fuzzy=None):
        return any(p == q or min(len(p), len(q)) >= 2 and (p in q or q in p) or fuzzy and min(len(p), len(q)) >= 4 and full(p, q) >= fuzzy for p in a for q in b)

    titles = lambda r: {fold(r[3]), fold(r[4])} - {""}
    title = max((full(p, q) for p in titles(x) for q in titles(y)), default=0.0)
    pref = full(fold(x[4] or x[3]), fold(y[4] or y[3]))
    market, category, company = bool({*x[7]} & {*y[7]}), x[6] == y[6], over(x[8], y[8])
    subject, part, kind = over(x[9], y[9], 0.65), over(x[11], y[11]), bool({*x[10]} & {*y[10]})
    fits = not x[10] or not y[10] or kind
    whole = company and market and category
    text_ = full(fold(x[5]), fold(y[5])) if whole else 0.0
    mx, my = (figures(" ".join(v for v in (r[3], r[4], r[5]) if v)) if whole else [] for r in (x, y))
    metric = max((full(p, q) for k, p in mx for m, q in my if k == m), default=0.0)
    return (
        title >= 0.9 or company and subject and fits and (pref >= 0.4 or part and pref >= 0.25)
        or company and market and category and kind and metric >= 0.2 and (subject or metric >= 0.45) and pref >= (0.2 if age <= 48 else 0.45)
        or company and market and category and fits and text_ >= 0.6 and pref >= 0.35 or market and subject and fits and pref >= 0.45
    )


def made_reports(n, seed):
    r = random.Random(seed)
    firms = [("Acme Foods", ["acmefoods", "acme"]), ("伊利", ["伊利"]), ("伊利集团", ["伊利集团", "伊利"]), ("Dairy United", ["dairyunited"]), ("蒙牛", ["蒙牛"])]
    things = [("oat milk", ["oatmilk"], "燕麦奶"), ("oats milks", ["oatsmilk"], "燕麦奶饮料"), ("pea protein bar", ["peaproteinbar"], "豌豆蛋白棒"), ("yoghurt", ["yoghurt"], "酸奶"), ("yogurts", ["yogurts"], "酸奶杯")]
    acts = [("launches", ["launch"], "推出"), ("invests in", ["investment"], "投资"), ("recalls", ["recall"], "召回"), ("talks about", [], "谈")]
    out = []
    for i in range(n):
        (firm, tags), (thing, subj, zh), (act, kinds, azh) = r.choice(firms), r.choice(things), r.choice(acts)
        title = f"{firm} {act} {thing} in {r.choice(['spring', 'the spring', 'stores', 'May'])}" + r.choice(["", " again", ", report says"])
        extra = r.choice(["", f"Revenue rose {r.choice(['12.5%', '12.50%', '3 bn'])} in the year", f"More on {thing} by {firm}"])
        at = f"2026-07-{r.randint(1, 9):02d} {r.randint(0, 23):02d}:00:00"
        out.append((i, at, f"u{i if r.random() < 0.95 else 0}", title, f"{firm}{azh}{zh}" if r.random() < 0.5 else None, extra, r.choice("cd"), [r.choice(["US", "CN"])], tags, subj, kinds, subj[:1] if r.random() < 0.5 else []))
    return out


@pytest.mark.parametrize("part", [clusters.PART, 3])
def test_similar_events_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(clusters, "PART", part)
    checkpoint_dir(spark)
    rows = made_reports(140, 5)
    links = {(r.a, r.b) for r in clusters.similar_events(reports(spark, rows)).collect()}
    want = {(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if rule_table(x, y)}
    assert links <= want and len(want) > 300
    ids = [r[0] for r in rows]
    assert closure(links, ids) == closure(want, ids)


def test_events_like_remembered_ones(spark):
    checkpoint_dir(spark)
    rows = made_reports(120, 6)
    new, old = rows[:60], rows[60:]
    old = [(r[0], r[1], f"m{r[2]}", *r[3:]) for r in old] + [(900, "2026-07-01 00:00:00", new[3][2], "elsewhere", None, "", "c", [], [], [], [], [])]
    seen = reports(spark, old).withColumn("seen_at", F.col("published_at"))
    got = {r.seq for r in memory.unlike(reports(spark, new), seen, "2026-07-10 00:00:00").collect()}
    live = [r for r in old if datetime.fromisoformat(r[1]) >= datetime(2026, 7, 3)]
    want = {x[0] for x in new if not any(rule_table(x, y, 168) for y in live)}
    assert got == want and 0 < len(want) < 60


def test_company_names_of_any_script(spark):
    got = spark.createDataFrame([(["伊利集团", "Nestlé", "Ａｃｍｅ Foods Co"],), ([],), (None,)], "t array<string>").select(clusters.company_tags(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [sorted(["伊利集团", "nestlé", "nestl", "acmefoodsco", "acmefoods"]), [], []]
    parts = spark.createDataFrame([("Acme|Protein Tea|launch|JP|20260724|global|ab",)], "k string").select(event_key_parts(F.col("k"), F.array(F.lit("acmefoods"), F.lit("acme")), F.array(F.lit("JP")))).first()[0]
    assert parts == ["launch", "proteintea"]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    got = merge.components(edges, spark.range(1, 45).withColumnRenamed("id", "node"))
    assert {r.node: r.label for r in got.collect()} == {n: (1 if n <= 40 else n) for n in range(1, 45)}


def test_safe_addresses(spark):
    rows = [("https://e.com/x", True), ("http://192.168.1.1/", False), ("https://127.0.0.1", False), ("https://[::1]/", False), ("https://172.20.0.1/", False), ("https://8.8.8.8/", True), ("https://a.localhost/", False), ("https://u@e.com/", False), ("file:///etc/passwd", False)]
    df = spark.createDataFrame(rows, "url string, want boolean")
    assert [r.url for r in df.where(urls.is_safe(F.col("url")) != F.col("want")).collect()] == []


def test_events_by_metric_context_and_fuzzy_subjects(spark):
    row = "seq long, published_at timestamp, url_key string, title string, title_zh string, summary string, category string, markets array<string>, companies array<string>, subjects array<string>, kinds array<string>, key_parts array<string>, blocks array<string>"
    at = "2024-01-01 00:00:00"
    data = [
        (1, "Acme posts sales", "Acme group revenue rose 12.50% in the year", "c", ["US"], ["acme"], ["milk"], ["financial_performance"], ["m"]),
        (2, "Acme reports year", "after a hard spring for all of its mills and farms, revenue rose 12.5％ in the year; costs and debts are to be told in June", "c", ["US"], ["acme"], ["grain"], ["financial_performance"], ["m"]),
        (3, "New yogurt drink is out", "a", "c", ["JP"], ["x1"], ["yoghurts"], ["launch"], ["s"]),
        (4, "New drinks out of yogurt", "b", "d", ["JP"], ["y2"], ["yogurtz"], ["launch"], ["s"]),
    ]
    checkpoint_dir(spark)
    df = spark.createDataFrame([(i, at, f"u{i}", t, None, x, c, m, co, su, k, [], b) for i, t, x, c, m, co, su, k, b in data], row.replace("timestamp", "string")).withColumn("published_at", F.to_timestamp("published_at"))
    assert {(r.a, r.b) for r in clusters.similar_events(df).collect()} == {(1, 2), (3, 4)}


def test_near_titles_of_many_copies(spark):
    """Copies meet others as one class: 3,000 of each of two titles make no pairs of rows."""
    rows = [(i, ("steel bolt", "steel bolts")[i % 2], "x") for i in range(10, 6010)] + [(1, "brass", "x"), (2, "grass", "x"), (3, "brass", "y"), (4, None, "x"), (5, None, "x"), (6, "brass", None), (7, "", "x"), (8, "abc", "x"), (9, "abcd", "y")]
    df = spark.createDataFrame(rows, "seq long, title string, block string")
    got = {r.seq: r.cluster for r in clusters.near_titles(df, 3, "block").collect()}
    want = {r[0]: 10 for r in rows[:6000]} | {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    assert got == want


def test_fixed_point_is_python_s(spark):
    r = random.Random(4)
    xs = [0.965, 0.125, 0.375, 2.5, 0.005, 1.005, 9.995, 9.99995, 0.0, -0.0, -1.125, 1e-12, 123456.78125, 0.5, 10.0, 5e-324, -0.001, float("nan"), float("inf"), -float("inf")]
    xs += [r.choice([r.random() * 10, r.randint(0, 80000) / 8000, round(r.random() * 10, 3)]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.fixed_point(F.col("x"), 2).alias("two"), text.fixed_point(F.col("x"), 4).alias("four"))
    assert [r for r in df.collect() if (r.two, r.four) != (f"{r.x:.2f}", f"{r.x:.4f}")] == []


def test_fixed_point_of_a_long_expression_and_next_to_halves(spark):
    """What is rounded stands once in the plan, however many steps read it; neighbours of halves go their own way."""
    xs = [y for k in range(0, 40000, 37) for h in [(k + 0.5) / 10000, (k + 0.5) / 100] for y in (h, math.nextafter(h, 1e9), math.nextafter(h, -1))]
    long = F.col("x") + F.lit(987654321) - F.lit(987654321.0)
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", text.fixed_point(F.col("x"), 2).alias("two"), text.fixed_point(F.col("x"), 4).alias("four"), text.fixed_point(long, 4).alias("long"))
    assert df._jdf.queryExecution().analyzed().toString().count("9.87654321E8") == 1
    assert [r for r in df.collect() if (r.two, r.four, r.long) != (f"{r.x:.2f}", f"{r.x:.4f}", f"{r.x + 987654321 - 987654321.0:.4f}")] == []


@pytest.mark.parametrize("by", [None, "k"])
def test_numbered(spark, by):
    rows = [(i % 2 if i else None, (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got = windows.numbered(df, [F.desc("v")], by=by).collect()
    seen: dict = {}
    for k, v in sorted(rows, key=lambda x: -x[1]):
        seen.setdefault(k if by else 0, []).append(v)
    assert {(r.k, r.v): r.place for r in got} == {(k, v): seen[k if by else 0].index(v) + 1 for k, v in rows}
    assert windows.numbered(df.limit(0), [F.desc("v")], by=by).count() == 0
