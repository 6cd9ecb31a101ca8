from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from brieflake.operators import analysis, ranking
from brieflake.plans import pipeline
from brieflake.sources import adapters
from pyspark.sql import functions as F

SINCE = "2026-07-01 00:00:00"


def test_code_events(spark):
    rows = [("1", "PushEvent", "u", "u/r", "2026-07-02T00:00:00Z", json.dumps({"commits": [{"message": f"m{i}"} for i in range(4)]})), ("2", "ForkEvent", "u", "u/r", "2026-07-02T00:00:00Z", "{}"), ("3", "WatchEvent", "u", "u/r", "2026-06-02T00:00:00Z", "{}"), ("4", "ReleaseEvent", "u", "u/r", "2026-07-03T00:00:00Z", json.dumps({"release": {"tag_name": "v1", "body": "b", "html_url": "https://x"}}))]
    got = adapters.code_events(spark.createDataFrame(rows, "id string, type string, actor string, repo string, created_at string, payload string"), SINCE).orderBy("id").collect()
    assert [(r.title, r.content, r.url) for r in got] == [("u pushed 4 commit(s) to u/r", "m0\nm1\nm2", "https://github.com/u/r"), ("u released v1 in u/r", "b", "https://x")]


def test_stories_and_posts(spark):
    t = int(datetime(2026, 7, 2, tzinfo=timezone.utc).timestamp())
    s = spark.createDataFrame([(1, 0, "T", None, "own", "a", 50, t, [10, 11, 12]), (2, 1, "low", None, None, "a", 1, t, None)], "id long, place int, title string, url string, text string, by string, score int, time long, kids array<long>")
    c = spark.createDataFrame([(10, "x", "<p>hi", None, None), (11, "y", "gone", True, None), (12, None, "yo" * 300, None, None)], "id long, by string, text string, deleted boolean, dead boolean")
    r = adapters.stories(s, c, SINCE, 10, 100).collect()
    assert len(r) == 1 and r[0].content == "own\n\n\n--- Top Comments ---\n\n[x]: hi\n\n[anon]: " + ("yo" * 300)[:497] + "..."
    p = spark.createDataFrame([("p", "sub", "T", "https://e.com", "/r/x", False, "", "a", 9, t)], "id string, subreddit string, title string, url string, permalink string, is_self boolean, selftext string, author string, score int, created_utc long")
    k = spark.createDataFrame([("p", f"c{i}", "z", f"body{i}", i, "moderator" if i == 9 else None) for i in range(10)], "post_id string, id string, author string, body string, score int, distinguished string")
    r = adapters.posts(p, k, SINCE, 5, 2).first()
    assert r.url == "https://e.com" and "[z (8 pts)]: body8" in r.content and "body9" not in r.content and "body6" not in r.content


def test_other_services(spark):
    rows = [(0, 1, "o/one", "an AI tool", "30", None, None), (1, 1, "o/one", "again AI", "99", None, None), (2, 2, "o/two", None, "x", None, "AI things"), (3, 3, "o/three", "AI", "70", None, None)]
    got = adapters.trending(spark.createDataFrame(rows, "seq long, repo_id long, repo_name string, description string, stars string, primary_language string, collection_names string"), 10, ["ai"], 5, "past_24_hours", SINCE).collect()
    assert [r.title for r in got] == ["o/three (+70⭐ past_24_hours)", "o/one (+30⭐ past_24_hours)"]
    news = spark.createDataFrame([("https://e.com/1", "t", "20260702T000000Z", "e.com", "en"), ("https://e.com/2", "t", "bad", "e.com", "en"), ("", "t", "20260702T000000Z", "e.com", "en")], "url string, title string, seendate string, domain string, language string")
    assert adapters.monitored_news(news, SINCE).count() == 1
    company = spark.createDataFrame([(0, "w", "https://e.com", "t", "b", None, "aapl, MSFT,aapl", "2026-07-02T00:00:00Z"), (1, "w2", "https://e.com", "t", "b", None, "x", "2026-07-03T00:00:00Z"), (2, "w", "https://f.com", "t", "b", None, "x", "2026-07-01T00:00:00Z")], "seq long, watchlist string, url string, title string, body string, author string, symbols string, date string")
    r = adapters.company_news(company, SINCE).collect()
    assert len(r) == 1 and r[0].symbols == ["AAPL", "MSFT"] and r[0].author == "AAPL"
    tw = spark.createDataFrame([("1", "n", None, "a\n" * 40, None, datetime(2026, 7, 2), 1, 1), ("1", "n", None, "a\n" * 40, None, datetime(2026, 7, 2), 1, 1)], "tweet_id string, screen_name string, name string, text string, url string, created_at timestamp, favorite_count int, reply_count int")
    r = adapters.tweets(tw, SINCE).collect()
    assert len(r) == 1 and r[0].title.endswith("...") and "\n" not in r[0].title
    rep = spark.createDataFrame([("1", "@me", str(i), "me" if i == 3 else f"h{i}", "hi", i, 0) for i in range(1, 6)], "tweet_id string, author string, reply_id string, handle string, text string, likes int, replies int")
    assert [x.split(" ")[0] for x in adapters.top_replies(rep, 2, 2).first().replies] == ["[@h5", "[@h4"]
    msgs = spark.createDataFrame([("c", i, datetime(2026, 7, 2), f"line {i}\nrest", ["https://t.me/x", "https://e.com"] if i == 3 else []) for i in range(1, 4)], "channel string, message_id long, at timestamp, text string, links array<string>")
    r = {x.title: x.url for x in adapters.channel_messages(msgs, SINCE, 2).collect()}
    assert r == {"line 3": "https://e.com", "line 2": "https://t.me/c/2"}


def test_search_time():
    now = datetime(2026, 7, 24, tzinfo=timezone.utc)
    assert adapters.news_search_time(now - timedelta(hours=30), now) == "when:30h"
    assert adapters.news_search_time(now - timedelta(hours=101), now) == "after:2026-07-19"
    assert adapters.news_search_time(now - timedelta(days=2), now, now) == "after:2026-07-22 before:2026-07-25"


def test_subscriptions(spark):
    m = spark.createDataFrame([("A@e.com", "Join", 1), ("a@e.com", "Leave", 2), ("b@e.com", "Join", 3), ("noreply@e.com", "Join", 4), ("c@e.com", "join us", 5)], "sender string, subject string, seq long")
    s = spark.createDataFrame([("a@e.com",), ("d@e.com",)], "email string")
    assert sorted(r.email for r in adapters.subscriptions(m, s, "Join", "Leave").collect()) == ["b@e.com", "d@e.com"]


def test_sub_source(spark):
    df = spark.createDataFrame([({"subreddit": "x"}, "a"), ({"feed_name": "", "domain": "e.com"}, "a"), ({}, ""), (None, "me")], "metadata map<string,string>, author string")
    assert [r[0] for r in df.select(analysis.sub_source()).collect()] == ["r/x", "e.com", "unknown", "me"]


def answer(prompt: str) -> str:
    if "broken" in prompt:
        raise RuntimeError("no answer")
    relevant = "irrelevant" not in prompt
    return json.dumps({"relevant": relevant, "category": "company_updates", "importance": 8, "relevance": 8, "opportunity": 8, "evidence_quality": 8, "risk_level": "none", "event_key": "same" if "same" in prompt else "e" if "known" in prompt else None, "title_zh": prompt.split("\n")[0], "summary": "s"})


def test_pipeline_end_to_end(spark):
    at = datetime(2026, 7, 24)
    rows = [(0, "a", "S", "rss", "same  event one", "https://a.com/1", "x", None, at), (1, "b", "S", "rss", "same event two", "https://b.com/1", "y", None, at), (2, "c", "S", "rss", "broken", "https://c.com", "x", None, at), (3, "d", "S", "rss", "irrelevant", "https://d.com", "x", None, at), (4, "e", "S", "rss", "known", "https://e.com", "x", None, at), (5, "f", "none", "rss", "no contract", "https://f.com", "x", None, at), (6, "g", "S", "rss", "old", "https://g.com", "x", None, at - timedelta(days=9)), (7, "h", "S", "rss", "copy", "https://a.com/1?utm_source=z", "longer text", None, at)]
    raw = spark.createDataFrame(rows, "seq long, id string, source_id string, source_type string, title string, url string, content string, metadata map<string,string>, published_at timestamp")
    contracts = spark.createDataFrame([("S", ["company_updates"], 1, ["US"])], "source_id string, categories array<string>, evidence_tier int, markets array<string>")
    seen = spark.createDataFrame([("e", datetime(2026, 7, 23))], "event_key string, seen_at timestamp")

    def silent(prompt: str) -> str:
        return ""

    b = pipeline.run(raw, contracts, [silent, answer], seen, ranking.Profile(), "2026-07-23 00:00:00", "2026-07-25 00:00:00")
    assert b.counts["isolated"] == 2 and b.counts["events"] == 4 and b.counts["admitted"] == 3
    assert sorted(r["title"] for r in b.rows) == ["copy", "same event two"]
    keys = {r.event_key for r in b.memory.collect()}
    # an item without a key of its own goes by its address
    assert b.document["hash"] and keys >= {"same", "e"} and any(k.startswith("url:") for k in keys)
