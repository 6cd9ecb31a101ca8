from __future__ import annotations

import json
import time

import pytest
from brieflake.plans import render
from brieflake.plans.runs import RunStore
from brieflake.sources import parsers, readers
from brieflake.streaming import dedup
from pyspark.sql import functions as F

FEED = b"""<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><guid>1</guid><title>Tides &amp; locks</title><link>https://e.com/1</link><description><![CDATA[<p>Some <b>text</b></p>]]></description><pubDate>Fri, 24 Jul 2026 08:00:00 GMT</pubDate></item>
<item><guid>2</guid><title>Old</title><link>https://e.com/2</link><pubDate>Wed, 01 Jul 2026 08:00:00 GMT</pubDate></item></channel></rss>"""
ATOM = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>a</id><title>T</title><link href="https://e.com/a"/><updated>2026-07-24T01:00:00Z</updated><author><name>N</name></author></entry></feed>"""
PAGE = b"""<html><body><section class="row"><h2><a href="/a">Harbour opens</a></h2><time datetime="2026-07-24T00:00:00Z">x</time><p class="lead">Quay</p></section>
<section class="row"><h2><a href="/b">Ad</a></h2>Brought by X</section><section class="row"><a href="/a">Again</a></section>
<script type="application/ld+json">{"@graph": [{"datePublished": "2026-07-24"}]}</script></body></html>"""


def test_feeds():
    a = list(parsers.parse_feed(FEED))
    assert a[0] == {"native_id": "1", "title": "Tides & locks", "url": "https://e.com/1", "published": "Fri, 24 Jul 2026 08:00:00 GMT", "content": "Some text", "author": None}
    b = list(parsers.parse_feed(ATOM))
    assert b[0]["url"] == "https://e.com/a" and b[0]["author"] == "N" and b[0]["published"] == "2026-07-24T01:00:00Z"


def test_json_api():
    data = json.dumps({"data": {"rows": [{"caption": "Bridge reopens", "link": "https://e.com/1", "published": "2026-07-24T00:00:00Z", "lead": "d"}, {"caption": "no date", "link": "x"}]}}).encode()
    got = list(parsers.parse_json_api(data, {"items_path": "data.rows", "title_field": "caption", "url_field": "link", "date_field": "published", "content_field": "lead"}))
    assert [r["title"] for r in got] == ["Bridge reopens"] and got[0]["content"] == "d"


def test_html_list():
    opts = {"item_selector": "section.row", "title_selector": "h2 a", "date_selector": "time[datetime]", "content_selector": ".lead", "exclude": "Brought by"}
    got = list(parsers.parse_html_list(PAGE, "https://e.com/list", opts))
    assert [(r["title"], r["url"], r["published"], r["content"]) for r in got] == [("Harbour opens", "https://e.com/a", "2026-07-24T00:00:00Z", "Quay")]
    assert parsers.json_ld_field(parsers.parse_html(PAGE), ("datePublished",)) == "2026-07-24"
    docs = list(parsers.parse_document_index(b'<li class="d"><a href="/x.pdf">X</a></li>', "https://e.com", {"item_selector": "li.d"}))
    assert docs[0]["media_type"] == "application/pdf" and docs[0]["content"] is None
    assert parsers.article_text("<body><nav><p>n</p></nav><article><p>One</p><p>Two</p></article></body>") == "One\nTwo"
    assert parsers.markdown_table("| a | b |\n|---|:-:|\n| 1 | 2 |") == [{"a": "1", "b": "2"}]


def test_reader_isolates_failures(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(FEED)
    (tmp_path / "b.xml").write_bytes(b"<rss><broken")
    raw = readers.raw_records(spark, str(tmp_path), "rss").cache()
    assert raw.where("error is not null").count() == 1
    kept = readers.items(raw, "M001", "2026-07-20 00:00:00", "2026-07-25 00:00:00")
    assert [r.title for r in kept.collect()] == ["Tides & locks"]
    o = readers.outcome(raw, kept, "M001").first()
    assert (o.status, o.candidate_count, o.item_count, o.parse_rate) == ("success", 2, 1, 1.0)
    both = readers.discovered([kept, kept])
    assert both.count() == 1


def test_data_source(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(FEED)
    from brieflake.ship import ship

    ship(spark)
    spark.dataSource.register(readers.ItemFeed)
    assert spark.read.format("brieflake_feed").option("adapter", "rss").load(str(tmp_path / "a.xml")).count() == 2


def test_source_packs(spark, tmp_path):
    from brieflake.operators.merge import merge_source_specs

    for name, tier in (("p1", "core"), ("p2", "extended")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, "sources": [{"id": "S", "adapter": "rss", "collection_tier": tier, "url": "u"}]}))
    (tmp_path / "empty.json").write_text(json.dumps({"id": "empty", "sources": []}))
    got = merge_source_specs(readers.source_packs(spark, str(tmp_path))).collect()
    assert [(r.id, r.tier, r.packs) for r in got] == [("S", "core", ["p1", "p2"])]


def test_run_store(spark, tmp_path):
    store, calls = RunStore(spark, str(tmp_path / "runs")), []

    def stage(name):
        def f(df):
            calls.append(name)
            return spark.range(3) if df is None else df.where("id > 0")

        return f

    stages = {s: stage(s) for s in ("raw", "normalized", "scored")}
    assert store.run("r1", {"a": 1}, stages).count() == 2
    assert store.completed("r1") == ["raw", "normalized", "scored"] and store.counts("r1") == {"raw": 3, "normalized": 2, "scored": 2}
    n = len(calls)
    assert store.run("r1", {"a": 1}, stages, resume=True).count() == 2 and len(calls) == n
    with pytest.raises(ValueError):
        store.run("r1", {"a": 2}, stages, resume=True)
    with pytest.raises(ValueError):
        store.load("../x", "raw")


def test_render():
    doc = render.facts([{"part": "must_read", "title": "A [b]", "url": "https://e.com", "final_score": 7.0}], {"title": "T"})
    assert doc["hash"] in render.markdown(doc) and doc["hash"] in render.page(doc) and r"A \[b\]" in render.markdown(doc)
    assert render.facts([], {"title": "T"})["hash"] != doc["hash"] and "Nothing today." in render.markdown(render.facts([], {}))
    cards = render.packed(["x" * 17_000, "y" * 9_000, "z" * 40_000])
    assert "".join(e for c in cards for e in c) == "x" * 17_000 + "y" * 9_000 + "z" * 40_000
    assert all(len(json.dumps(c)) < 25_000 for c in cards)
    assert render.template("#{a?limit=5&split=\\n} #{b} #{c}", {"a": "one\ntwo\nthree", "b": "B"}) == "one B #{c}"
    assert render.redacted({"api_key": "s", "u": "https://u:p@e.com/?token=1&x=2"}) == {"api_key": "***", "u": "https://***@e.com/?token=***&x=2"}
    assert render.expanded({"a": ["${X}", "${Y}"]}, {"X": "1"}) == {"a": ["1", "${Y}"]}


def test_stream_commits_before_it_remembers(spark):
    order = []
    f = dedup.commit_then_remember(lambda df, e: order.append("write"), lambda df, e: order.append("remember"))
    f(spark.range(1), 0)
    assert order == ["write", "remember"]

    def fail(df, e):
        raise RuntimeError("sink")

    with pytest.raises(RuntimeError):
        dedup.commit_then_remember(fail, lambda df, e: order.append("remember"))(spark.range(1), 1)
    assert order == ["write", "remember"]


def test_extracted_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert readers.extracted(pages).where(F.length("content") > 0).count() > 0


def test_stream_remembers_keys_by_groups_over_batches(spark, tmp_path):
    """Four batches against a plain loop; states are no more than the groups, however many keys there are, and forget what has expired."""
    rows = [(f"k{k}", day * 86_400 + (k * 7919 + day) % 50_000) for day in (1, 5, 8, 9, 30) for k in range(2500) if (k + day) % 3]
    rows += [("k1", 86_400), ("k1", 86_400), (None, 86_401)]
    for i, days in enumerate(((1,), (5,), (8, 9), (30,))):
        part = [r for r in rows if r[1] // 86_400 in days]
        spark.createDataFrame(part, "key string, at long").select("key", F.timestamp_seconds("at").alias("seen")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if i < 3 else 0)  # files are read by their time
    stream = spark.readStream.schema("key string, seen timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = dedup.unremembered(stream, "key", "seen").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").start()
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(states) <= dedup.GROUPS < 2500
    last, want = {}, []
    for key, at in sorted((r for r in rows if r[0]), key=lambda r: r[1]):
        if key not in last or at - last[key] > 7 * 86_400:
            last[key] = at
            want.append((key, at))
    got = spark.read.parquet(f"{tmp_path}/out").select("key", F.unix_timestamp("seen").alias("at")).collect()
    assert sorted((r.key, r.at) for r in got) == sorted(want)
