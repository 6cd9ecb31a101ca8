"""Ordered attempts, channel pages, constraints, and the stream of feed files."""

from __future__ import annotations

import json
import os

from brieflake.plans import constraints
from brieflake.sources import adapters, attempts, readers
from pyspark.sql import functions as F


def test_settled(spark):
    rows = [("a", 0, "page", 200, 0), ("a", 1, "json", 403, None), ("a", 2, "feed", 200, 3), ("b", 0, "page", 200, 2), ("b", 1, "json", 200, 9), ("c", 0, "page", None, None), ("c", 1, "json", 500, None), ("c", 2, "feed", 200, 1), ("d", 0, "page", 200, 0), ("e", None, "page", 200, 1)]
    a = spark.createDataFrame(rows, "key string, place int, kind string, status int, found int")
    s = attempts.settled(a, "key", "place", attempts.listing_open(F.col("kind"), F.col("status"), F.col("found")))
    assert {r.key: (r.kind, r.failed) for r in s.collect()} == {"a": ("feed", False), "b": ("page", False), "c": ("json", False), "d": ("page", True)}
    m = attempts.settled(a, "key", "place", attempts.mirror_failed(F.col("status"))).collect()
    assert {r.key: r.kind for r in m} == {"a": "page", "b": "page", "c": "feed", "d": "page"}
    assert attempts.settled(a.limit(0), "key", "place", F.lit(False)).count() == 0


def _message(post: str, body: str, at: str = '<time datetime="2024-03-05T10:00:00+08:00">') -> str:
    return f'<div class="x tgme_widget_message" data-post="{post}"><div class="tgme_widget_message_text js-message_text">{body}</div>{at}</time></div>'


def test_channel_pages(spark):
    page = _message("tea/7", "New&nbsp;cup<br/>now <div>in <b>tin</b></div> <a href='https://t.me/x'>x</a> <a href='https://tea.example/7'>more</a>") + _message("tea/8", "  ") + _message("tea/9", "undated", "<time>") + _message("tea/", "no id") + _message("tea/10", "plain &lt;b&gt;")
    pages = spark.createDataFrame([("tea", page), ("none", None), ("empty", "")], "channel string, html string")
    got = {r.message_id: r for r in attempts.channel_rows(pages).collect()}
    assert set(got) == {7, 10} and got[7].text == "New\xa0cup\nnow in tin x more" and got[10].text == "plain <b>"
    assert got[7].links == ["https://t.me/x", "https://tea.example/7"] and str(got[7]["at"]) == "2024-03-05 02:00:00"
    items = adapters.channel_messages(attempts.channel_rows(pages), "2024-01-01 00:00:00", 5).collect()
    assert {r.url for r in items} == {"https://tea.example/7", "https://t.me/tea/10"}


def test_constraints(spark):
    R = constraints.Rule
    rules = (R("$.n", "required"), R("$.n", "number"), R("$.n", "ge", 1), R("$.n", "lt", 5), R("$.name", "matches", "^[a-z]+$"), R("$.a.list[].k", "required"), R("$.a.list[].k", "oneof", ("x", "y")))
    configs = {1: {"n": 1, "name": "ok", "a": {"list": [{"k": "x"}]}}, 2: {"n": 5, "name": "No", "a": {"list": [{"k": "z"}, {}, {"k": None}]}}, 3: {"n": "three", "a": {"list": 7}}, 4: {"n": None}, 5: {"n": 0.5, "name": ""}}
    rows = [(k, json.dumps(v)) for k, v in configs.items()] + [(6, "{"), (7, None)]
    got = sorted((r.id, r.path, r.rule) for r in constraints.violations(spark.createDataFrame(rows, "id long, config string"), rules).collect())
    assert got == [(2, "$.a.list[0].k", "oneof"), (2, "$.a.list[1].k", "required"), (2, "$.a.list[2].k", "required"), (2, "$.n", "lt"), (2, "$.name", "matches"), (3, "$.n", "number"), (4, "$.n", "required"), (5, "$.n", "ge"), (5, "$.name", "matches"), (6, "$", "json"), (7, "$", "json")]


def test_feed_stream_stops_and_resumes(spark, tmp_path):
    from brieflake.ship import ship

    ship(spark)
    spark.dataSource.register(readers.ItemFeed)
    feeds, out = tmp_path / "feeds", str(tmp_path / "out")
    feeds.mkdir()

    def put(name: str, text: str, at: int) -> None:
        (feeds / name).write_text(text)
        os.utime(feeds / name, (at, at))

    def feed(*names: str) -> str:
        return "<rss><channel>" + "".join(f"<item><title>{n}</title><link>https://e.example/{n}</link></item>" for n in names) + "</channel></rss>"

    def run() -> list:
        s = spark.readStream.format("brieflake_feed").option("adapter", "rss").option("path", str(feeds)).load()
        s.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", out).start().awaitTermination()
        return sorted((r.title or "", r.error is not None) for r in spark.read.parquet(out).collect())

    put("b.xml", feed("one", "two"), 1_700_000_000)
    put("a.xml", feed("three"), 1_700_000_000)
    first = [("one", False), ("three", False), ("two", False)]
    assert run() == first and run() == first
    put("c.xml", feed("four"), 1_700_000_000)
    put("aa.xml", "no feed <", 1_700_000_100)
    assert run() == sorted([*first, ("four", False), ("", True)])
    (feeds / "a.xml").unlink()
    put("d.xml", feed("five"), 1_700_000_200)
    assert run() == sorted([*first, ("four", False), ("five", False), ("", True)])
