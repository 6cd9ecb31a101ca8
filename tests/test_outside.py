"""Domains, addresses, original addresses and calls: what the engine knows of the world outside."""

from __future__ import annotations

import ipaddress
import random
import threading
import time
from urllib.parse import urljoin

import pytest
from brieflake.functions import addresses, domains, urls
from brieflake.operators import calls
from brieflake.sources import original
from pyspark.sql import functions as F

HOSTS = {
    "example.com": ("com", "example.com"), "WWW.Example.CO.UK.": ("co.uk", "example.co.uk"), "com": ("com", ""), "co.uk": ("co.uk", ""), "a.b.example.co.jp": ("co.jp", "example.co.jp"),
    "c.kobe.jp": ("c.kobe.jp", ""), "b.c.kobe.jp": ("c.kobe.jp", "b.c.kobe.jp"), "city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "www.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "www.ck": ("ck", "www.ck"), "b.test.ck": ("test.ck", "b.test.ck"),
    "localhost": ("", ""), "a.b.nosuchsuffix": ("", ""), "食狮.com.cn": ("com.cn", "食狮.com.cn"), "shishi.公司.cn": ("公司.cn", "shishi.公司.cn"), "shishi.xn--55qx5d.cn": ("xn--55qx5d.cn", "shishi.xn--55qx5d.cn"), "10.0.0.1": ("", ""), "": ("", ""), "user.github.io": ("io", "github.io"),
}


def test_domains_by_the_public_list(spark):
    rules = domains.suffix_rules(spark)
    assert rules.count() > 5000
    got = {r.host: r for r in domains.domains(spark.createDataFrame([(h,) for h in [*HOSTS, "example.com"]] + [(None,)], "host string"), rules).collect()}
    assert {h: (r.suffix, r.domain) for h, r in got.items()} == HOSTS
    assert [got[h].name for h in ("10.0.0.1", "a.b.nosuchsuffix", "com", "example.com")] == ["10.0.0.1", "nosuchsuffix", "", "example.com"]


def test_rules_of_a_file(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// a comment\ncom\n*.ck  // two\n!www.ck\n\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\n")
    assert {tuple(r) for r in domains.suffix_rules(spark, str(tmp_path / "rules.dat")).collect()} == {("com", "plain"), ("ck", "wildcard"), ("www.ck", "exception")}
    assert ("github.io", "plain") in {tuple(r) for r in domains.suffix_rules(spark, str(tmp_path / "rules.dat"), private=True).collect()}


def test_domains_of_arrays(spark):
    df = spark.createDataFrame([(1, ["https://a.x.com/1", "https://b.x.com/2"]), (2, ["https://a.x.com/1", "https://y.co.uk", "http://u:p@z.com"]), (3, []), (4, None), (3, [])], "i int, links array<string>")
    d = domains.with_domains(df, F.transform(F.filter("links", urls.is_web), urls.host), domains.suffix_rules(spark), "known")
    assert sorted((r.i, r.n) for r in d.select("i", F.when(F.col("links").isNotNull(), urls.domain_count(F.col("links"), F.col("known"))).alias("n")).collect()) == [(1, 1), (2, 2), (3, 0), (3, 0), (4, None)]


def test_addresses_against_the_standard_library(spark):
    r = random.Random(2)
    hosts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "1::2::3", "fe80::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b:1::", "2001:db8::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "12345::", "a.example", ":", "1:", "2001:20::5", "1:2:3:4:5:6:7::", "::1.2.3.4"]
    for block in (*addresses.NOT_PUBLIC, *addresses.PUBLIC_WITHIN):
        n = ipaddress.ip_network(block)
        hosts += [str(type(n[0])(x)) for x in (int(n[0]), int(n[-1]), max(0, int(n[0]) - 1), min(int(n[-1]) + 1, (1 << n.max_prefixlen) - 1))]
    hosts += [str(ipaddress.IPv4Address(r.getrandbits(32))) for _ in range(300)] + [str(ipaddress.IPv6Address(r.getrandbits(128) if r.random() < 0.5 else 0x2001 << 112 | r.getrandbits(112) >> r.choice([0, 40, 90]))) for _ in range(300)]

    def want(h):
        try:
            a = ipaddress.ip_address(h)
        except ValueError:
            return None
        return (getattr(a, "ipv4_mapped", None) or a).is_global

    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", addresses.is_public(F.col("h")).alias("public")).collect()
    assert [(r.h, r.public, want(r.h)) for r in got if r.public != want(r.h)] == []


def test_links_are_joined_as_the_standard_library_does(spark):
    bases = ["https://a.com/b/c/d?q=1#f", "http://a.com", "https://a.com/", "https://a.com/b/"]
    links = ["", "x", "/x/y", "../x", "../../../x", "./x/.", "?z=2", "#g", "//other.org/p/../q", "https://z.net/a/./b?c", "x?y=/../z", "..", "mailto:a@b", "x/../y;p"]
    rows = [(b, k) for b in bases for k in links]
    got = spark.createDataFrame(rows, "b string, k string").select("b", "k", original.joined(F.col("b"), F.col("k")).alias("u")).collect()
    assert [(r.b, r.k, r.u, urljoin(r.b, r.k)) for r in got if r.u != urljoin(r.b, r.k)] == []


def test_original_addresses(spark):
    g = "https://news.google.com/"
    page = lambda head: f"<html><head>{head}</head>"
    hops = [
        (g + "out", 302, "https://pub.co.uk/story", None), (g + "rel", 301, "again", None), (g + "again", 302, "/third", None), (g + "third", 200, None, page("<meta content='https://pub.com/a?b&amp;c' PROPERTY=og:url><link rel=canonical href=https://late.com/>")),
        (g + "loop", 302, "loop2", None), (g + "loop2", 302, "loop", None), (g + "bare", 302, " ", None), (g + "gone", 404, None, None), (g + "self", 200, None, page(f"<link rel='canonical' href='{g}x'>")), (g + "none", 200, None, page("<link rel=canonical href=''>")),
        (g + "inner", 302, "http://10.1.2.3/x", None), (g + "local", 302, "http://printer.local/", None), (g + "cred", 302, "https://u:p@pub.com/", None), (g + "lost", 302, "nowhere", None), (g + "none", 200, None, page("<link rel=canonical href=''>")),
    ]
    hops += [(g + f"s{i}", 302, f"s{i + 1}" if i else "s1", None) for i in range(5)] + [(g + "s5", 302, "https://far.com/", None)]
    items = [(u, "P" if u.endswith("gone") else " ") for u in sorted({h[0] for h in hops})] + [(g + "unknown", None), ("https://pub.com/own", "P"), ("https://127.0.0.1/x", None), (None, None)]
    i = spark.createDataFrame(items, "url string, publisher string")
    got = {(r.url or "").removeprefix(g): (r.original_status, r.original_url or r.original_error, r.publisher_domain) for r in original.resolved_items(i, spark.createDataFrame(hops, "url string, status int, location string, html string"), domains.suffix_rules(spark)).collect()}
    fail = lambda e: ("failed", e, None)
    assert got == {
        "out": ("resolved", "https://pub.co.uk/story", "pub.co.uk"), **{k: ("resolved", "https://pub.com/a?b&c", "pub.com") for k in ("rel", "again", "third")}, "loop": fail("too_many_redirects"), "loop2": fail("too_many_redirects"),
        "bare": fail("redirect_without_location"), "gone": ("fallback", "http_404", None), "self": fail("original_url_not_found"), "none": fail("original_url_not_found"), "inner": fail("unsafe_target"), "local": fail("unsafe_target"), "cred": fail("unsafe_target"), "lost": fail("request_failed"),
        **{f"s{k}": ("resolved", "https://far.com/", "far.com") for k in range(1, 6)}, "s0": fail("too_many_redirects"), "unknown": fail("request_failed"), "https://pub.com/own": ("fallback", "unsupported_aggregator", None), "https://127.0.0.1/x": fail("unsafe_target"), "": fail("unsupported_aggregator"),
    }
    r = spark.createDataFrame([("pub.co.uk", "8.8.8.8"), ("pub.com", "8.8.8.8"), ("pub.com", "10.0.0.1")], "host string, address string")
    hop = spark.createDataFrame(hops, "url string, status int, location string, html string")
    known = {c.url.removeprefix(g): c.error for c in original.chains(hop, resolved=r).collect()}
    assert known["out"] is None and known["rel"] == known["s3"] == "unsafe_target"


def test_addresses_fetched_often_lead_the_longest_way(spark):
    g = "https://news.google.com/"
    page = lambda to: f"<link rel=canonical href={to}>"
    hops = [(g + "twice", 302, g + "a", None), (g + "twice", 302, g + "b", None), (g + "a", 200, None, page("https://a.com/")), (g + "b", 302, g + "c", None), (g + "c", 200, None, page("https://c.com/")), (g + "same", 302, g + "same", None), (g + "same", 302, g + "a", None)]
    hops += [(g + f"n{i}", 302, g + f"n{i + 1}", None) for i in range(5)] + [(g + "n5", 302, None, None), *hops]
    hop = spark.createDataFrame(hops, "url string, status int, location string, html string")
    got = {r.url.removeprefix(g): (r.to or r.error, r.redirects) for r in original.chains(hop).collect()}
    assert got["twice"] == ("https://c.com/", 2) and got["b"] == ("https://c.com/", 1) and got["same"] == ("too_many_redirects", 6)
    assert got["n0"] == ("redirect_without_location", 5) and len(got) == 11


def quick(**k):
    return calls.CallPolicy(**{"pause": 0.0, "timeout": 2.0} | k)


def test_calls_fall_back_and_try_again():
    seen = []

    def flaky(t):
        seen.append(t)
        if len(seen) < 3:
            raise ConnectionError("reset")
        return "late"

    wait = []
    assert calls.answered([flaky], "x", quick(pause=1.0), wait.append) == ("late", None, 3, 0) and wait == [1.0, 2.0]
    assert calls.answered([lambda t: None, lambda t: "second"], "x", quick()) == ("second", None, 1, 1)

    def broken(t):
        raise ValueError("no such model")

    assert calls.answered([broken, lambda t: "never asked"], "x", quick(attempts=2), wait.append)[:3] == (None, "ValueError: no such model", 2)
    assert calls.answered([], "x", quick()) == (None, "no caller", 0, None)
    began = time.time()
    got = calls.answered([lambda t: time.sleep(30)], "x", quick(timeout=0.2, attempts=2), wait.append)
    assert got[1] == "TimeoutError: no answer within 0.2 s" and time.time() - began < 5
    with pytest.raises(ValueError):
        calls.CallPolicy(concurrency=0)


def test_calls_keep_order_and_bound():
    now, most, lock = 0, 0, threading.Lock()

    def work(t):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.05 if t % 3 else 0.01)
        with lock:
            now -= 1
        return (t,)

    began = time.time()
    assert list(calls.in_order(iter(range(40)), work, 8)) == [(t,) for t in range(40)]
    assert most <= 8 and time.time() - began < 40 * 0.05


def test_calls_over_rows(spark):
    def scorer(text):
        if text == "slow":
            time.sleep(20)
        if text == "bad":
            raise RuntimeError("malformed")
        return "" if text == "empty" else text.upper()

    rows = [("a", "one"), ("b", "slow"), ("c", "bad"), ("d", "empty"), ("e", None), ("f", "two"), ("f", "two")]
    df = spark.createDataFrame(rows, "id string, prompt string").coalesce(1)
    got = [tuple(r) for r in calls.called(df, [scorer], policy=quick(timeout=0.5, attempts=2, concurrency=3)).collect()]
    assert [g[0] for g in got] == [r[0] for r in rows]
    assert [g[1] for g in got] == ["ONE", None, None, None, None, "TWO", "TWO"]
    assert [g[2] for g in got][1:5] == ["TimeoutError: no answer within 0.5 s", "RuntimeError: malformed", "empty answer", "no prompt"] and [g[3] for g in got] == [1, 2, 2, 2, 0, 1, 1]
