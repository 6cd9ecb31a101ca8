from __future__ import annotations

import json
import subprocess
import sys
from datetime import datetime, timezone

import pytest
from brieflake.plans import service
from pyspark.sql import functions as F


def test_stages_and_envelope(spark, tmp_path):
    s = service.Service(spark, str(tmp_path / "runs"))
    raw = spark.createDataFrame([(i, f"i{i}", "rss", f"t{i}", f"https://e.com/{i % 3}", "c" * i, None, datetime(2026, 7, 24)) for i in range(6)], "seq long, id string, source_type string, title string, url string, content string, metadata map<string,string>, published_at timestamp")
    assert s.fetch("r", raw, "2026-07-23 00:00:00") == 3
    assert s.score("r", lambda df: df.withColumn("ai_score", F.col("seq") * 2.0).withColumn("category", F.lit("x")))["b9_10"] == 1
    assert s.filter("r", 7.0, {}, 5) == 2 and s.enrich("r", lambda df: df.withColumn("note", F.lit("n"))) == 2
    page = s.page("r", "enriched", 1)
    assert len(page["rows"]) == 1 and page["truncated"]
    bad = service.enveloped(lambda: s.page("r", "summary"))
    assert not bad["ok"] and bad["error"]["code"] == "stage_missing"
    assert service.enveloped(lambda: s.page("r", "raw", 501))["error"]["code"] == "bad_limit" and service.enveloped(lambda: 1 / 0)["error"]["code"] == "internal"


def test_schedule():
    at = lambda *a: datetime(*a, tzinfo=timezone.utc)
    assert service.next_due("30 8 * * *", "Asia/Shanghai", at(2026, 7, 24)).astimezone(timezone.utc) == at(2026, 7, 24, 0, 30)
    assert service.next_due("30 8 * * *", "Asia/Shanghai", at(2026, 7, 24), back=True).astimezone(timezone.utc) == at(2026, 7, 23, 0, 30)
    assert service.next_due("0 9 * * 1-5", "Europe/Berlin", at(2026, 7, 24, 8)).isoformat() == "2026-07-27T09:00:00+02:00"
    assert service.next_due("30 2 * * *", "Europe/Berlin", at(2026, 3, 28, 12)).isoformat() == "2026-03-30T02:30:00+02:00"
    assert service.next_due("*/15 * * * *", "UTC", at(2026, 1, 1, 0, 1)) == at(2026, 1, 1, 0, 15)
    with pytest.raises(ValueError):
        service.next_due("61 * * * *", "UTC", at(2026, 1, 1))


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    code = f"import sys; sys.path.insert(0, {sys.path[0]!r}); from brieflake.plans.service import only_run\nwith only_run({path!r}): pass"
    with service.only_run(path):
        assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 75
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_command_line():
    assert service.arguments(["--hours", "24", "--no-deliver"]).hours == 24
    for bad in (["--since", "x"], ["--hours", "1", "--since", "a", "--until", "b"], ["--resume", "r", "--daemon"], ["--resume", "r", "--hours", "1"], ["--redeliver", "r", "--no-deliver"]):
        with pytest.raises(SystemExit):
            service.arguments(bad)


def test_dimensions(spark, tmp_path):
    df = spark.createDataFrame([("github_repo", {"owner": "o", "repo": "r"}), ("rss", {"url": "u"}), ("other", {"b": "2", "a": "1"})], "t string, c map<string,string>")
    assert [r[0] for r in df.select(service.source_key(F.col("t"), F.col("c"))).collect()] == ["github_repo:o/r", "rss:u", 'other:{"a":"1","b":"2"}']
    o = spark.createDataFrame([({"access_mode": "x"},), ({"retention_mode": "metadata_only"},), ({"trial_note": "需要登录"},), ({},), (None,)], "o map<string,string>")
    assert [r[0] for r in o.select(service.access_mode(F.col("o"))).collect()] == ["x", "metadata_only", "login_required", "direct_metadata", "direct_metadata"]
    for i in range(2):
        (tmp_path / f"run{i}").mkdir()
        (tmp_path / f"run{i}" / "manifest.json").write_text(json.dumps({"run_id": f"r{i}", "source_metrics": [{"source_id": "a", "n": i}]}))
    assert service.run_metrics(spark, f"{tmp_path}/*/manifest.json", "source_id:string,n:int").count() == 2
    (tmp_path / "p.json").write_text(json.dumps({"domains": [{"id": "d", "sources": [{"type": "rss", "config": {"url": "u"}}]}]}))
    presets = spark.read.schema("domains array<struct<id:string,sources:array<struct<type:string,config:map<string,string>>>>>").json(str(tmp_path / "p.json"))
    assert service.preset_sources(presets).first().source_key == "rss:u"


def test_look_back(spark):
    data = spark.createDataFrame([("a", "2026-07-21 12:00:00"), ("b", "2026-07-18 12:00:00")], "source_id string, at string")
    read = lambda since, until: data.where(F.col("at").between(since.replace("T", " "), until.replace("T", " ")))
    got = [(h, sorted(r.source_id for r in df.collect())) for h, df in service.look_back(read, spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string"), "2026-07-24T00:00:00")]
    assert got == [(72, ["a"]), (168, ["b"])]
