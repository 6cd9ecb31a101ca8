"""Staged service, command line and schedule: each call loads a stage, works on it, writes the next."""

from __future__ import annotations

import argparse
import contextlib
import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, merge, metrics, windows
from .runs import RunStore

PAGE = 500


class ServiceError(Exception):
    """A refusal with a code that callers can act on."""

    def __init__(self, code: str, message: str, **details: object):
        super().__init__(message)
        self.code, self.details = code, details


def enveloped(call: Callable[[], object]) -> dict:
    """What a call gives, or its error, with how long it took; never an exception."""
    began = time.perf_counter()
    try:
        body = {"ok": True, "data": call()}
    except ServiceError as e:
        body = {"ok": False, "error": {"code": e.code, "message": str(e), "details": e.details}}
    except Exception as e:  # the envelope is the boundary
        body = {"ok": False, "error": {"code": "internal", "message": f"{type(e).__name__}: {e}", "details": {}}}
    return body | {"seconds": round(time.perf_counter() - began, 3)}


class Service:
    """fetch -> score -> filter -> enrich over a stage store.  Scorers and enrichers are functions of DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = RunStore(spark, root)

    def _need(self, run_id: str, stage: str) -> DataFrame:
        if stage not in self.store.completed(run_id):
            raise ServiceError("stage_missing", f"run {run_id} has no stage {stage}", stage=stage)
        return self.store.load(run_id, stage)

    def fetch(self, run_id: str, raw: DataFrame, since: str, config: object = None) -> int:
        self.store.start(run_id, config)
        self.store.commit(run_id, "raw", windows.since_only(raw, since))
        self.store.commit(run_id, "normalized", merge.merge_by_url(self.store.load(run_id, "raw")).drop("published_at"))
        return self.store.counts(run_id)["normalized"]

    def score(self, run_id: str, scorer: Callable[[DataFrame], DataFrame]) -> dict:
        self.store.commit(run_id, "scored", scorer(self._need(run_id, "normalized")))
        return metrics.score_distribution(self.store.load(run_id, "scored")).first().asDict()

    def filter(self, run_id: str, threshold: float, groups: dict[str, tuple[list[str], int]], default_limit: int, cap: int | None = None) -> int:
        kept = digest.balanced_digest(windows.above_threshold(self._need(run_id, "scored"), threshold), groups, default_limit, cap)
        return self.store.commit(run_id, "filtered", kept).count()

    def enrich(self, run_id: str, enricher: Callable[[DataFrame], DataFrame]) -> int:
        kept = self._need(run_id, "filtered")
        return self.store.commit(run_id, "enriched", kept if kept.isEmpty() else enricher(kept)).count()

    def page(self, run_id: str, stage: str, limit: int = 50) -> dict:
        """Up to ``limit`` rows of a stage, and whether there are more."""
        if not 0 < limit <= PAGE:
            raise ServiceError("bad_limit", f"the limit is 1 to {PAGE}", limit=limit)
        rows = self._need(run_id, stage).limit(limit + 1).collect()
        return {"rows": [r.asDict(recursive=True) for r in rows[:limit]], "truncated": len(rows) > limit}


def run_metrics(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Source metrics of all manifests that a path pattern names (JSON documents with an array ``source_metrics`` of the given struct)."""
    m = spark.read.schema(f"run_id string, source_metrics array<struct<{schema}>>").option("multiLine", True).json(pattern)
    return m.select("run_id", F.explode("source_metrics").alias("m")).select("run_id", "m.*")


def preset_sources(presets: DataFrame) -> DataFrame:
    """(domain, source) rows of a preset document (domains: array of id and sources), with a key that names each source once."""
    d = presets.select(F.explode("domains").alias("d")).select(F.col("d.id").alias("domain"), F.posexplode("d.sources").alias("pos", "s"))
    return d.select("domain", "pos", F.col("s.type").alias("type"), F.col("s.config").alias("config"), source_key(F.col("s.type"), F.col("s.config")).alias("source_key"))


def source_key(kind, config):  # noqa: ANN001, ANN201
    """A source's identity: its type and the part of its configuration (a map) that names it."""
    at = lambda k: F.coalesce(F.try_element_at(config, F.lit(k)), F.lit(""))
    named = {"rss": ("rss", at("url")), "reddit_subreddit": ("reddit", at("subreddit")), "reddit_user": ("reddit_user", at("username")), "github_user": ("github_user", at("username")), "github_repo": ("github_repo", F.concat(at("owner"), F.lit("/"), at("repo"))), "telegram": ("telegram", at("channel"))}
    out = F.concat(kind, F.lit(":"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config)))))
    for k, (prefix, value) in named.items():
        out = F.when(kind == k, F.concat(F.lit(f"{prefix}:"), value)).otherwise(out)
    return out


def access_mode(options):  # noqa: ANN001, ANN201
    """How a source may be read: what its options (a map) say, else metadata only, paywall or log-in by its retention and notes, else direct."""
    at = lambda k: F.nullif(F.try_element_at(options, F.lit(k)), F.lit(""))
    note = F.coalesce(at("trial_note"), F.lit(""))
    return F.coalesce(at("access_mode"), F.when(at("retention_mode") == "metadata_only", "metadata_only").when(F.contains(note, F.lit("付费")), "paywall").when(F.contains(note, F.lit("登录")) | F.contains(note, F.lit("注册")), "login_required").otherwise("direct_metadata"))


def look_back(read: Callable[[str, str], DataFrame], sources: DataFrame, until: str, hours: tuple[int, ...] = (72, 168)) -> Iterator[tuple[int, DataFrame]]:
    """Reads sources that gave nothing again with longer windows, until each has given something or the windows end."""
    end = datetime.fromisoformat(until)
    left = sources
    for h in hours:
        if left.isEmpty():
            return
        got = read((end - timedelta(hours=h)).isoformat(), until).join(left, "source_id", "left_semi")
        yield h, got
        left = left.join(got.select("source_id").distinct(), "source_id", "left_anti")


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, z = span.partition("-")
        first, last = (low, high) if span == "*" else (int(a), int(z or (high if step else a)))
        if not low <= first <= last <= high:
            raise ValueError(f"bad schedule field {text!r}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


def next_due(cron: str, zone: str, after: datetime, back: bool = False) -> datetime:
    """The next (or last) time that a five-field schedule names in a zone.  Wall-clock minutes that a change of clocks leaves out don't occur."""
    minutes, hours, days, months, weekdays = (_field(t, *r) for t, r in zip(cron.split(), ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    if after.tzinfo is None:
        raise ValueError("the time needs an offset")
    any_day, any_week = cron.split()[2] == "*", cron.split()[4] == "*"
    week = {w % 7 for w in weekdays}
    at = after.astimezone(timezone.utc).replace(second=0, microsecond=0) + timedelta(minutes=0 if back and (after.second or after.microsecond) else -1 if back else 1)
    step = timedelta(minutes=-1 if back else 1)
    for _ in range(366 * 5 * 24):
        local = at.astimezone(ZoneInfo(zone))
        by_day, by_week = local.day in days, local.isoweekday() % 7 in week
        fits = by_day and by_week if any_day or any_week else by_day or by_week
        hour = (local.hour, local.date())
        if not (fits and local.month in months and local.hour in hours):
            at += timedelta(minutes=-(local.minute + 1) if back else 60 - local.minute)  # on to the next hour
            continue
        while (local.hour, local.date()) == hour:
            if local.minute in minutes:
                return local
            at += step
            local = at.astimezone(ZoneInfo(zone))
    raise ValueError(f"{cron!r} names no time within five years")


@contextlib.contextmanager
def only_run(path: str) -> Iterator[None]:
    """Holds the run lock; exits with code 75 if another process has it."""
    import fcntl

    f = os.open(path, os.O_CREAT | os.O_RDWR)
    try:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
    except BlockingIOError:
        os.close(f)
        raise SystemExit(75) from None
    try:
        yield
    finally:
        os.close(f)


def arguments(argv: list[str]) -> argparse.Namespace:
    """The command line, with the combinations that make no sense refused."""
    p = argparse.ArgumentParser(prog="brieflake")
    p.add_argument("--hours", type=float)
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--no-deliver", action="store_true")
    for name in ("--resume", "--redeliver"):
        p.add_argument(name, metavar="RUN")
    for name in ("--daemon", "--scheduled", "--healthcheck"):
        p.add_argument(name, action="store_true")
    a = p.parse_args(argv)
    if sum(map(bool, (a.resume, a.redeliver, a.daemon, a.healthcheck))) > 1:
        p.error("give one of --resume, --redeliver, --daemon and --healthcheck")
    if a.hours is not None and (a.since or a.until) or bool(a.since) != bool(a.until):
        p.error("give --hours, or both --since and --until")
    if (a.resume or a.redeliver) and (a.hours is not None or a.since):
        p.error("a run that is taken up keeps its own window")
    if a.redeliver and a.no_deliver:
        p.error("--redeliver delivers")
    return a
