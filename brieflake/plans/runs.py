"""Stage store: snapshots in order, committed by a marker, with guards for resuming.

A run is a folder; a stage is Parquet in it, and counts only once its marker
(a one-row table, written last) is there.  Writing a stage again puts the same
rows in place.  Configuration is guarded by a hash of its canonical JSON.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STAGES

_SAFE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def fingerprint(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, run_id: str, *parts: str) -> str:
        if not all(_SAFE.fullmatch(p) and ".." not in p for p in (run_id, *parts)):
            raise ValueError("run and stage names are letters, digits, dots, dashes and underscores")
        return "/".join([self.root, run_id, *parts])

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def start(self, run_id: str, config: object) -> None:
        self.spark.createDataFrame([(fingerprint(config), canonical(config))], "config_hash string, config string").coalesce(1).write.mode("overwrite").json(self._path(run_id, "config"))

    def guard(self, run_id: str, config: object) -> None:
        """A run resumes only under the configuration it began with."""
        if self.spark.read.schema("config_hash string").json(self._path(run_id, "config")).first()["config_hash"] != fingerprint(config):
            raise ValueError(f"run {run_id} began with another configuration")

    def commit(self, run_id: str, stage: str, df: DataFrame) -> DataFrame:
        """Writes a stage, then its marker with the row count; returns what was written."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        path = self._path(run_id, stage)
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.agg(F.lit(stage).alias("stage"), F.count("*").alias("rows")).write.mode("overwrite").json(self._path(run_id, f"{stage}.done"))
        return back

    def completed(self, run_id: str) -> list[str]:
        """The stages that are done without a gap, in order."""
        out: list[str] = []
        for s in STAGES:
            if not self._exists(self._path(run_id, f"{s}.done")):
                break
            out.append(s)
        return out

    def load(self, run_id: str, stage: str) -> DataFrame:
        return self.spark.read.parquet(self._path(run_id, stage))

    def counts(self, run_id: str) -> dict[str, int]:
        return {s: self.spark.read.schema("stage string, rows long").json(self._path(run_id, f"{s}.done")).first()["rows"] for s in self.completed(run_id)}

    def run(self, run_id: str, config: object, stages: dict[str, Callable[[DataFrame | None], DataFrame]], resume: bool = False) -> DataFrame:
        """Runs the stages in their order; when resuming, those already done are read and not run."""
        if resume:
            self.guard(run_id, config)
        else:
            self.start(run_id, config)
        done = set(self.completed(run_id)) if resume else set()
        df: DataFrame | None = None
        for s in [s for s in STAGES if s in stages]:
            df = self.load(run_id, s) if s in done else self.commit(run_id, s, stages[s](df))
        if df is None:
            raise ValueError("no stages")
        return df
