"""Gives Python workers this package, once for each application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="brieflake-")) / "brieflake.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a session on one machine that names none gets a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = "file://" + tempfile.mkdtemp(prefix="brieflake-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()
