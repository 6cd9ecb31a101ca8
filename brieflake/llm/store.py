"""Shared storage, checkpoints and session settings for the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..ship import checkpoint_dir, ship
from .split import give_back

#: Rows and bytes that an Arrow batch holds at most, so a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir."""
    return checkpoint_dir(spark)


def new_dir(spark: SparkSession, kind: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Shuffle files go when the execution that wrote them ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, kind: str, codec: str | None = None) -> DataFrame:
    """df, written as Parquet (by the session's codec, or the one given) under the shared folder and read back.  What comes back doesn't hang on df's inputs."""
    return _write(df, new_dir(df.sparkSession, kind), codec)


class Scratch:
    """Tables under the shared folder that an operator writes, reads and deletes.

    Each is Parquet in reliable storage, so a lost executor costs tasks and no
    tables.  ``drop`` deletes those whose last reader is done, ``close`` all.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, kind: str, codec: str | None = None) -> DataFrame:
        path = new_dir(self.spark, kind)
        self.paths[path] = None
        out = _write(df, path, codec)
        self.paths[path] = out
        return out

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        del self.paths[path]

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            self._delete(path)

    def close(self) -> None:
        for path in list(self.paths):
            self._delete(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def limit_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow, with this package on the workers."""
    ship(df.sparkSession)
    limit_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until docs has no such column (Spark's names don't tell cases apart)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def retexted(docs: DataFrame, change: Callable[..., pa.Array], *more: str) -> DataFrame:
    """docs with other texts where ``change`` (texts, and the columns ``more``) gives one that isn't null; n_chars follows, if docs has it.

    A scalar function: the other columns stay in the JVM, and only changed texts come back.
    """
    ship(docs.sparkSession)
    limit_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in more]
    f, (new_text,) = F.arrow_udf(change, StringType()).asNondeterministic(), free_names(docs, "_changed")
    out = docs.select(*(F.col(f"`{c}`") for c in names), f("text", *more).alias(new_text))
    text = F.coalesce(new_text, "text")
    new = {"text": text.alias("text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col(new_text).isNull(), F.col("n_chars")).otherwise(F.length(new_text).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return out.select(*(new.get(c, F.col(f"`{c}`")) for c in names))
