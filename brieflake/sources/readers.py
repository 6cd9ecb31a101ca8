"""Sources as DataFrames: files of feeds, JSON answers and list pages become items, failures become rows.

Files are read by Spark's binaryFile source, so every store that Spark reads
will do; each file is parsed in its own place by an Arrow function, and one that
can't be parsed gives a row with its error instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text
from ..ship import ship
from . import parsers

_COLUMNS = (*parsers.RECORD, "media_type")
RAW = "file string, ord int, error string, " + ", ".join(f"{c} string" for c in _COLUMNS)


def parsed(adapter: str, data: bytes, base: str, options: dict[str, str]) -> list[dict]:
    if adapter == "rss":
        return list(parsers.parse_feed(data))
    if adapter == "json_api":
        return list(parsers.parse_json_api(data, options))
    if adapter == "html_list":
        return list(parsers.parse_html_list(data, base, options))
    if adapter == "document_index":
        return list(parsers.parse_document_index(data, base, options))
    raise ValueError(f"unknown adapter: {adapter}")


def raw_records(spark: SparkSession, path: str, adapter: str, base: str = "", options: dict[str, str] | None = None) -> DataFrame:
    """Raw records of the files at ``path``, with file and place; a file that fails gives one row with its error."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    opts = dict(options or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [{"file": name, "ord": i, "error": None, "media_type": None, **r} for i, r in enumerate(parsed(adapter, data, base, opts))]
                except Exception as e:  # whatever a source sends, it fails alone
                    out.append({"file": name, "ord": 0, "error": f"{type(e).__name__}: {e}"[:500]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("ord", pa.int32()), ("error", pa.string()), *((c, pa.string()) for c in _COLUMNS)]))

    return files.mapInArrow(run, RAW)


def items(raw: DataFrame, source_id: str, since: str | None = None, until: str | None = None, max_chars: int = text.DEFAULT_CHARS) -> DataFrame:
    """Items of one source: title, bounded content, parsed date, ids; closed window; records without title, address or date are left out."""
    at = text.parsed_date(F.col("published"))
    i = raw.where("error is null and title is not null and url is not null").select(
        F.concat_ws(":", F.lit("food"), F.lit(source_id), text.native_id(F.coalesce("native_id", "url"))).alias("id"), F.lit(source_id).alias("source_id"), text.collapsed(F.col("title")).alias("title"), "url", at.alias("published_at"), text.bounded(F.col("content"), max_chars).alias("content"), "author", "media_type", "file", "ord",
    )
    i = i.where("published_at is not null")
    if since is not None:
        i = i.where(F.col("published_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        i = i.where(F.col("published_at") <= F.lit(until).cast("timestamp"))
    return i


def outcome(raw: DataFrame, kept: DataFrame, source_id: str) -> DataFrame:
    """The source's outcome row: status, candidates, items, the share of records whose date was read."""
    a = raw.agg(F.count_if(F.col("error").isNull()).alias("candidate_count"), F.max("error").alias("error"), F.count_if(F.col("error").isNull() & text.parsed_date(F.col("published")).isNotNull()).alias("dated"))
    k = kept.agg(F.count("*").alias("item_count"))
    rate = F.coalesce(F.try_divide("dated", "candidate_count"), F.lit(1.0))
    status = F.when(F.col("error").isNotNull() & (F.col("candidate_count") == 0), "failure").when(F.col("item_count") == 0, "empty").otherwise("success")
    return a.join(k).select(F.lit(source_id).alias("source_id"), status.alias("status"), "candidate_count", "item_count", F.round(rate, 6).alias("parse_rate"), "error")


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """A bag union in the order of sources: ``task`` is the source's place; with file and ord it orders the rows."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("task", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def discovered(parts: list[DataFrame], most: int = 12) -> DataFrame:
    """Rows of several providers, the first of each address and title (case folded), at most ``most``."""
    u = union_in_order(parts).withColumn("_key", F.struct("task", "file", "ord")).withColumn("_title", F.lower("title"))
    rest = [c for c in u.columns if c not in ("url", "_title", "_key")]
    first = u.groupBy("url", "_title").agg(F.min_by(F.struct("_key", *rest), "_key").alias("r"))
    return first.select("url", "r.*").orderBy("_key").limit(most).drop("_key")


def source_packs(spark: SparkSession, path: str) -> DataFrame:
    """Source specifications of the pack files (JSON documents with an array ``sources``), one row for each mention, in file and array order."""
    schema = "id string, sources array<struct<id:string,adapter:string,collection_tier:string,url:string,enabled:boolean,packs:array<string>>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    x = p.select(F.col("id").alias("pack"), "file", F.posexplode("sources").alias("pos", "s"))
    return x.select("s.id", "s.adapter", F.col("s.collection_tier").alias("tier"), "s.url", F.coalesce("s.packs", F.array("pack")).alias("packs"), F.struct("file", "pos").alias("seq"))


def unknown_sources(asked: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the asked source ids those that are known, and those that aren't."""
    return asked.join(known.select("source_id"), "source_id", "left_semi"), asked.join(known.select("source_id"), "source_id", "left_anti")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id and the main text of each page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parsers.article_text(h) for h in b.column(1).to_pylist()], pa.string())], names=["page_id", "content"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, content string")


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.options["path"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _rows(partition.value, self.options)


def _store(path: str) -> tuple:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _rows(name: str, options: dict[str, str]) -> Iterator[tuple]:
    fs, path = _store(name)
    with fs.open_input_stream(path) as f:
        data = f.read()
    for i, r in enumerate(parsed(options.get("adapter", "rss"), data, options.get("base", ""), options)):
        yield tuple([name, i, None] + [r.get(c) for c in _COLUMNS])


class _StreamReader(DataSourceStreamReader):
    """The files of folders as they come, a partition for each.

    An offset is the time of change and the name of the last file that was read, so
    it stays as small as it is, and what lies between two offsets is the same files
    whenever it is read again.  For that a file must not change once it is there, nor
    come with a time before those already read; ``settle`` (seconds, 1 unless given)
    holds files back until others of their time are there too.  A file that can't be
    read gives one row with its error.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.last = options, (0, "")

    def _files(self) -> list[tuple[int, str]]:
        import time

        import pyarrow.fs

        before = time.time_ns() - int(float(self.options.get("settle", "1")) * 1e9)
        out = []
        for folder in self.options["path"].split(","):
            fs, path = _store(folder)
            lead = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
            out += [(f.mtime_ns, lead + f.path) for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and f.mtime_ns <= before]
        return out

    def initialOffset(self) -> dict:
        return {"at": 0, "file": ""}

    def latestOffset(self) -> dict:
        self.last = max([self.last, *self._files()])
        return {"at": self.last[0], "file": self.last[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        u, v = ((x["at"], x["file"]) for x in (start, end))
        return [_Part(f) for at, f in sorted(self._files()) if u < (at, f) <= v]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            rows = list(_rows(partition.value, self.options))
        except Exception as e:  # whatever a source sends, it fails alone
            rows = [(partition.value, 0, f"{type(e).__name__}: {e}"[:500], *[None] * len(_COLUMNS))]
        yield from rows


class ItemFeed(DataSource):
    """spark.read.format("brieflake_feed").option("adapter", ...).option("path", "a,b").load(): one partition for each file; with readStream the paths are folders, read as files come."""

    @classmethod
    def name(cls) -> str:
        return "brieflake_feed"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return _StreamReader(dict(self.options))
