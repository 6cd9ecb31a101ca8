"""Main text of web pages by wrapper induction.

Operator 12.  Pages are read as trees of block elements (module ``dom``).  The
TEMPLATES commonest shapes of a host are its templates; each page's shape is laid on
the one it matches best by simple tree matching, and every block of text belongs to
the slot of the template that it stands in, or that its nearest matched ancestor
stands in.  Over a host's pages a slot's texts are counted: slots that say the same
on nearly all pages are template, what varies is content, and a slot that takes few
values (menus and adverts dealt from a pool) weighs little.  The content region is
the element under which nearly all of that weight lies, or the article or main
element around it; of the region all blocks are kept but those that elements named
as menus, headers, footers, sidebars, notices, adverts, forms or comments hold,
lists of links, and blocks that nearly all of the host's pages repeat.

Pages come in twice: their shapes, and their blocks with slots, which are written.
Counts are one row for each slot, or each block of one page of a template, and
partial sums meet in each task, so a host that holds a third of all pages costs no
task more.  Templates are one row for each host; they go along with a join that
broadcasts them only if they are small.

Where repeated pages would make a host's articles look like template (more than half
of a region would go), repetition is not held against them.  Pages of a host with
fewer than SURE different pages, and pages that match no template, are judged by names
and weight alone.

Null or empty pages have the text "".  Pages without a host, or without a url, form a
group of their own.  White space inside a block becomes one space, blocks are parted
by a line feed; cells of a table row are one block.  Character references are decoded
once.  Pages of any length are whole; elements deeper than dom.DEEPEST part blocks
without slots of their own.  Rows may repeat.  A null page_id is kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import dom
from .split import forget
from .store import Scratch, arrow, limit_batches, table, written

#: Templates of a host, different pages from which repetition counts, the share of pages that makes a text template, and how alike shapes must be.
TEMPLATES, SURE, SHARE, ALIKE = 4, 5, 0.9, 0.5
#: The share of the varying text that the content region holds, and the share of linked text that makes a list a menu.
REGION, LINKED = 0.8, 0.8
#: Bytes of templates and wrappers that are broadcast at most.
SMALL = 32 << 20

_SHAPE = "struct<kinds:array<string>,parents:array<int>,off:array<boolean>>"


def host(url: Column) -> Column:
    """The host of a url, lower case, "" if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _shape(x: dict | None) -> dom.Shape | None:
    return dom.Shape(tuple(x["kinds"]), tuple(x["parents"]), tuple(x["off"])) if x else None


def region(shape: dom.Shape, weight: list[float]) -> int:
    """The slot that holds nearly all weight, or the article or main element around it."""
    total = list(weight)
    for i in range(len(total) - 1, 0, -1):  # parents come before their children
        total[shape.parents[i]] += total[i]
    at, inner = 0, dom._children(shape)
    while total[0] > 0:
        best = max(inner[at], key=lambda c: (total[c], -c), default=None)
        if best is None or total[best] < REGION * total[at] or shape.kinds[best].split(".")[0] in dom.TEXT_BLOCKS:
            break
        at = best
    up, outer = at, None
    while up > 0:
        tag = shape.kinds[up].split(".")[0]
        if tag == "article" or (tag == "main" and outer is None):
            outer = up
        up = shape.parents[up]
    return outer if outer is not None else at


def wrapper(shape: dom.Shape, chars: list[float], linked: list[float], novelty: list[float], constant: list[bool]) -> list[int]:
    """The slots whose blocks are content.

    chars, linked: characters of each slot's own blocks and those in links;
    novelty: how many of its values are different ones, 1 at most; constant: slots that say the same everywhere.
    """
    n = len(shape.kinds)

    def closed(off: list[bool]) -> list[bool]:
        out = list(off)
        for i in range(1, n):
            out[i] = out[i] or out[shape.parents[i]]
        return out

    def lists_of_links() -> list[bool]:
        c, l = list(chars), list(linked)
        for i in range(n - 1, 0, -1):
            c[shape.parents[i]] += c[i]
            l[shape.parents[i]] += l[i]
        return [shape.kinds[i].split(".")[0] in ("ul", "ol", "dl", "div", "section", "table") and l[i] > 0 and l[i] >= LINKED * c[i] for i in range(n)]

    menus = lists_of_links()
    for off in (closed([a or b for a, b in zip(shape.off, menus, strict=True)]), closed([k.split(".")[0] in dom.ELEMENTS_OFF for k in shape.kinds])):
        weight = [0.0 if off[i] or constant[i] else chars[i] * novelty[i] for i in range(n)]
        if not any(weight):
            weight = [0.0 if off[i] else chars[i] for i in range(n)]
        if any(weight):
            break
    at = region(shape, weight)
    inside = [False] * n
    inside[at] = True
    for i in range(at + 1, n):
        inside[i] = inside[shape.parents[i]]
    kept = [i for i in range(n) if inside[i] and not off[i]]
    # what all pages say goes, unless that is most of the region
    varying = [i for i in kept if not constant[i]]
    return varying if sum(chars[i] for i in varying) > 0.5 * sum(chars[i] for i in kept) else kept


@lru_cache(maxsize=4096)
def _laid(shape: dom.Shape, templates: tuple[dom.Shape, ...]) -> tuple[int, list[int]]:
    """Which template a shape matches best, -1 if none well, and the template's slot for each of its slots (its nearest matched ancestor's, if it has none)."""
    best, which, at = 0.0, -1, list(range(len(shape.kinds)))
    for t, other in enumerate(templates):
        n, slots = dom.matched(shape, other)
        alike = 2 * n / (len(shape.kinds) + len(other.kinds))
        if alike >= ALIKE and alike > best:
            best, which, at = alike, t, slots
    if which >= 0:
        at = list(at)
        for i in range(1, len(at)):
            at[i] = at[i] if at[i] >= 0 else at[shape.parents[i]]
    return which, at


def _sums(shape: dom.Shape, slots: list[int], blocks: list[dom.Block]) -> tuple[list[float], list[float]]:
    chars, linked = [0.0] * len(shape.kinds), [0.0] * len(shape.kinds)
    for s, b in zip(slots, blocks, strict=True):
        chars[s] += len(b.text)
        linked[s] += b.linked
    return chars, linked


def _shapes(rows: DataFrame) -> DataFrame:
    """(host, shape) of each page that has text."""
    kinds = pa.schema([("host", pa.string()), ("shape", pa.struct([("kinds", pa.list_(pa.string())), ("parents", pa.list_(pa.int32())), ("off", pa.list_(pa.bool_()))]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            count: dict[tuple, int] = {}
            for h, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                root, _ = dom.parsed(page.as_py() or "")
                s = dom.folded(root)
                count[h, s] = count.get((h, s), 0) + 1
            yield pa.RecordBatch.from_pylist([{"host": h, "shape": {"kinds": s.kinds, "parents": s.parents, "off": s.off}} for (h, s), n in count.items() for _ in range(n)], schema=kinds)

    return arrow(rows.select("host", "html"), run, f"host string, shape {_SHAPE}")


def templates(rows: DataFrame) -> DataFrame:
    """(host, shapes): the commonest shapes of each host."""
    named = _shapes(rows).withColumn("name", F.sha2(F.to_json("shape"), 256))
    count = named.groupBy("host", "name").agg(F.count("*").alias("n"), F.first("shape").alias("shape"))
    # the best of each host so far is all that a task keeps of it
    few = count.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "name"))).where(F.col("place") <= TEMPLATES)
    return few.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "shape"))).alias("s")).select("host", F.col("s.shape").alias("shapes"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few bytes by count of their JSON; else left to a shuffle."""
    size = df.select(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL else df


_BLOCK = "struct<slot:int,text:string,hash:long>"
_SLOT = "struct<slot:int,chars:long,linked:long,hash:long>"


def _hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _slotted(rows: DataFrame) -> DataFrame:
    """rows (page_id, url, host, html, shapes) with template (number or null), blocks, and sums by slot; blocks of pages without a template are content already."""
    out = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("template", pa.int32()), ("same", pa.int64()),
        ("blocks", pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string()), ("hash", pa.int64())]))),
        ("slots", pa.list_(pa.struct([("slot", pa.int32()), ("chars", pa.int64()), ("linked", pa.int64()), ("hash", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        cached = lru_cache(maxsize=256)(lambda key: tuple(map(_shape, key.as_py() or ())))
        for b in batches:
            got = []
            for i in range(b.num_rows):
                root, blocks = dom.parsed(b.column(3)[i].as_py() or "")
                shape = dom.folded(root)
                t, at = _laid(shape, cached(b.column(4)[i]))
                slots = [at[x.node.slot] for x in blocks]
                same = _hashed("\n".join(x.text for x in blocks))
                if t < 0:
                    chars, linked = _sums(shape, slots, blocks)
                    keep = set(wrapper(shape, chars, linked, [1.0] * len(chars), [False] * len(chars)))
                    told = [{"slot": 0, "text": x.text, "hash": 0} for s, x in zip(slots, blocks, strict=True) if s in keep]
                    by_slot: dict[int, list] = {}
                else:
                    told, by_slot = [], {}
                    for s, x in zip(slots, blocks, strict=True):
                        h = _hashed(x.text)
                        told.append({"slot": s, "text": x.text, "hash": h})
                        v = by_slot.setdefault(s, [0, 0, 0])
                        v[0], v[1], v[2] = v[0] + len(x.text), v[1] + x.linked, (v[2] * 31 + h) % (1 << 63)
                got.append({
                    "page_id": b.column(0)[i].as_py(), "url": b.column(1)[i].as_py(), "host": b.column(2)[i].as_py(), "template": t if t >= 0 else None, "same": same, "blocks": told,
                    "slots": [{"slot": s, "chars": c, "linked": k, "hash": h} for s, (c, k, h) in by_slot.items()],
                })
            yield pa.RecordBatch.from_pylist(got, schema=out)

    return arrow(rows.select("page_id", "url", "host", "html", "shapes"), run, f"page_id long, url string, host string, template int, same long, blocks array<{_BLOCK}>, slots array<{_SLOT}>")


@F.pandas_udf(ArrayType(IntegerType()))
def _content(shapes: pd.Series, template: pd.Series, stats: pd.Series, pages: pd.Series) -> pd.Series:
    out = []
    for shape, t, rows, n in zip(shapes, template, stats, pages, strict=True):
        s = _shape(shape[t])
        size = len(s.kinds)
        chars, linked, novelty, constant = [0.0] * size, [0.0] * size, [1.0] * size, [False] * size
        for r in rows:
            i = r["slot"]
            chars[i], linked[i] = float(r["chars"]), float(r["linked"])
            if n >= SURE:
                novelty[i] = min(1.0, r["values"] / max(1, r["n"]))
                constant[i] = r["common"] >= SHARE * n
        out.append(np.array(wrapper(s, chars, linked, novelty, constant), dtype=np.int32))
    return pd.Series(out)


def wrappers(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(host, template, content, repeated): the content slots of each template, and the texts (slot, hash) in them that nearly all pages repeat."""
    key = ["host", "template"]
    p = pages.where("template is not null")
    many = p.groupBy(*key).agg(F.approx_count_distinct("same", 0.02).alias("pages"), F.count("*").alias("rows"), F.min_by("blocks", F.struct("same", "page_id", "url")).alias("one"), F.min_by("slots", F.struct("same", "page_id", "url")).alias("own"))
    many = many.withColumn("pages", F.least("pages", "rows"))
    slots = p.select(*key, F.inline("slots")).groupBy(*key, "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.count("*").alias("n"), F.approx_count_distinct("hash", 0.02).alias("values"))
    # a text that nearly all pages say is said by the template's first page too, but for a share that tests bound
    one = many.select(*key, F.transform("one", lambda x: F.struct(x["slot"].alias("slot"), x["hash"].alias("hash"))).alias("texts"), F.transform("own", lambda x: F.struct(x["slot"].alias("slot"), x["hash"].alias("hash"))).alias("whole"))
    seen = p.join(_small(one), key)
    pair = lambda c: F.transform(c, lambda x: F.struct(x["slot"].alias("slot"), x["hash"].alias("hash")))
    common = seen.select(*key, F.inline(F.array_intersect(pair("slots"), "whole"))).groupBy(*key, "slot").agg(F.count("*").alias("common"))
    texts = seen.select(*key, F.inline(F.array_intersect(pair("blocks"), "texts"))).groupBy(*key, "slot", "hash").agg(F.count("*").alias("said"))
    stats = slots.join(common, [*key, "slot"], "left").groupBy(*key).agg(F.collect_list(F.struct("slot", "chars", "linked", "n", "values", F.coalesce("common", F.lit(0)).alias("common"))).alias("stats"))
    repeated = texts.join(many.select(*key, "pages", "rows"), key).where((F.col("pages") >= SURE) & (F.col("said") >= SHARE * F.col("rows"))).groupBy(*key).agg(F.collect_list(F.struct("slot", "hash")).alias("repeated"))
    w = many.select(*key, "pages", "rows").join(stats, key).join(known, "host").withColumn("n", F.when(F.col("pages") >= SURE, F.col("rows")).otherwise(0))
    return w.select(*key, _content("shapes", "template", "stats", "n").alias("content")).join(repeated, key, "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    spark = pages.sparkSession
    limit_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), "html")
    with Scratch(spark) as to:
        known = to.keep(templates(rows), "templates")
        slotted = to.keep(_slotted(rows.join(_small(known), "host", "left")), "page-blocks", "zstd")
        made = to.keep(wrappers(slotted, known), "wrappers")
        p = slotted.join(_small(made), ["host", "template"], "left")
        none = F.expr("cast(array() as array<struct<slot:int,hash:long>>)")
        mine = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda x: F.array_contains("content", x["slot"])))
        p = p.select("page_id", "url", mine.alias("mine"), F.coalesce("repeated", none).alias("repeated"))
        fresh = F.filter("mine", lambda x: ~F.array_contains("repeated", F.struct(x["slot"].alias("slot"), x["hash"].alias("hash"))))
        size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
        p = p.withColumn("fresh", fresh).withColumn("mine", F.when(2 * size("fresh") > size("mine"), F.col("fresh")).otherwise(F.col("mine")))
        text = F.array_join(F.transform("mine", lambda x: x["text"]), "\n")
        return written(p.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars")), "main-texts", "zstd")


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
