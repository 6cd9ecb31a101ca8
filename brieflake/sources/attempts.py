"""Sources that are asked in several ways: the first attempt that settles the matter, and the messages of channel pages.

Attempts are a table, a row for each way that was tried, in an order.  An attempt
either settles its source or is passed over for the next one; which it does is a
condition on the row, so each chain is one aggregate, partly done before its shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..ship import ship

#: The answer of a listing that refuses to be read by programs.
BLOCKED = 403


def mirror_failed(status: Column) -> Column:
    """A mirror is passed over when it gave no answer or an error; one that answers settles, messages or none."""
    return F.coalesce(status >= 400, F.lit(True))


def listing_open(kind: Column, status: Column, found: Column) -> Column:
    """Of page, json and feed: a page without posts is passed over for the listing, a blocked listing for the feed."""
    return F.when(kind == "page", F.coalesce(found, F.lit(0)) == 0).when(kind == "json", F.coalesce(status == BLOCKED, F.lit(False))).otherwise(False)


def settled(attempts: DataFrame, key: str, place: str, passed_over: Column) -> DataFrame:
    """For each ``key`` the first attempt by ``place`` that isn't passed over, and failed = false; without one the last attempt, and failed = true.

    A condition that is null counts as passed over, attempts without a place go.
    Places of one key should differ; of equal ones either may be taken.
    """
    row = F.struct(*[c for c in attempts.columns if c != key])
    at = F.when(~F.coalesce(passed_over, F.lit(True)), F.col(place))
    a = attempts.where(F.col(place).isNotNull()).groupBy(key).agg(F.min_by(row, at).alias("_won"), F.max_by(row, F.col(place)).alias("_last"))
    return a.select(key, F.coalesce("_won", "_last").alias("_r"), F.col("_won").isNull().alias("failed")).select(key, "_r.*", "failed")


class _Messages(HTMLParser):
    """Messages of a channel's page in page order: id, at, text and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.depth, self.within = 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        now = self.found[-1] if self.found else None
        if tag == "div":
            self.depth += 1
            names = set((a.get("class") or "").split())
            # The names by which such pages mark messages and their texts.
            if "tgme_widget_message" in names and a.get("data-post"):
                self.found.append({"id": a["data-post"].rpartition("/")[2], "at": None, "text": None, "links": []})
                self.within = None
            elif now is not None and now["text"] is None and names >= {"tgme_widget_message_text", "js-message_text"}:
                now["text"], self.within = "", self.depth
        elif now is not None and tag == "time" and now["at"] is None:
            now["at"] = a.get("datetime") or None
        elif self.within is not None and tag == "br":
            now["text"] += "\n"
        elif self.within is not None and tag == "a" and (a.get("href") or "").startswith("http"):
            now["links"].append(a["href"])

    def handle_endtag(self, tag: str) -> None:
        if tag == "div":
            if self.within == self.depth:
                self.within = None
            self.depth = max(self.depth - 1, 0)

    def handle_data(self, data: str) -> None:
        if self.within is not None:
            self.found[-1]["text"] += data


def messages(html: str | None) -> list[dict]:
    p = _Messages()
    p.feed(html or "")
    p.close()
    return p.found


def channel_rows(pages: DataFrame) -> DataFrame:
    """(channel, message_id, at, text, links) of the messages on pages (channel, html), as adapters.channel_messages reads them.

    Messages without a numeric id, a date that can be read, or a text are left out;
    null and empty pages have none.
    """
    ship(pages.sparkSession)
    kinds = pa.schema([("channel", pa.string()), ("id", pa.string()), ("at", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"channel": c, **m} for c, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in messages(h)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    m = pages.select(F.col("channel").cast("string"), F.col("html").cast("string")).mapInArrow(run, "channel string, id string, at string, text string, links array<string>")
    m = m.select("channel", F.expr("try_cast(id as bigint)").alias("message_id"), text.parsed_date(F.col("at")).alias("at"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"), "links")
    return m.where("message_id is not null and at is not null and text <> ''")
