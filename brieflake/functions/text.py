"""Text bounding, dates, buckets and small codecs as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import let

DEFAULT_CHARS, MOST_CHARS = 1200, 4000


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bounded(text: Column, limit: int = DEFAULT_CHARS) -> Column:
    """White space collapsed, cut at the limit (never over MOST_CHARS), null if nothing is left."""
    return F.nullif(F.substring(collapsed(text), 1, min(limit, MOST_CHARS)), F.lit(""))


def shortened(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def stripped(html: Column) -> Column:
    """Tags dropped, the commonest entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return collapsed(t)


def html_title(html: Column) -> Column:
    return F.nullif(collapsed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def native_id(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def item_id(source: Column, native: Column) -> Column:
    return F.concat_ws(":", F.lit("food"), source, native)


def hash_bucket(value: Column, of: int) -> Column:
    """The 256-bit number that SHA-256 gives, modulo ``of``: its hex digits folded from the left."""
    digits = F.split(F.sha2(value, 256), "")
    number = lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + number(d)) % of)


def ordinal(day: Column) -> Column:
    """Days since the first of January of year one, counted from 1."""
    return F.datediff(day, F.lit("0001-01-01").cast("date")) + 1


def business_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def parsed_date(text: Column) -> Column:
    """The first of the known forms that fits: ISO with and without offset, RFC 822, Japanese, compact; without an offset it is UTC."""
    japanese = F.regexp_extract(text, r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日", 1)
    jp = F.when(japanese != "", F.try_to_timestamp(F.concat_ws("-", japanese, F.lpad(F.regexp_extract(text, r"年\s*(\d{1,2})月", 1), 2, "0"), F.lpad(F.regexp_extract(text, r"月\s*(\d{1,2})日", 1), 2, "0")), F.lit("yyyy-MM-dd")))
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"(GMT|UT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.try_to_timestamp(text), rfc, F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), jp)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def metric_signatures(text: Column) -> Column:
    """Numbers with a unit, like ``12.5%`` or ``3million``: distinct, sorted, units lower-cased, trailing zeros dropped."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^0-9.])([0-9]+(?:\.[0-9]+)?\s*(?:%|％|亿|万|千|trillion|billion|million|bn|mn))"), F.lit(1))

    def plain(x: Column) -> Column:
        number = F.regexp_extract(x, r"^([0-9.]+)", 1)
        number = F.when(F.instr(number, ".") > 0, F.regexp_replace(F.regexp_replace(number, r"0+$", ""), r"\.$", "")).otherwise(number)
        unit = F.regexp_replace(x, r"^[0-9.]+\s*", "")
        unit = F.when(unit == "％", "%").when(unit == "bn", "billion").when(unit == "mn", "million").otherwise(unit)
        return F.concat(number, unit)

    return F.sort_array(F.array_distinct(F.transform(found, plain)))


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def spaced_scripts(text: Column) -> Column:
    """A space between CJK and Latin letters or digits that touch."""
    cjk = r"一-鿿぀-ヿ가-힯"
    return F.regexp_replace(F.regexp_replace(text, rf"([{cjk}])([A-Za-z0-9])", "$1 $2"), rf"([A-Za-z0-9])([{cjk}])", "$1 $2")


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds before the next attempt: what the server asks for, at most 60, else 0.5 * 2^(n - 1), at most 30."""
    return F.when(retry_after.isNotNull(), F.least(F.greatest(retry_after, F.lit(0.0)), F.lit(60.0))).otherwise(F.least(F.lit(30.0), 0.5 * F.pow(F.lit(2.0), attempt - 1)))


def title_from(text: Column, limit: int = 80) -> Column:
    """The first line, cut at the limit, by preference behind a full stop of either script."""
    line = F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))
    head = F.substring(line, 1, limit)
    stop = F.regexp_extract(head, r"^(.*[。！？.!?])", 1)
    return F.when(F.length(line) <= limit, line).otherwise(F.when(stop != "", stop).otherwise(head))


def fixed_point(x: Column, places: int) -> Column:
    """A double with so many decimals (4 at most), rounded as its binary value says, halves to the even digit: 0.965 is a little less and gives 0.96.

    What is rounded is the number itself and not its shortest decimal form: the part
    after the point times 10 ** places is a double and what that double lacks of the
    product, which is exact, as one factor is split in two; the lack decides halves.
    Each step is bound once: x may be long, and steps that repeat it would double it.
    """
    whole_ones = float(10**places)

    def nearest(rest: Column) -> Column:
        high = rest * float((1 << 27) + 1) - (rest * float((1 << 27) + 1) - rest)

        def settled(product: Column) -> Column:
            lack = (high * whole_ones - product) + (rest - high) * whole_ones
            off = product - F.rint(product)
            step = F.when((off == 0.5) & (lack > 0), 1).when((off == -0.5) & (lack < 0), -1).otherwise(0)
            return F.rint(product).cast("long") + step

        return let(rest * whole_ones, settled)

    def shown(v: Column) -> Column:
        finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
        size = F.when(finite, F.abs(v)).otherwise(0.0)
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")

        def number(near: Column) -> Column:
            carried = F.floor(size) + F.when(near == 10**places, 1).otherwise(0)
            tail = F.lpad(F.pmod(near, F.lit(10**places)).cast("string"), places, "0")
            return F.concat(sign, carried.cast("long").cast("string"), F.lit("."), tail)

        return F.when(F.isnan(v), "nan").when(~finite, F.concat(sign, F.lit("inf"))).otherwise(let(let(size - F.floor(size), nearest), number))

    return let(x, shown)
