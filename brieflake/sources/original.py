"""Where aggregator links lead: redirects followed round by round, pages asked for their canonical address.

Fetched responses are a table (url, status, location, html).  Each response is one
step: on to another aggregator address, out to a publisher, or an error.  A round
joins each step that goes on with the longest way known from where it leads, so as
many rounds as redirects are allowed settle all chains; what is still on its way then
is longer than allowed, or a loop.  An address that was fetched often has a step for
each different answer, and every one is followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses, domains, urls
from ..functions.addresses import let
from ..ship import checkpoint_dir

MAX_REDIRECTS = 5
#: Characters of a page in which its canonical address is looked for, as a fetcher reads no more.
HEAD = 262_144

_TAG = r"(?is)<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, "" without one; references to the signs that attributes need are decoded."""
    found = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*(F.regexp_extract(tag, found, k) for k in (1, 2, 3)))  # two of them are empty
    for ref, sign in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(ref), F.lit(sign))
    return value


def canonical_link(html: Column) -> Column:
    """The first canonical link, or address that a page gives for sharing, that isn't empty; as it stands."""

    def candidate(tag: Column) -> Column:
        link = tag.rlike("(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        share = tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "property")) == "og:url")
        return F.nullif(F.when(link, F.trim(_attribute(tag, "href"))).when(share, F.trim(_attribute(tag, "content"))), F.lit(""))

    return F.get(F.filter(F.transform(F.regexp_extract_all(F.substring(html, 1, HEAD), F.lit(_TAG), F.lit(0)), candidate), lambda x: x.isNotNull()), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. parts carried out; it begins with a slash."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)

    def step(acc: Column, p: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(p == ".", acc).when(p == "..", up).otherwise(F.concat(acc, F.array(p)))

    end = F.when(F.try_element_at(parts, F.lit(-1)).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _parts(u: Column) -> Column:
    return F.struct(*(F.regexp_extract(u, _PARTS, k).alias(name) for k, name in enumerate(("scheme", "site", "path", "query", "fragment"), 1)))


def joined(base: Column, link: Column) -> Column:
    """A link as an address, seen from the page it stands on: absolute, of another host, from the root, relative, a query or a fragment alone."""

    def told(x: Column) -> Column:
        b, k = x["base"], x["link"]
        own, site = k["scheme"] != "", k["site"] != ""
        folder = F.regexp_extract(b["path"], r"^(.*/)", 1)
        beside = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), k["path"])
        path = F.when(k["path"] == "", b["path"]).otherwise(let(F.when(k["path"].startswith("/"), k["path"]).otherwise(beside), _without_dots))
        here = F.concat(b["scheme"], b["site"], path, F.when((k["path"] == "") & (k["query"] == ""), b["query"]).otherwise(k["query"]), k["fragment"])
        return F.when(own, x["as_is"]).when(site, F.concat(b["scheme"], x["as_is"])).otherwise(here)

    return F.when(link == "", base).otherwise(let(F.struct(_parts(base).alias("base"), _parts(link).alias("link"), link.alias("as_is")), told))


def _through(url: Column, aggregators: tuple[str, ...]) -> Column:
    return F.coalesce((urls.scheme(url) == "https") & urls.host(url).isin(*aggregators), F.lit(False))


def public_hosts(hosts: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """(host, public) of each distinct host: an address literal by itself, a name by all its addresses (``resolved``: host, address), at least one; without that table every name but local ones counts as public."""
    h = hosts.select("host").where("host is not null").distinct()
    bare = F.regexp_replace(F.col("host"), r"\.+$", "")
    local = (bare == "localhost") | bare.endswith(".localhost") | bare.endswith(".local") | (bare == "")
    literal = addresses.is_public(bare)
    if resolved is None:
        return h.select("host", (~local & F.coalesce(literal, F.lit(True))).alias("public"))
    r = resolved.groupBy("host").agg(F.bool_and(F.coalesce(addresses.is_public(F.col("address")), F.lit(False))).alias("_all"))
    return h.join(r, "host", "left").select("host", (~local & F.coalesce(literal, "_all", F.lit(False))).alias("public"))


def _first_step(responses: DataFrame, aggregators: tuple[str, ...], resolved: DataFrame | None) -> DataFrame:
    """(url, to, error, redirects): where a response leads; ``to`` without an error is a publisher's, unless it is an aggregator's again."""
    away = F.col("status").between(300, 399)
    link = F.when(away, F.nullif(F.trim("location"), F.lit(""))).when(F.col("status") < 400, canonical_link(F.col("html")))
    r = responses.withColumn("_link", link).withColumn("to", F.when(F.col("_link").isNotNull(), joined(F.col("url"), F.col("_link"))))
    r = r.withColumn("_again", _through(F.col("to"), aggregators)).withColumn("host", urls.host(F.col("to")))
    safe = public_hosts(r.where("to is not null"), resolved)
    j = r.join(safe, "host", "left")
    web = F.coalesce(urls.is_web(F.col("to")), F.lit(False))
    nothing = F.col("to").isNull() | (~away & (~F.coalesce(urls.scheme(F.col("to")).isin("http", "https"), F.lit(False)) | F.col("_again")))
    error = (
        F.when(F.col("status").isNull(), "request_failed")
        .when(away & F.col("to").isNull(), "redirect_without_location")
        .when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status")))
        .when(nothing, "original_url_not_found")
        .when(~F.col("_again") & ~(web & F.coalesce("public", F.lit(False))), "unsafe_target")
    )
    on = away & F.col("_again") & error.isNull()
    return j.select("url", F.when(error.isNull(), F.col("to")).alias("to"), error.alias("error"), (away & F.col("to").isNotNull()).cast("int").alias("redirects"), on.alias("on"))


def chains(responses: DataFrame, aggregators: tuple[str, ...] = urls.AGGREGATORS, resolved: DataFrame | None = None, most: int = MAX_REDIRECTS) -> DataFrame:
    """(url, to, error, redirects) of each response's address, chains followed to their end.

    Where responses of one address differ, the longest way counts (of equally long
    ones one that leads out, then the smallest), so one of more than ``most``
    redirects, or a loop, is too_many_redirects whatever the others say.
    """
    checkpoint_dir(responses.sparkSession)
    step = _first_step(responses, aggregators, resolved).distinct().checkpoint()

    def way(redirects: Column, to: Column, error: Column) -> Column:
        return F.struct((-redirects).alias("back"), to.isNull().alias("lost"), to.alias("to"), error.alias("error")).alias("way")

    none = F.lit(None).cast("string")
    done = step.where("not on").groupBy("url").agg(F.min(way(F.col("redirects"), F.col("to"), F.col("error"))).alias("way")).checkpoint()
    going = step.where("on").select("url", "to")
    ends = done.union(going.select("url", way(F.lit(1), none, none))).groupBy("url").agg(F.min("way").alias("way"))
    for _ in range(most):
        j = going.join(ends.select(F.col("url").alias("to"), F.col("way").alias("next")), "to", "left")
        error = F.when(F.col("next").isNull(), "request_failed").otherwise(F.col("next.error"))
        followed = j.select("url", way(1 - F.coalesce("next.back", F.lit(0)), F.col("next.to"), error))
        ends = done.union(followed).groupBy("url").agg(F.min("way").alias("way")).checkpoint()
    redirects = -F.col("way.back")
    long = redirects > most
    return ends.select("url", F.when(~long, F.col("way.to")).alias("to"), F.when(long, "too_many_redirects").otherwise(F.col("way.error")).alias("error"), redirects.alias("redirects"))


def resolved_items(items: DataFrame, responses: DataFrame, rules: DataFrame, aggregators: tuple[str, ...] = urls.AGGREGATORS, resolved: DataFrame | None = None, fallback: bool = True, enabled: bool = True, most: int = MAX_REDIRECTS) -> DataFrame:
    """items (url, publisher, and more) with original_url, original_status (resolved, fallback, failed, disabled), original_error and publisher_domain.

    An address of no aggregator fails as unsupported_aggregator, an address literal that isn't public as unsafe_target; an item
    that failed falls back on its aggregator link if it names its publisher.
    """
    if not enabled:
        none = F.lit(None).cast("string")
        return items.withColumns({"original_url": none, "original_status": F.lit("disabled"), "original_error": none, "publisher_domain": none})
    ends = chains(responses, aggregators, resolved, most).withColumnsRenamed({"to": "_to", "error": "_error"}).drop("redirects")
    j = items.join(ends, "url", "left")
    through = _through(F.col("url"), aggregators)
    inner = F.coalesce(~addresses.is_public(urls.host(F.col("url"))), F.lit(False))
    error = F.when(~through, F.when(inner, "unsafe_target").otherwise("unsupported_aggregator")).when(F.col("_to").isNull() & F.col("_error").isNull(), "request_failed").otherwise(F.col("_error"))
    j = j.withColumn("original_error", error).withColumn("original_url", F.when(error.isNull(), F.col("_to"))).drop("_to", "_error")
    named = F.trim(F.coalesce("publisher", F.lit(""))) != ""
    j = j.withColumn("original_status", F.when(F.col("original_error").isNull(), "resolved").when(named & F.lit(fallback), "fallback").otherwise("failed")).withColumn("_host", urls.host(F.col("original_url")))
    d = domains.domains(j.select(F.col("_host").alias("host")), rules).select(F.col("host").alias("_host"), F.nullif("name", F.lit("")).alias("publisher_domain"))
    return j.join(d, "_host", "left").drop("_host")
