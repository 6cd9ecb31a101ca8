"""URL keys and URL predicates as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import addresses

# Tracking parameters dropped from the de-duplication key, besides utm_*.
DEDUP_TRACKING = ("_ga", "dclid", "fbclid", "gclid", "igshid", "li_fat_id", "mc_cid", "mc_eid", "msclkid", "ttclid", "twclid", "vero_id")
# The shorter list of the event key.
EVENT_TRACKING = ("dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid")
AGGREGATORS = ("news.google.com",)

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def userinfo(url: Column) -> Column:
    """What stands before the last @ of the authority; null without one."""
    a = authority(url)
    return F.when(F.instr(a, "@") > 0, F.regexp_extract(a, r"^(.*)@[^@]*$", 1))


def _host_port(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^.*@", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(_host_port(url), r":[0-9]*$", ""))


def port(url: Column) -> Column:
    """The port as text, empty if absent or the scheme's own."""
    p = F.regexp_extract(_host_port(url), r":([0-9]+)$", 1)
    own = ((scheme(url) == "http") & (p == "80")) | ((scheme(url) == "https") & (p == "443"))
    return F.when(own, F.lit("")).otherwise(p)


def path(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_extract(url, _URL, 3), r"/+$", "")
    return F.when(bare == "", F.lit("/")).otherwise(bare)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 4)


def _parameter_name(part: Column) -> Column:
    """Decoded and lower-cased; what can't be decoded stays as it stands."""
    raw = F.substring_index(part, "=", 1)
    return F.lower(F.coalesce(F.try_url_decode(raw), raw))


def kept_parameters(url: Column, tracking: tuple[str, ...]) -> Column:
    """The query's parts without tracking ones, in order, as they stand."""

    def keep(part: Column) -> Column:
        name = _parameter_name(part)
        return ~(name.startswith("utm_") | name.isin(*tracking))

    return F.filter(F.split(query(url), "&"), keep)


def dedup_key(url: Column) -> Column:
    """Seven parts that name one page: scheme, user, password, host, port, path, kept query.  http and https differ, the fragment doesn't count."""
    user = F.coalesce(userinfo(url), F.lit(""))
    kept = F.when(query(url) == "", F.lit("")).otherwise(F.array_join(kept_parameters(url, DEDUP_TRACKING), "&"))
    return F.concat_ws("\u001f", scheme(url), F.substring_index(user, ":", 1), F.when(F.instr(user, ":") > 0, F.regexp_extract(user, r"^[^:]*:(.*)$", 1)).otherwise(F.lit("")), host(url), port(url), path(url), kept)


def event_url_key(url: Column) -> Column:
    """``url:`` and the SHA-256 of the address without credentials, tracking and fragment, its parameters decoded, sorted and encoded again."""
    parts = F.filter(kept_parameters(url, EVENT_TRACKING), lambda p: p != "")

    def pair(p: Column) -> Column:
        value = F.when(F.instr(p, "=") > 0, F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).otherwise(F.lit(""))
        decode = lambda x: F.coalesce(F.try_url_decode(x), x)
        return F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(value).alias("v"))

    # Java's encoder leaves * and encodes ~; the form wanted here is the other way round
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    q = F.array_join(F.transform(F.array_sort(F.transform(parts, pair)), lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    place = F.concat(host(url), F.when(port(url) == "", F.lit("")).otherwise(F.concat(F.lit(":"), port(url))))
    return F.concat(F.lit("url:"), F.sha2(F.concat(scheme(url), F.lit("://"), place, path(url), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))), 256))


def is_web(url: Column) -> Column:
    """http or https with a host and no credentials."""
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != "") & userinfo(url).isNull(), F.lit(False))


def is_address(h: Column) -> Column:
    return h.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[?[0-9a-f]*:[0-9a-f:.]*\]?)$")


def is_attributable(url: Column, domain: Column) -> Column:
    """A public page of a publisher: web, not local, not an aggregator, under a registrable domain (``domain``: its host's, see functions.domains)."""
    h = F.regexp_replace(host(url), r"\.$", "")
    local = (h == "localhost") | h.endswith(".localhost") | h.endswith(".local")
    return F.coalesce(is_web(url) & ~local & ~h.isin(*AGGREGATORS) & ~is_address(h) & (domain != ""), F.lit(False))


def is_safe(url: Column) -> Column:
    """May be fetched: web, no credentials, not local, no address that isn't public or is for many receivers."""
    inner = lambda a: ~addresses.within(a, addresses.NOT_PUBLIC) | addresses.within(a, addresses.PUBLIC_WITHIN)
    literal = lambda h: addresses.let(addresses.address(h), lambda a: F.when(a.isNull(), True).otherwise(inner(a) & ~addresses.within(a, addresses.MULTICAST)))
    named = lambda h: ~((h == "localhost") | h.endswith(".localhost") | h.endswith(".local")) & literal(h)
    return is_web(url) & addresses.let(F.regexp_replace(host(url), r"\.$|^\[|\]$", ""), named)


def all_safe(hops: Column) -> Column:
    """Every address of a redirect chain (array) may be fetched; an empty chain may not."""
    return (F.size(hops) > 0) & F.forall(hops, lambda u: F.coalesce(is_safe(u), F.lit(False)))


def domain_count(urls: Column, domains: Column) -> Column:
    """Distinct publishers of an array of addresses: registrable domains, or what stands for them (``domains``: a map from hosts, see functions.domains)."""
    names = F.transform(F.filter(urls, is_web), lambda u: F.try_element_at(domains, host(u))["name"])
    return F.size(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))))
