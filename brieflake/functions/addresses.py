"""Addresses as text of fixed width, and intervals of those that aren't public.

An IPv4 address is "4" and 8 hex digits, an IPv6 address "6" and 32, so an interval
is two texts and membership is a comparison.  All are native expressions.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The registries' special-purpose blocks that aren't globally reachable, and the exceptions within them.
NOT_PUBLIC = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
PUBLIC_WITHIN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
MULTICAST = ("224.0.0.0/4", "ff00::/8")
MAPPED = "6" + "0" * 20 + "ffff"


def _interval(block: str) -> tuple[str, str]:
    n = ipaddress.ip_network(block)
    width = 8 if n.version == 4 else 32
    return tuple(f"{n.version}{int(a):0{width}x}" for a in (n[0], n[-1]))  # type: ignore[return-value]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _v4(h: Column) -> Column:
    """The hex digits of a dotted address, null if it is none (parts beyond 255, leading zeros)."""
    numbers = F.transform(F.split(h, r"\."), lambda p: p.try_cast("int"))
    digits = lambda ns: F.when(F.forall(ns, lambda n: n <= 255), F.array_join(F.transform(ns, lambda n: F.lpad(F.lower(F.hex(n)), 2, "0")), ""))
    return F.when(h.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"), let(numbers, digits))


def _v6(h: Column) -> Column:
    """The 32 hex digits of an address with colons, null if it is none.  A zone is no part of it, a dotted end counts as two groups."""
    bare = F.regexp_replace(F.lower(h), r"^\[|\]$|%.*$", "")
    hexed = lambda end: F.concat(F.substring(end, 1, 4), F.lit(":"), F.substring(end, 5, 4))
    plain = lambda b: F.when(~F.contains(b, F.lit(".")), b).otherwise(F.concat(F.regexp_extract(b, r"^(.*:)[^:]*$", 1), let(_v4(F.regexp_extract(b, r"([^:]*)$", 1)), hexed)))
    groups = lambda s: F.filter(F.split(F.coalesce(s, F.lit("")), ":"), lambda g: g != "")

    def spread(x: Column) -> Column:
        left, right, cut = x["left"], x["right"], x["cut"]
        many = F.size(left) + F.size(right)
        full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - many)), right)
        return F.when(F.when(cut, many <= 7).otherwise(many == 8), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))

    def read(p: Column) -> Column:
        halves = F.split(p, "::")
        shape = p.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & ~p.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}") & (F.size(halves) <= 2)
        return F.when(shape, let(F.struct(groups(F.get(halves, F.lit(0))).alias("left"), groups(F.get(halves, F.lit(1))).alias("right"), (F.size(halves) == 2).alias("cut")), spread))

    return F.when(F.contains(h, F.lit(":")), let(bare, lambda b: let(plain(b), read)))


def address(h: Column) -> Column:
    """A host that is an address literal, in fixed width; null for names and what is malformed.  IPv4 addresses mapped into IPv6 count as IPv4."""
    six = let(_v6(h), lambda d: F.when(d.startswith(MAPPED[1:]), F.concat(F.lit("4"), F.substring(d, 25, 8))).otherwise(F.concat(F.lit("6"), d)))
    return F.coalesce(F.concat(F.lit("4"), _v4(h)), six)


def within(a: Column, blocks: tuple[str, ...]) -> Column:
    """An address in fixed width lies in one of the blocks."""
    return F.exists(F.array(*(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")) for low, high in map(_interval, blocks))), lambda b: a.between(b["low"], b["high"]))


def is_public(h: Column) -> Column:
    """An address literal that is globally reachable; null for what is no address."""
    return let(address(h), lambda a: F.when(a.isNotNull(), ~within(a, NOT_PUBLIC) | within(a, PUBLIC_WITHIN)))
