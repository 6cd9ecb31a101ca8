"""Configurations against constraints: a row for each violation.

Configurations are JSON texts, read as variants, so that each may have a shape of
its own.  All rules are tried in one pass over them, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A constraint on what stands at ``path``, ``$.a.b``, or on each element of one list, ``$.a[].b``.

    required: something other than null stands there.  number: it can be read as a
    number.  ge, gt, le, lt: the number is so against ``value``.  oneof: its text is
    in ``value``.  matches: its text has the pattern ``value`` somewhere.
    """

    path: str
    rule: str
    value: object = None


# The bounds of the settings for analysis, of digests and of scores.
ANALYSIS = (
    Rule("$.concurrency", "gt", 0), Rule("$.concurrency", "le", 64), Rule("$.timeout_seconds", "gt", 0), Rule("$.max_attempts", "ge", 1), Rule("$.max_attempts", "le", 10),
)
DIGEST = (Rule("$.max_items", "gt", 0), Rule("$.default_group_limit", "gt", 0), Rule("$.groups[].limit", "required"), Rule("$.groups[].limit", "gt", 0))
SCORES = tuple(Rule(f"$.{n}", r, v) for n in ("importance_score", "profile_relevance_score", "opportunity_score", "evidence_quality_score") for r, v in (("required", None), ("ge", 0), ("le", 10)))


def _violation(x: Column, path: str, at: Column, r: Rule) -> Column:
    said, number = F.try_variant_get(x, path, "string"), F.try_variant_get(x, path, "double")
    if r.rule in ("ge", "gt", "le", "lt"):
        bound = F.lit(float(r.value))
        broken = {"ge": number < bound, "gt": number <= bound, "le": number > bound, "lt": number >= bound}[r.rule]
    elif r.rule == "required":
        broken = said.isNull()
    elif r.rule == "number":
        broken = said.isNotNull() & number.isNull()
    elif r.rule == "oneof":
        broken = ~said.isin(*r.value)
    elif r.rule == "matches":
        broken = ~said.rlike(r.value)
    else:
        raise ValueError(f"unknown rule: {r.rule}")
    return F.when(broken, F.struct(at.alias("path"), F.lit(r.rule).alias("rule"), said.alias("value")))


def _of_element(of: str, rules: list[Rule]) -> Callable[[Column, Column], Column]:
    def violated(e: Column, i: Column) -> Column:
        rest = [r.path.partition("[]")[2] for r in rules]
        return F.array(*(_violation(e, "$" + p, F.concat(F.lit(of + "["), i, F.lit("]" + p)), r) for p, r in zip(rest, rules, strict=True)))

    return violated


def violations(configs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, path, rule, value) for each rule that a configuration (id, config) breaks; value is what stands there, as text.

    What is absent or null breaks ``required`` alone, what can't be read as a number
    ``number`` and no bound.  Elements are named by their place from 0; a list that is
    absent, or not a list, has none.  A text that is null or no JSON has one
    violation, of rule ``json`` at ``$``.
    """
    flat = [r for r in rules if "[]" not in r.path]
    lists: dict[str, list[Rule]] = {}
    for r in rules:
        if "[]" in r.path:
            lists.setdefault(r.path.partition("[]")[0], []).append(r)
    v = F.col("_v")
    found = [F.array(*(_violation(v, r.path, F.lit(r.path), r) for r in flat))] if flat else []
    for of, mine in lists.items():
        elements = F.coalesce(F.try_variant_get(v, of, "array<variant>"), F.array().cast("array<variant>"))
        found.append(F.flatten(F.transform(elements, _of_element(of, mine))))
    unread = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"), F.col("config").alias("value")))
    all_ = F.when(v.isNull(), unread).otherwise(F.filter(F.concat(*found), lambda x: x.isNotNull())) if found else F.when(v.isNull(), unread)
    # the parser stops after one value: as the only element of a list, what follows it is seen
    read = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "config", F.lit("]"))), "$", "array<variant>")
    one = F.when(F.size(read) == 1, F.get(read, F.lit(0)))
    return configs.select("id", "config", one.alias("_v")).select("id", F.inline(all_))
