"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from brieflake.plans import catalogue

from .conftest import same_rows
from .test_operators import closure, rule_table

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    same_rows(catalogue.queries()[name](spark, sf), duck.sql(SQL[name]))


def test_similar_pairs_and_clusters(spark, sf):
    """All documents against the rules on every pair."""
    pairs = {(r.a, r.b) for r in catalogue.queries()["similar_pairs"](spark, sf).collect()}
    rows = [(r.seq, str(r.published_at), r.url_key, r.title, r.title_zh, r.summary, r.category, r.markets, r.companies, r.subjects, r.kinds, r.key_parts) for r in catalogue._reports(spark, sf).collect()]
    want = {(x[0], y[0]) if x[0] < y[0] else (y[0], x[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if rule_table(x, y)}
    assert pairs <= want and len(pairs) > 100
    label = {r.seq: r.cluster for r in catalogue.queries()["event_clusters"](spark, sf).collect()}
    assert label == closure(pairs, label) == closure(want, label)


def test_commercial_mix(spark, sf):
    rows = catalogue.queries()["commercial_mix"](spark, sf).collect()
    assert sum(r.commercial for r in rows) >= 0.7 * len(rows)
    per = {}
    for r in rows:
        per[r.source_id] = per.get(r.source_id, 0) + 1
    assert max(per.values()) <= 3


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
