"""The operators' queries against their SQL, and over empty and odd tables."""

from __future__ import annotations

import pytest
from brieflake.llm import queries

from ..conftest import same_rows

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    same_rows(queries.queries()[name](spark, sf), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, empty_tables, name):
    assert queries.queries()[name](spark, empty_tables).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if int(n[2:].split("_")[0]) < 11))
def test_one_row_for_each_document(spark, tables, name):
    got = queries.queries()[name](spark, tables).collect()
    want = spark.read.parquet(f"{tables}/documents.parquet").collect()
    key = lambda rs: sorted(str(r.doc_id) for r in rs)
    assert key(got) == key(want)


def test_vectors_with_odd_columns(spark, tmp_path):
    rows = [(0, [0.5, 0.25], 1, 2), (50, [0.25, 0.5], 1, 2), (50, None, None, None), (None, [1.0, 1.0], 1, 2), (7, [0.5, 0.25], 1, 2), (7, [0.5, 0.25], 1, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int, block int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in queries.queries()["op1_vector_search"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == [(0, 1, 7, 20480), (0, 2, 7, 20480), (0, 3, 50, 16384), (50, 1, 0, 16384), (50, 2, 7, 16384), (50, 3, 7, 16384)]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
