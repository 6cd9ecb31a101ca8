"""Ball trees against plain assignment, and the clustering query on odd vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from brieflake.llm import ball_trees as B

from ..conftest import same_rows


def _plain(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in z] for v in x]).argmin(axis=1)


@pytest.mark.parametrize("spread,leaf", [(1, 4), (3, 8), (40, 32)])
def test_assignment_is_exact(spread, leaf):
    r = np.random.default_rng(spread)
    heart = r.integers(-200, 200, (6, 5))
    x = heart[r.integers(0, 6, 700)] + r.integers(-spread, spread + 1, (700, 5))
    x[:40] = x[0]
    z = np.concatenate([heart, heart[:2], x[:2]])  # centroids that are equal, so ties
    t = B.grown(x, leaf)
    who, read = B.nearest(x[t.order], t, z)
    assert (who == _plain(x[t.order], z)).all()
    if spread < 40:
        assert read < len(x)  # some balls went whole


def test_balls_hold_their_vectors():
    x = np.random.default_rng(1).integers(-9, 9, (333, 7))
    t = B.grown(x, 16)
    y = x[t.order]
    for a, z, c, r in zip(t.start, t.end, t.centre, t.radius, strict=True):
        assert (np.sqrt(((y[a:z] - c) ** 2).sum(axis=1)) <= r + 1e-9).all()
    assert sorted(t.order) == list(range(333)) and (t.end - t.start)[(len(t.start) - 1) // 2 :].sum() == 333


def test_large_numbers_are_exact(spark):
    big = float(1 << 50)
    rows = [(i, [big + 2.0**-6 * i if j == 0 else float(j) for j in range(64)]) for i in range(40)]
    got = B.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, rounds=2, seed="1").collect()
    whole = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows}
    z = [list(whole[i]) for i in sorted(whole, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:3]]
    near = lambda v: min(range(3), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, z[c], strict=True)), c))
    for _ in range(2):
        of = {i: near(v) for i, v in whole.items()}
        for c in range(3):
            mine = [whole[i] for i in of if of[i] == c]
            z[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else z[c]
    assert {r.vec_id: r.cluster for r in got} == {i: near(v) for i, v in whole.items()}


ODD = [(1, [0.5] * 64), (1, [0.25] * 64), (2, None), (3, [0.5] * 63), (4, [0.5] * 63 + [None]), (5, [0.5] * 63 + [float("nan")]), (6, [float("inf")] * 64), (None, [-0.3] * 64), (7, [0.5] * 64), (7, [0.5] * 64), (8, [])]


def test_odd_vectors_match_sql(spark, tmp_path):
    import duckdb

    rows = [(i, v, 1, 2, "x") for i, v in ODD] + [(100 + i, np.random.default_rng(i).normal(size=64).tolist(), 1, 2, "y") for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, distance long, `row` string").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = B.op13_ball_trees(spark, str(tmp_path))
    assert got.count() == 65
    same_rows(got, con.sql(B.ORACLE["op13_ball_trees"]))


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame(ODD[:2], "vec_id long, embedding array<float>")
    got = B.clustered(few).collect()
    assert sorted(r.distance for r in got) == [0, 0] and {r.cluster for r in got} == {0, 1}
    assert B.clustered(few.limit(0)).collect() == [] and B.clustered(few.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_partitions_change_nothing(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = lambda d: sorted(tuple(r) for r in B.clustered(d).collect())
    assert rows(df.repartition(1)) == rows(df.repartition(7))
