import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeops.llm import hadamard_clusters as h


def brute(rows, k=8, rounds=10):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(d for _, d, j in found if j == c) for c in range(k)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, inertia[j], sum(inertia), digest[j]) for i, d, j in found)


def rows_of(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_transform_keeps_distances_and_inverts():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-h.LARGEST, h.LARGEST + 1, (2, 50, 64))
    wa, wb = h.transform(a), h.transform(b)
    assert (((wa - wb) ** 2).sum(1) == 64 * ((a - b) ** 2).sum(1)).all()
    assert [h.inverse([int(x) for x in w]) for w in wa] == a.tolist()
    matrix = h.transform(np.eye(64, dtype=int)).T
    assert [(np.diff(row) != 0).sum() for row in matrix] == list(range(64))


@pytest.mark.parametrize("spread", [1, 3, 1000, h.LARGEST])
def test_search_equals_comparing_all(spread):
    rng = np.random.default_rng(spread)
    vectors, centroids = rng.integers(-spread, spread + 1, (3000, 64)), rng.integers(-spread, spread + 1, (8, 64))
    centroids[5] = centroids[2]
    vectors[:500] = centroids[rng.integers(0, 8, 500)] + rng.integers(-1, 2, (500, 64))
    vectors[500:600, 3:] = 0
    centroids[7, 3:] = centroids[6, 3:] = 0
    apart = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    nearest, distance, compared = h.search(h.transform(vectors), h.transform(centroids))
    assert (nearest == apart.argmin(1)).all() and (distance == 64 * apart.min(1)).all()


def test_search_leaves_work_out():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-500, 500, (8, 64)).cumsum(1)
    vectors = centroids[rng.integers(0, 8, 1000)] + rng.integers(-20, 20, (1000, 64))
    assert h.search(h.transform(vectors), h.transform(centroids))[2] < 0.35 * 1000 * 8 * 64


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = rows_of(h.cluster(vectors))
    assert got == brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted((str(r[0]), *r[1:]) for r in con.execute(h.sql()).fetchall())


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist(), 1) for i in range(20)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], 1), (50, None, 1), (51, [], 1), (52, [0.0] * 63, 1), (53, [0.0] * 65, 1)]
    rows += [(54, [None] + [0.0] * 63, None), (55, [float("nan")] + [0.0] * 63, 1), (56, [float("inf")] + [0.0] * 63, 1), (57, [float("-inf")] * 64, 1), (58, [-0.0] * 64, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster long").withColumns({"distance": F.lit(1), "coefficients": F.lit("x"), "vector": F.lit(2)})
    assert rows_of(h.cluster(frame)) == brute([r[:2] for r in rows])
    few = frame.where("vec_id < 5")
    assert rows_of(h.cluster(few)) == brute([r[:2] for r in rows if r[0] is not None and r[0] < 5])
    same = frame.withColumn("embedding", F.array_repeat(F.lit(0.25), 64))
    assert {(r.cluster, r.distance) for r in h.cluster(same).collect()} == {(0, 0)}
    assert h.cluster(frame.limit(0)).count() == 0
    assert h.cluster(frame.where("vec_id IS NULL")).count() == 0


def test_components_out_of_range_are_an_error(spark):
    large = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        h.cluster(large).collect()
