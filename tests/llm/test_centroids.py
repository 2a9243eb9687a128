"""Centroid clustering against a full search in Python's integers, and against SQL."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from llm.catalog import op13_centroid_clustering
from llm.centroids import Centroids, cluster, packed, unpacked
from llm.oracle import ORACLE_SQL

KIND = "vec_id long, embedding array<double>, cluster string, V int"


def brute(rows, k=8, rounds=10, width=64):
    """{(vec_id, position): (cluster, distance)} in the given order of rows, the centroids, and how often a cluster was met."""
    kept = [(i, x) for i, x in rows if x is not None and len(x) == width and all(c is not None and math.isfinite(c) for c in x)]
    whole = [[math.floor(Fraction(c) * 1024) for c in x] for _, x in kept]
    first = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"3:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    centroids = [whole[r] for r in first[:k]]

    def assign():
        out = []
        for v in whole:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        near = assign()
        for j in range(len(centroids)):
            own = [v for v, (_, c) in zip(whole, near, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    inertia = {j: sum(d for d, c in near if c == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda n: n if n < 1 << 63 else None
    return [(i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), digest[c]) for (i, _), (d, c) in zip(kept, near, strict=True)]


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def test_clusters_equal_a_full_search(spark):
    r = random.Random(4)
    middles = [[r.uniform(-2, 2) for _ in range(64)] for _ in range(12)]
    rows = [(i, [m + r.gauss(0, 0.4) for m in r.choice(middles)]) for i in range(400)]
    rows += [(1000 + i, middles[0]) for i in range(150)]  # copies of one vector
    rows += [(7, rows[0][1]), (7, rows[1][1]), (None, rows[2][1]), (None, rows[3][1])]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [math.nan] + [1.0] * 63, [math.inf] * 64, [0.0] * 64]
    rows += [(2000 + i, x) for i, x in enumerate(odd)]
    df = spark.createDataFrame([(*x, "other", 1) for x in rows], KIND).repartition(7)
    assert got(cluster(df)) == sorted(brute(rows), key=repr)


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(i % 5)] + [0.0] * 63) for i in range(40)]  # many vectors midway between two centroids
    for rows in (grid, grid[:5], grid[:1], [(1, [2.0] * 64)] * 20):
        assert got(cluster(spark.createDataFrame([(*x, None, None) for x in rows], KIND))) == sorted(brute(rows), key=repr)
    none = cluster(spark.createDataFrame([(1, None, None, None)], KIND))
    assert none.count() == 0 and none.columns == cluster(spark.createDataFrame([], KIND)).columns


def test_huge_components_stay_exact(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([1e3, 1e9, 1e18, -1e300, 1.7e308]) * r.random() if r.random() < 0.05 else r.random() for _ in range(64)]) for i in range(40)]
    rows += [(100 + i, [r.random() for _ in range(64)]) for i in range(40)]
    out = got(cluster(spark.createDataFrame([(*x, None, None) for x in rows], KIND)))
    assert out == sorted(brute(rows), key=repr) and any(x[2] is None for x in out) and any(x[2] is not None for x in out)


def test_packed_vectors_come_back():
    for vectors in ([[1, -2, 3]], [[1, 2, 3], [1 << 40, 0, -1]], [[10**11, 0, 0]]):
        assert unpacked([packed(v) for v in vectors], 3).tolist() == vectors


def test_the_scan_stops_early_and_loses_nothing():
    r = np.random.default_rng(1)
    rows = r.integers(-3, 3, (8, 4))
    near = Centroids(rows.tolist())
    vectors = r.integers(-4, 4, (3000, 4))
    all_ = ((vectors[:, None] - rows[None]) ** 2).sum(2)
    for before in (np.zeros(3000, np.int64), r.integers(0, 8, 3000)):
        chosen, d = near.nearest(vectors, before)
        assert (chosen == all_.argmin(1)).all() and (d == all_.min(1)).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    df = op13_centroid_clustering(spark, f"/root/testdata/{sf}")
    names = ", ".join(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"select {names} from ({ORACLE_SQL['op13_centroid_clustering']})").fetchall())
