"""Centroid clustering against a plain version."""

import hashlib
import math
import random

import pytest

from slabspark.llm import clusters


def plain(rows, k, dim, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None) + sorted(("~", v) for i, v in kept if i is None)
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, near) if c == n]
            if own:
                centroids[n] = [sum(col) // len(own) for col in zip(*own)]
    near = assign()
    inertia = [sum(d for d, c in near if c == n) for n in range(len(centroids))]
    long = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, long(d), long(inertia[c]), long(sum(inertia))) for (i, _), (d, c) in zip(kept, near)), key=repr), centroids


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("v", "near", "cluster", "distance", "h", "k"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def vectors(seed, n, dim, size=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice((-size, size)) + rng.gauss(0, size / 3) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("size", [1.0, 1e7])
def test_against_plain_version(spark, size):
    rows = vectors(3, 120, 5, size)
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, None), (200, []), (201, rows[6][1][:4]), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, math.nan, 2.0, 3.0, 4.0]), (204, [1.0, math.inf, 2.0, 3.0, 4.0]), (205, [1e300] * 5)]
    want, centroids = plain([r for r in rows if r[0] != 205], 7, 5, 4)
    out, got = clusters.clustered(frame(spark, rows), clusters=7, dim=5, rounds=4)
    assert got == centroids
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want


def test_ties_and_empty_clusters(spark):
    rows = [(i, [0.0, 0.0]) for i in range(30)] + [(100, [1.0, 1.0])]
    want, centroids = plain(rows, 12, 2, 3)
    out, got = clusters.clustered(frame(spark, rows), clusters=12, dim=2, rounds=3)
    assert got == centroids and sorted((tuple(r) for r in out.collect()), key=repr) == want


def test_few_and_no_vectors(spark):
    out, got = clusters.clustered(frame(spark, vectors(1, 3, 4)), clusters=9, dim=4)
    assert len(got) == 3 and [r["distance"] for r in out.collect()] == [0, 0, 0]
    out, got = clusters.clustered(frame(spark, [(1, None)]), clusters=9, dim=4)
    assert got == [] and out.collect() == []
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]


def test_query_against_sql(spark, sf):
    from tests.oracle import connect, rows_of_spark, rows_of_sql

    assert rows_of_spark(clusters.op13_centroids(spark, sf)) == rows_of_sql(connect(sf), clusters.OP13_SQL)
