"""Centroid clustering of integer vectors with built-in expressions only.

Components become whole numbers, so that distances, sums and means are exact
and no result depends on the order of additions.  The centroids, a few rows,
are literal arrays of the plan; a round is one scan with sums for each cluster,
combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import materialize, table

CLUSTERS, DIM, SCALE, ROUNDS = 40, 64, 256, 5
_EXACT = "decimal(38,0)"


def reach(dim: int, most: int) -> int:
    """Largest component whose squared distances over ``dim`` components stay below ``most``."""
    return math.isqrt(most // (4 * dim)) - 1


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale x component) of the vectors that take part.

    A vector takes part if it has ``dim`` components, none of them null or
    non-finite.  Components whose distances don't fit 38 digits (about 6 x 10^17
    after scaling, with 64 components) make a vector take no part either.
    """
    x = F.col(vec_col).cast("array<double>")
    fit = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < F.lit(float(reach(dim, 10**38)))))
    return vectors.filter(fit).select(F.col(id_col).alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def nearest(v: Column, centroids: list[list[int]], kind: str = "bigint") -> Column:
    """Struct (distance, cluster) of the nearest of ``centroids``, ties to the smaller number."""
    literal = lambda c: F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>")
    points = F.array(*[F.struct(F.lit(k).alias("k"), literal(c).alias("c")) for k, c in enumerate(centroids)])

    def to(point: Column) -> Column:
        gaps = F.zip_with(v, point["c"], lambda a, b: (a.cast(kind) - b.cast(kind)) * (a.cast(kind) - b.cast(kind)))
        return F.struct(F.aggregate(gaps, F.lit(0).cast(kind), lambda total, g: (total + g).cast(kind)).alias("distance"), point["k"].alias("cluster"))

    return F.array_min(F.transform(points, to))


def first_centroids(kept: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """Vectors with the smallest SHA-256 of ``seed``:id; repeated ids by their vectors, null ids last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()  # ``clusters`` rows
    return [list(r["v"]) for r in rows]


def clustered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every vector that takes part, and the final centroids.

    Each of ``rounds`` rounds assigns all vectors to their nearest centroid
    (squared Euclidean distance, ties to the smaller number) and puts a
    centroid that has vectors at the floor of their mean.  Vectors are assigned
    once more at the end.  Repeated rows count as often as they occur, rows
    with a null id are clustered but start no centroid, and fewer vectors than
    ``clusters`` give fewer centroids.  No vector gives no rows.  Distances and
    inertias beyond a long are null.
    """
    kept = materialize(integer_vectors(vectors, id_col, vec_col, dim, scale), "integer-vectors")
    most, rows = kept.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))), F.count("*")).first()
    kind = "bigint" if (most or 0) <= reach(dim, 1 << 63) else _EXACT
    summed = "bigint" if (most or 0) * rows < 1 << 62 else _EXACT
    centroids = first_centroids(kept, clusters, seed)
    if not centroids:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")]).limit(0), []
    for _ in range(rounds):
        assigned = kept.select(nearest(F.col("v"), centroids, kind)["cluster"].alias("cluster"), "v")
        sums = [F.sum(F.get("v", F.lit(i)).cast(summed)).alias(f"s{i}") for i in range(dim)]
        for row in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # one row a cluster
            centroids[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
    last = kept.select("vec_id", nearest(F.col("v"), centroids, kind).alias("near")).select("vec_id", "near.cluster", "near.distance")
    last = materialize(last, "clusters")
    inertia = dict(last.groupBy("cluster").agg(F.try_sum(F.col("distance").cast(_EXACT))).collect())  # one row a cluster
    whole = None if None in inertia.values() else sum(inertia.values())
    longs = lambda n: F.lit(None if n is None or n >= 1 << 63 else int(n)).cast("bigint")
    own = F.array(*[longs(inertia.get(k, 0)) for k in range(len(centroids))])
    return last.select("vec_id", "cluster", F.col("distance").try_cast("bigint").alias("distance"), F.get(own, F.col("cluster")).alias("cluster_inertia"), longs(whole).alias("inertia")), centroids


def op13_centroids(spark, sf_dir) -> DataFrame:
    out, centroids = clustered(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return out.withColumn("centroid_sha256", F.get(F.array(*[F.lit(d) for d in digests]).cast("array<string>"), F.col("cluster")))


def _sql(rounds: int = ROUNDS) -> str:
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        "comps AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        f"""first AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS k FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) <= {CLUSTERS})""",
        "c0 AS MATERIALIZED (SELECT k, i, x FROM first JOIN comps USING (r))",
    ]
    assign = """SELECT r, k, d FROM (SELECT comps.r, c.k, sum((comps.x - c.x) * (comps.x - c.x)) AS d FROM comps JOIN c{n} c ON comps.i = c.i GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1"""
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({assign.format(n=n)})")
        parts.append(f"s{n} AS MATERIALIZED (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN comps USING (r) GROUP BY 1, 2)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE ((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::BIGINT END AS x FROM c{n} c LEFT JOIN s{n} s ON c.k = s.k AND c.i = s.i)")
    parts.append(f"last AS MATERIALIZED ({assign.format(n=rounds)})")
    parts.append(f"digest AS MATERIALIZED (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM last JOIN kept USING (r) JOIN digest USING (k)"""


OP13_SQL = _sql()
