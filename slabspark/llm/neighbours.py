"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a fast pseudo-rotation (random signs and a Hadamard
transform, three times); its hash is the signed axis it then lies nearest to.
Rows are kept under one hash in each of several tables; a query looks under its
nearest ``probes`` axes in every table, and what it meets is ranked by the exact
inner product.

Inner products become angles by one more coordinate, which brings every row to
the length of the longest; queries have 0 there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabspark.llm.common import materialize, mix, table

TABLES = 10
#: Share of the axes that a query looks under in each table.
PROBED = 1 / 12
#: Rows, and queries, of one bucket that meet in one task.
PIECE = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


def signs(seed: int, d: int) -> np.ndarray:
    return 1.0 - 2.0 * (mix(np.arange(d, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) & np.uint64(1)).astype(np.float64)


def axes(vectors: np.ndarray, last: np.ndarray, number: int, nearest: int) -> np.ndarray:
    """(rows, nearest): signed axes by nearness for table ``number``; ``last`` is the added coordinate."""
    d = 1 << max(1, int(vectors.shape[1]).bit_length())
    x = np.zeros((len(vectors), d))
    x[:, : vectors.shape[1]], x[:, vectors.shape[1]] = vectors, last
    for r in range(3):
        x = hadamard(x * signs(number * 3 + r, d))
    both = np.concatenate([x, -x], axis=1)
    if nearest == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :nearest]


def _hashed(tables: int, probed: float | None):
    """A pandas UDF (vector, length of the longest) -> array of table * 2^20 + axis."""

    @F.pandas_udf("array<int>")
    def run(vector: pd.Series, longest: pd.Series) -> pd.Series:
        out: list = [None] * len(vector)
        sizes = vector.map(len)
        for size in sizes.unique():
            rows = np.flatnonzero(sizes == size)
            x = np.stack(vector.iloc[rows].to_list()).astype(np.float64)
            length = np.linalg.norm(x, axis=1)
            if probed is None:
                top = np.maximum(longest.iloc[rows].to_numpy(float), length)
                unit, last, nearest = x / top[:, None], np.sqrt(np.maximum(0, 1 - (length / top) ** 2)), 1
            else:
                unit, last = x / length[:, None], np.zeros(len(rows))
                nearest = max(1, round(2 * (1 << max(1, int(size).bit_length())) * probed))
            found = np.concatenate([axes(unit, last, t, nearest) + (t << 20) for t in range(tables)], axis=1)
            for i, keys in zip(rows, found):
                out[i] = keys.astype(np.int32)
        return pd.Series(out)

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def _ranked(k: int):
    """Of one cell: every query's k nearest rows, ties to the smaller first id."""

    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query": [], "vec": [], "score": []})
        x = np.stack(rows["vector"].to_list())
        ids = rows["vec"].to_numpy()
        parts = []
        for a in range(0, len(queries), 256):
            q = queries.iloc[a : a + 256]
            score = np.stack(q["vector"].to_list()) @ x.T
            if score.shape[1] > k:
                edge = np.partition(score, -k, axis=1)[:, -k][:, None]
                i, j = np.nonzero(score >= edge)  # ties at the edge stay, the first ids are chosen below
            else:
                i, j = np.nonzero(np.ones(score.shape, bool))
            part = pd.DataFrame({"query": q["query"].to_numpy()[i], "vec": ids[j], "score": score[i, j]})
            parts.append(part.sort_values(["query", "score", "vec"], ascending=[True, False, True]).groupby("query", sort=False).head(k))
        return pd.concat(parts)

    return run


def _met(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, vec, score) of what meets in a bucket (both sides: bucket, id, vector), the k nearest of each cell.

    A bucket with many rows or queries is cut into pieces; every piece of the
    one side meets every piece of the other in a task of its own.
    """
    count = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / PIECE).cast("int").alias(name))
    pieces = materialize(count(rows, "n").join(count(queries, "m"), "bucket"), "bucket-sizes")
    spread = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    left = queries.join(pieces, "bucket").select("bucket", "query", "vector", spread("query", "m").alias("j"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    right = rows.join(pieces, "bucket").select("bucket", "vec", "vector", spread("vec", "n").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    return left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInPandas(_ranked(k), "query long, vec long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, probed: float = PROBED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row whose id is divisible by ``every``.

    Equal vectors are searched once and answer with their smallest ids, which
    is exact.  A query that finds fewer than ``k`` others in its buckets is
    held against all rows.  Rows without an id, and vectors that are null,
    zero, or hold null or non-finite components, take no part; vectors of
    unequal lengths never meet.  Of an id with several vectors the nearest counts.
    """
    few = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    few = few.filter(F.col("id").isNotNull() & _usable(F.col("vector"))).distinct()
    # The k + 1 smallest ids of each vector; Spark keeps no more of them in any task.
    order = Window.partitionBy("vector").orderBy("id")
    rows = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = materialize(rows.select(F.col("ids")[0].alias("vec"), "ids", "vector", length.alias("length"), F.size("vector").alias("size")), "vectors")
    longest = rows.groupBy("size").agg(F.max("length").alias("longest"))
    asked = few.filter(F.col("id") % every == 0).select(F.col("id").alias("query"), "vector")
    bucket = lambda key: F.struct(F.size("vector").alias("size"), key.alias("key")).alias("bucket")
    kept = rows.join(longest, "size").select("vec", "vector", F.explode(_hashed(tables, None)("vector", "longest")).alias("key")).select("vec", "vector", bucket(F.col("key")))
    looked = asked.select("query", "vector", F.explode(_hashed(tables, probed)("vector", F.lit(0.0))).alias("key")).select("query", "vector", bucket(F.col("key")))
    found = _met(looked, kept, k + 1).groupBy("query", "vec").agg(F.max("score").alias("score"))
    # A vector found by two queries of one id keeps its best score; only k + 1 of each query can matter.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec")
    found = materialize(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n"), "neighbours")
    total = found.join(rows.select("vec", F.size("ids").alias("ids")), "vec").groupBy("query").agg(F.sum("ids").alias("total"))
    short = materialize(asked.join(total.filter(F.col("total") > k).select("query"), "query", "left_anti"), "short-queries")
    if not short.isEmpty():
        everywhere = bucket(F.lit(-1))
        whole = _met(short.select("query", "vector", everywhere), rows.select("vec", "vector", everywhere), k + 1).groupBy("query", "vec").agg(F.max("score").alias("score"))
        found = found.join(short.select("query").distinct(), "query", "left_anti").union(whole)
    each = found.join(rows.select("vec", "ids"), "vec").select("query", F.explode("ids").alias("id"), "score").filter("id <> query")
    each = each.groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op9_neighbours(spark, sf_dir) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
