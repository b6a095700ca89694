"""Bulk identification: hash hits and vector neighbours merged and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions.scalars import embedding_score, hash_score, margin_confidence
from slabspark.functions.vectors import cosine_distance
from slabspark.operators.ball_tree import BallTree
from slabspark.operators.hash_index import HashIndex
from slabspark.operators.hot import top_per_group
from slabspark.operators.lsh import lsh_top_k
from slabspark.operators.search import ROUND, cosine_top_k, near_hash_join
from slabspark.session import materialize

STRATEGIES = ("exact", "banded", "lsh")


def hash_candidates(hits: DataFrame) -> DataFrame:
    """Hash hits (query_id, variant_id, distance) -> scored candidates."""
    return hits.select("query_id", "variant_id", hash_score(F.col("distance")).alias("score"),
                       F.lit("phash").alias("method"), F.col("distance").cast("double").alias("distance"))


def embedding_candidates(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "variant_id", embedding_score(F.col("distance")).alias("score"),
                       F.lit("embedding").alias("method"), F.col("distance").cast("double").alias("distance"))


def merge_candidates(by_hash: DataFrame, by_embedding: DataFrame) -> DataFrame:
    """Per (query, variant) the higher score; on a tie the hash candidate stays."""
    both = by_hash.unionByName(by_embedding)
    best = F.max_by(F.struct("score", "method", "distance"), F.struct("score", F.col("method") == "phash"))
    return both.groupBy("query_id", "variant_id").agg(best.alias("b")).select("query_id", "variant_id", "b.*")


def rank_candidates(candidates: DataFrame, k: int = P.TOP_K) -> DataFrame:
    """Top k by score (hash first, then variant id on ties) with the runner-up score.

    At most 3k candidates exist per query, so the window group is bounded.
    """
    order = [F.col("score").desc(), (F.col("method") == "phash").desc(), F.col("variant_id")]
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("runner_up", F.lead("score").over(Window.partitionBy("query_id").orderBy("rank")))


def choose(ranked: DataFrame, min_accept: float = P.MIN_ACCEPT_CONFIDENCE) -> DataFrame:
    """One row per query: chosen variant (null below the accept level) and confidence."""
    first = ranked.where(F.col("rank") == 1)
    confidence = margin_confidence(F.col("method"), F.col("score"), F.col("runner_up"))
    return first.select(
        "query_id",
        F.when(confidence >= min_accept, F.col("variant_id")).alias("variant_id"),
        confidence.alias("confidence"), "method", "score",
    )


def identify(
    queries: DataFrame, catalog: DataFrame, k: int = P.TOP_K, min_accept: float = P.MIN_ACCEPT_CONFIDENCE,
    dim: int | None = None, hash_layout=None, strategy: str = "exact", hash_index: HashIndex | None = None,
    vector_index: BallTree | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(decisions, ranked candidates) for every query.

    ``queries``: query_id, phash, embedding; ``catalog``: variant_id, phash,
    embedding.  A query with an exact hash hit keeps that hit alone and never
    enters the vector search.

    ``strategy`` says where vector neighbours come from: ``exact`` searches
    all of the catalog, ``lsh`` the rows that share a composite of hyperplane
    sides (``lsh.recall`` measures what that misses), ``banded`` only the rows
    whose perceptual hash is near.  ``hash_index`` and ``vector_index`` hold
    the catalog's rows between calls and take the place of its hashes and of
    the exact vector search.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    if strategy == "lsh" and dim is None:
        raise ValueError("lsh needs the length of the vectors")
    # Read four times below: written once instead of joined four times.
    hits = materialize(hash_index.search(queries, "query_id", "phash", 2 * k, "variant_id") if hash_index else near_hash_join(
        queries, catalog, "query_id", "phash", "variant_id", "phash", limit=2 * k, layout=hash_layout), "hash-hits")
    exact = hits.where((F.col("rank") == 1) & (F.col("distance") == 0))
    settled = hash_candidates(exact).withColumn("rank", F.lit(1)).withColumn(
        "runner_up", F.lit(None).cast("double"))
    open_queries = queries.join(exact.select("query_id"), "query_id", "left_anti")
    open_hits = hits.join(exact.select("query_id"), "query_id", "left_anti")
    if strategy == "banded":
        neighbours = _hash_neighbours(open_queries, catalog, open_hits, k)
    elif strategy == "lsh":
        neighbours = lsh_top_k(open_queries, catalog, "query_id", "embedding", "variant_id", "embedding", k=k, dim=dim).withColumnRenamed("ref_id", "variant_id")
    elif vector_index is not None:
        neighbours = vector_index.search(open_queries, "query_id", "embedding", k).withColumnRenamed("ref_id", "variant_id")
    else:
        neighbours = cosine_top_k(open_queries, catalog, "query_id", "embedding", "variant_id", "embedding",
                                  k=k, dim=dim).withColumnRenamed("ref_id", "variant_id")
    ranked = rank_candidates(merge_candidates(hash_candidates(open_hits), embedding_candidates(neighbours)), k)
    # At most k short rows per query; decisions and callers read it several times.
    candidates = materialize(settled.unionByName(ranked), "candidates")
    unmatched = queries.select("query_id").join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    decisions = choose(candidates, min_accept).unionByName(unmatched.select(
        "query_id", F.lit(None).cast(dict(catalog.dtypes)["variant_id"]).alias("variant_id"),
        F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("double").alias("score")))
    return decisions, candidates


def _hash_neighbours(queries: DataFrame, catalog: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The nearest by cosine of the rows that the hash search has found."""
    pairs = hits.select("query_id", "variant_id").join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id").join(
        catalog.select("variant_id", F.col("embedding").alias("_r")), "variant_id")
    pairs = pairs.where(F.size("_q") == F.size("_r")).select("query_id", "variant_id", F.round(cosine_distance(F.col("_q"), F.col("_r")), ROUND).alias("distance"))
    return top_per_group(pairs, ["query_id"], [F.col("distance"), F.col("variant_id")], k, "rank")


def write_back(submissions: DataFrame, decisions: DataFrame, candidates: DataFrame, names: DataFrame, now) -> tuple[
        DataFrame, DataFrame]:
    """(submissions with the decision filled in, audit rows with the candidates)."""
    d = decisions.select(F.col("query_id").alias("id"), F.col("variant_id").alias("_v"),
                         F.col("confidence").alias("_c"))
    updated = submissions.join(d, "id", "left").select(
        *[F.when(F.col("_c").isNotNull(), F.col("_v")).otherwise(F.col(c)).alias(c) if c == "identified_variant_id"
          else F.coalesce("_c", c).alias(c) if c == "identification_confidence" else F.col(c)
          for c in submissions.columns])
    listed = candidates.join(names, "variant_id", "left").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "variant_id", "name", "score", "method"))).alias("c"))  # <= k rows
    payload = F.to_json(F.struct(
        F.col("variant_id").isNotNull().alias("identified"), F.col("confidence"),
        F.transform(F.coalesce("c", F.array().cast(listed.schema["c"].dataType)), lambda x: F.struct(
            x["variant_id"].alias("variant_id"), x["name"].alias("name"), x["score"].alias("score"),
            x["method"].alias("method"))).alias("candidates")))
    audit = decisions.join(listed, "query_id", "left").select(
        F.col("query_id").alias("submission_id"), F.lit("identification_service").alias("actor"),
        F.lit("identification.completed").alias("action"), payload.alias("payload"),
        F.lit(now).cast("timestamp").alias("created_at"))
    return updated, audit
