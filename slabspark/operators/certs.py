"""Population statistics and certificate assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabspark.operators.hot import competition_ranks, ordered_scan, row_numbers, split_hot
from slabspark.operators.robust import attach
from slabspark.params import SCHEMES


def graded(submissions: DataFrame, grades: DataFrame, scheme: str = "psa") -> DataFrame:
    """Completed submissions with their grade of one scheme."""
    s = submissions.where(F.col("status") == "completed").select(
        F.col("id").alias("submission_id"), F.col("identified_variant_id").alias("variant_id"), "completed_at")
    return s.join(grades.where(F.col("scheme") == scheme).select("submission_id", "final"), "submission_id")


def population(rows: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Rank, count, maximum and chronological index within a variant.

    Needs submission_id, variant_id, final, completed_at.  ``bound``
    (variant_id, one row per submission) lets the size check skip the join
    with the grades.
    """
    rows = rows.where(F.col("variant_id").isNotNull()).select("submission_id", "variant_id", "final", "completed_at")
    return with_population(rows, "variant_id", bound).drop("final", "completed_at")


def with_population(rows: DataFrame, peers: str, bound: DataFrame | None = None) -> DataFrame:
    """Add the four population columns within groups of ``peers``.

    Ordinary groups take two windows over one shuffle; a group with very many
    submissions is ranked through counts and range slices.
    """
    ordinary, hot = split_hot(rows, [peers], bound)
    whole = Window.partitionBy(peers)
    by_grade = whole.orderBy(F.col("final").desc_nulls_last())
    by_time = whole.orderBy(F.col("completed_at"), F.col("submission_id"))
    out = ordinary.select(
        "*", F.count(F.lit(1)).over(whole).alias("total_graded"),
        F.rank().over(by_grade).cast("bigint").alias("this_rank"),
        F.max("final").over(whole).alias("max_grade"),
        F.row_number().over(by_time).cast("bigint").alias("chronological_index"))
    if hot is None:
        return out
    totals = hot.groupBy(peers).agg(F.count(F.lit(1)).alias("total_graded"), F.max("final").alias("max_grade"))
    placed = row_numbers(competition_ranks(hot, [peers], "final", "this_rank"), [peers],
                         [("completed_at", True), ("submission_id", True)], "chronological_index")
    return out.unionByName(attach(placed, totals, [peers]).select(*out.columns))


def primary_grades(grades: DataFrame) -> DataFrame:
    """PSA grade of a submission, else its earliest one."""
    rest = [c for c in grades.columns if c != "submission_id"]
    when = F.col("created_at") if "created_at" in rest else F.lit(0)
    row = F.min_by(F.struct(*rest), F.struct((F.col("scheme") != "psa").alias("o"), when.alias("t"), F.col("scheme")))
    return grades.groupBy("submission_id").agg(row.alias("g")).select("submission_id", "g.*")


def identified_cards(submissions: DataFrame, variants: DataFrame, sets: DataFrame) -> DataFrame:
    """Variant, set code and confidence of each submission; null when unidentified."""
    v = variants.select(F.col("id").alias("identified_variant_id"), F.col("name").alias("card_name"), "card_number",
                        "set_id")
    s = sets.select(F.col("id").alias("set_id"), F.col("code").alias("set_code"))
    return submissions.join(v, "identified_variant_id", "left").join(s, "set_id", "left").select(
        *submissions.columns, "card_name", "set_code", "card_number",
        F.when(F.col("card_name").isNotNull(), F.coalesce("identification_confidence", F.lit(0.0)))
        .alias("match_confidence"))


def latest_within(requests: DataFrame, snapshots: DataFrame, keys: list[str], at: str, fetched: str,
                  ttl_seconds: int, request_id: str, values: list[str]) -> DataFrame:
    """Newest snapshot per request with fetched in (at - ttl, at]; misses count as snapshots.

    Requests and snapshots are ordered together and the newest snapshot is
    carried forward, which stays one pass however many rows share a key.
    """
    snap = snapshots.select(*keys, F.col(fetched).alias("_t"), F.lit(0).alias("_k"), F.lit("").alias("_id"),
                            F.struct(F.col(fetched).alias("fetched_at"), *values).alias("_snap"))
    # several snapshots of one instant: keep one, so the order below is total
    snap = snap.groupBy(*keys, "_t", "_k", "_id").agg(F.max("_snap").alias("_snap"))
    # the whole request rides along, so nothing has to be joined back
    ask = requests.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_k"),
                          F.col(request_id).cast("string").alias("_id"),
                          F.lit(None).cast(snap.schema["_snap"].dataType).alias("_snap"),
                          F.struct(*requests.columns).alias("_ask"))
    both = ordered_scan(snap.unionByName(ask, allowMissingColumns=True), keys,
                        [("_t", True), ("_k", True), ("_id", True)], lasts={"_found": "_snap"},
                        bound=snapshots.select(*keys).unionByName(requests.select(*keys)))
    hits = both.where(F.col("_k") == 1)
    age = F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_found.fetched_at").cast("timestamp"))
    fresh = age < F.lit(ttl_seconds * 1_000_000)
    for key in keys:
        fresh = fresh & F.col(key).isNotNull()
    return hits.select("_ask.*", *[F.when(fresh, F.col(f"_found.{c}")).alias(c) for c in ("fetched_at", *values)])


def certificates(submissions: DataFrame, grades: DataFrame, authenticity: DataFrame, variants: DataFrame,
                 sets: DataFrame) -> DataFrame:
    """One row per completed submission: card, grades, verdict, population.

    A grade list is built from one pick per scheme, so its size is fixed.
    """
    done = submissions.where(F.col("status") == "completed")
    cards = identified_cards(done, variants, sets).withColumnRenamed("id", "submission_id")
    # one pass over the grades gives the list and the grade that is ranked
    parts = F.struct("scheme", "centering", "corners", "edges", "surface", "final", "confidence")
    pick = {name: F.max(F.when(F.col("scheme") == name, parts)) for name in sorted(SCHEMES)}
    listed = grades.groupBy("submission_id").agg(
        F.array_compact(F.array(*pick.values())).alias("grades"), pick["psa"].alias("psa"))
    auth = authenticity.select("submission_id", F.col("verdict").alias("auth_verdict"),
                               F.col("confidence").alias("auth_confidence"), F.col("reasons").alias("auth_reasons"))
    # a submission without variant or PSA grade is its own group, so no null group builds up
    variant = F.concat(F.lit("v"), F.col("identified_variant_id"))
    ranked = F.col("psa").isNotNull() & F.col("identified_variant_id").isNotNull()
    rows = cards.join(listed, "submission_id", "left").join(auth, "submission_id", "left").withColumns({
        "ranked": ranked, "final": F.col("psa.final"),
        "peers": F.when(ranked, variant).otherwise(F.concat(F.lit("s"), F.col("submission_id")))})
    bound = done.select(variant.alias("peers")).where(F.col("peers").isNotNull())
    pop = with_population(rows, "peers", bound)
    return pop.select(
        "submission_id", "completed_at", "identified_variant_id", "card_name", "set_code", "card_number",
        "match_confidence", F.coalesce("grades", F.array().cast(listed.schema["grades"].dataType)).alias("grades"),
        "auth_verdict", "auth_confidence", "auth_reasons",
        *[F.when(F.col("ranked"), F.col(c)).alias(c)
          for c in ("total_graded", "this_rank", "max_grade", "chronological_index")])
