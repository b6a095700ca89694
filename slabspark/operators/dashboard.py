"""Workbench views: card rows, filters, statistics, stage states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions.scalars import age_seconds


def first_flag() -> Column:
    """First applicable flag text, null when the card is clean."""
    preliminary = F.col("has_grade") & F.col("final").isNull() & (F.col("corners").isNull() | F.col("surface").isNull())
    return F.coalesce(
        F.when(preliminary, F.lit("Preliminary — corners/surface heads not trained")),
        F.when(F.col("status") == "rejected_quality", F.lit("Rejected at quality gate")),
        F.when(F.col("rejection_reason") != "", F.col("rejection_reason")))


def card_views(submissions: DataFrame) -> DataFrame:
    """Submission with primary grade, card and verdict joined -> view row.

    Needs id, status, rejection_reason, created_at, completed_at, card_name,
    set_code, card_number, has_grade, the five grade columns, grade_confidence,
    auth_verdict and auth_confidence.
    """
    sid = F.col("id").cast("string")
    return submissions.withColumn("flag", first_flag()).select(
        "id", "status",
        F.concat(F.lit("PG-"), F.upper(F.substring(sid, 1, 4)), F.lit("-"), F.upper(F.substring(sid, 10, 4)))
        .alias("short_id"),
        F.coalesce("card_name", F.lit("Unidentified card")).alias("name"),
        F.coalesce("set_code", F.lit("—")).alias("set"), F.coalesce("card_number", F.lit("—")).alias("number"),
        F.coalesce("completed_at", "created_at").alias("captured_at"),
        "centering", "corners", "edges", "surface", "final",
        F.coalesce("grade_confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("auth_verdict", F.lit("unverified")).alias("auth_verdict"),
        F.coalesce("auth_confidence", F.lit(0.0)).alias("auth_confidence"), "flag")


def is_top() -> Column:
    return F.coalesce(F.col("final") >= 9, F.lit(False))


def is_pending() -> Column:
    return F.col("corners").isNull() | F.col("surface").isNull()


def is_flagged() -> Column:
    return F.col("flag").isNotNull() | (F.col("auth_verdict") != "authentic")


def matches(query: str) -> Column:
    q = F.lit(query.lower())
    return F.lower("name").contains(q) | F.lower("set").contains(q) | F.lower(F.col("id").cast("string")).contains(q)


def filter_views(views: DataFrame, which: str = "all", query: str = "") -> DataFrame:
    conditions = {"all": F.lit(True), "top": is_top(), "pending": is_pending(), "flagged": is_flagged()}
    out = views.where(conditions[which])
    return out.where(matches(query)) if query.strip() else out


def fitting_filters(views: DataFrame, query: str = "") -> DataFrame:
    """A row for each view and filter it passes (``which``: top, pending, flagged, and search with a query), in one pass."""
    conditions = {"top": is_top(), "pending": is_pending(), "flagged": is_flagged(), **({"search": matches(query)} if query.strip() else {})}
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))
    return views.select("*", F.explode(names).alias("which"))


def workbench_stats(views: DataFrame) -> DataFrame:
    """Counts and extremes in one map-side combined aggregate."""
    has = F.col("final").isNotNull()
    best = F.when(has, F.struct("final", "id"))
    return views.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_flagged()).alias("flagged"),
        F.count_if(is_pending()).alias("pending_heads"), F.count_if(is_top()).alias("top_tier"),
        F.avg("final").alias("mean_final"),
        F.max_by("name", best).alias("highest_name"), F.max("final").alias("highest_grade"),
        F.min_by("name", best).alias("lowest_name"), F.min("final").alias("lowest_grade"))


def stage_states(submissions: DataFrame, now: Column) -> DataFrame:
    """One row per submission and stage with its status and elapsed seconds."""
    stages = F.array(*[F.struct(F.lit(i).alias("stage_ix"), F.lit(k).alias("stage")) for i, k in enumerate(P.STAGES)])
    rows = submissions.select("id", "status", "created_at", "completed_at", F.inline(stages))
    status = F.col("status")
    end = F.coalesce(F.col("completed_at"), F.when(status == "processing", now))
    return rows.select(
        "id", "stage_ix", "stage",
        F.when(status == "completed", F.lit("done")).when(status == "processing", F.lit("running"))
        .when(status == "failed", F.lit("failed"))
        .when((status == "rejected_quality") & (F.col("stage_ix") == 0), F.lit("failed"))
        .otherwise(F.lit("pending")).alias("stage_status"),
        age_seconds(end, F.col("created_at")).alias("elapsed_seconds"))


def owner_page(submissions: DataFrame, owner: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One owner's submissions, newest first (limit clamped to 1..200)."""
    size = max(1, min(200, limit))
    return submissions.where(F.col("user_id") == owner).orderBy(F.col("created_at").desc(), "id").offset(
        max(0, offset)).limit(size)
