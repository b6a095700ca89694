"""Operations: shots, budgets, stage timings, lifecycle and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions.scalars import age_seconds
from slabspark.operators.hot import exact_percentiles, ordered_scan


def latest_shots(shots: DataFrame) -> DataFrame:
    """Newest shot per (submission, kind); at equal times the lower id stays."""
    rest = [c for c in shots.columns if c not in ("submission_id", "kind")]
    row = F.min_by(F.struct(*rest), F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), F.col("id")))
    return shots.groupBy("submission_id", "kind").agg(row.alias("s")).select("submission_id", "kind", "s.*")


def usable_shots(latest: DataFrame) -> DataFrame:
    """Failed optional shots are dropped, everything else stays."""
    return latest.where(~(F.col("kind").isin(*P.OPTIONAL_SHOTS) & ~F.col("quality_passed")))


def missing_shots(submissions: DataFrame, shots: DataFrame, required=P.REQUIRED_SHOTS) -> DataFrame:
    """Required kinds a submission has no passing shot of."""
    wanted = submissions.select(F.col("id").alias("submission_id"),
                                F.explode(F.array(*[F.lit(k) for k in required])).alias("kind"))
    passing = shots.where("quality_passed").select("submission_id", "kind")
    return wanted.join(passing, ["submission_id", "kind"], "left_anti")


def daily_budget(calls: DataFrame, source: str, ts: str, call_id: str, cost: Column | int = 1,
                 cap: int = P.DAILY_CAP) -> DataFrame:
    """Running cost per source and UTC day; a call is accepted while within the cap.

    Costs are positive, so the first refused call of a day ends it.
    """
    cost = F.lit(cost) if isinstance(cost, int) else cost
    rows = calls.withColumns({"day": F.to_date(ts), "_cost": cost.cast("bigint")})
    out = ordered_scan(rows, [source, "day"], [(ts, True), (call_id, True)], sums={"spent": F.col("_cost")})
    return out.drop("_cost").withColumn("accepted", F.col("spent") <= F.lit(cap))


def stage_durations(log: DataFrame, key: str, ts: str, action: str, row_id: str) -> DataFrame:
    """Seconds since the previous event of the same key, and where it came from."""
    scan = ordered_scan(log, [key], [(ts, True), (row_id, True)], lags={"_prev_ts": (ts, 1), "previous": (action, 1)})
    return scan.withColumn("seconds", age_seconds(F.col(ts), F.col("_prev_ts"))).drop("_prev_ts")


def latency_percentiles(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    counts = log.groupBy(*keys).agg(F.count(value).alias("n"))
    return exact_percentiles(log, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).join(counts, keys)


# ---------------------------------------------------------------- lifecycle

LEGAL = {
    "pending": ("capturing", "rejected_quality", "processing"),
    "capturing": ("capturing", "processing", "rejected_quality"),
    "rejected_quality": ("capturing",),
    "processing": ("completed", "failed", "capturing"),
}


def legal_transition(previous: Column, current: Column) -> Column:
    """First event must be pending; repeats in a running or final state are no-ops."""
    ok = (previous.isNull() & (current == "pending")) | (
        (previous == current) & previous.isin("processing", "completed", "failed"))
    for source, targets in LEGAL.items():
        ok = ok | ((previous == source) & current.isin(*targets))
    return F.coalesce(ok, F.lit(False))


def lifecycle(events: DataFrame, key: str, ts: str, status: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(current status per key, illegal transitions)."""
    current = events.groupBy(key).agg(
        F.max_by(status, F.struct(ts, row_id)).alias("status"), F.max(ts).alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"))
    steps = ordered_scan(events, [key], [(ts, True), (row_id, True)], lags={"previous": (status, 1)})
    return current, steps.where(~legal_transition(F.col("previous"), F.col(status)))


def reconcile(submissions: DataFrame, now: Column, stale_seconds: int = P.STALE_SECONDS,
              batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(submissions with stale runs failed, one audit row per flipped run).

    ``batch`` bounds one tick to the longest-waiting runs; without it every
    stale run is flipped.  Running it twice changes nothing more.
    """
    stale = (F.col("status") == "processing") & (age_seconds(now, F.col("updated_at")) > F.lit(stale_seconds))
    if batch is None:
        marked = submissions.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    else:
        picked = submissions.where(stale).orderBy("updated_at", "id").limit(batch).select(
            "id", F.lit(True).alias("_hit"))
        marked = submissions.join(picked, "id", "left").withColumn("_stale", F.coalesce("_hit", F.lit(False))).drop(
            "_hit")
    reason = F.coalesce(F.when(F.col("rejection_reason") != "", F.col("rejection_reason")), F.lit(P.RECONCILE_REASON))
    changes = {"status": F.when(F.col("_stale"), F.lit("failed")).otherwise(F.col("status")),
               "rejection_reason": F.when(F.col("_stale"), reason).otherwise(F.col("rejection_reason")),
               "updated_at": F.when(F.col("_stale"), now).otherwise(F.col("updated_at"))}
    audit = marked.where("_stale").select(
        F.col("id").alias("submission_id"), F.lit("reconciler").alias("actor"),
        F.lit(P.RECONCILE_ACTION).alias("action"),
        F.to_json(F.struct(age_seconds(now, F.col("updated_at")).alias("stale_for_seconds"))).alias("payload"),
        now.alias("created_at"))
    updated = marked.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in submissions.columns])
    return updated, audit
