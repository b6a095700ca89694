"""Ordered lifecycle against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slabspark.operators import ops
from slabspark.streaming import jobs as J
from slabspark.streaming import ordered as O

SCHEMA = "submission_id string, event_id long, status string, at timestamp"
T0 = dt.datetime(2026, 1, 1)


def run(spark, tmp_path, batches, **kw):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = O.ordered_lifecycle(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), **kw)
    with O.rocksdb(spark):
        query = J.run_available(stream.writeStream.format("parquet").outputMode("append").option("path", out), ck)
    return sorted((tuple(r) for r in spark.read.schema(J.LIFECYCLE_OUTPUT).parquet(out).collect()), key=repr), query


def batch_form(spark, rows, until):
    events = spark.createDataFrame([r for r in rows if r[3] and r[3] <= until], SCHEMA)
    steps = ops.ordered_scan(events, ["submission_id"], [("at", True), ("event_id", True)], lags={"previous": ("status", 1)})
    out = steps.select("submission_id", "previous", "status", "at", ops.legal_transition(F.col("previous"), F.col("status")).alias("legal"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_batches_equal_the_batch_form(spark, tmp_path, seed):
    rng = random.Random(seed)
    status = ["pending", "capturing", "processing", "completed", "failed", "rejected_quality"]
    rows = [(f"s{rng.randrange(12)}", i, rng.choice(status), T0 + dt.timedelta(seconds=20 * i, microseconds=rng.choice([0, 1, 999, 500_000]))) for i in range(240)]
    rows += [(r[0], 1000 + r[1], "capturing", r[3]) for r in rows[::17]]  # equal times
    # every event comes up to nine minutes late
    arrival = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.randrange(540)))
    batches = [arrival[i : i + 40] for i in range(0, len(arrival), 40)]
    got, _ = run(spark, tmp_path, batches)
    until = max(r[3] for r in rows) - dt.timedelta(minutes=10)
    assert got == batch_form(spark, rows, until.replace(microsecond=until.microsecond // 1000 * 1000))
    assert len(got) > 150


def test_state_ends(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[("a", 1, "pending", at(0)), ("b", 2, "pending", at(0)), (None, 3, "pending", at(0)), ("c", 4, None, at(0))], [("a", 5, "completed", at(1))],
               [("x", 6, "pending", at(30))], [("x", 7, "capturing", at(90))], [("b", 8, "capturing", at(100)), ("a", 9, "pending", at(100))], [("x", 10, "processing", at(130))]]
    got, query = run(spark, tmp_path, batches, keep_final=1800, keep_any=7200)
    assert ("b", "pending", "capturing", at(100), True) in got  # still known
    assert ("a", None, "pending", at(100), True) in got  # forgotten half an hour after its end
    assert not [g for g in got if g[0] in (None, "c")]


def test_state_stays_small(spark, tmp_path):
    """Each batch brings new submissions that end; the state holds those of the last ones only."""
    batches = [[(f"{n}-{i}", k, s, T0 + dt.timedelta(hours=n, seconds=k)) for i in range(50) for k, s in enumerate(("pending", "processing", "completed"))] for n in range(6)]
    got, query = run(spark, tmp_path, batches, keep_final=1800)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) < 2.5 * 50 * 6 and sizes[-1] <= max(sizes)
    assert len(got) == 5 * 50 * 3


def test_work_follows_buckets_not_submissions(spark, tmp_path):
    """Many submissions of few events: one state row for each bucket's chunk of events and one for its timer."""
    status = ["pending", "processing", "completed"]
    rows = [(f"s{i}", 3 * i + k, status[k], T0 + dt.timedelta(seconds=k)) for i in range(3000) for k in range(3)]
    got, query = run(spark, tmp_path, [rows, [("late", 1, "pending", T0 + dt.timedelta(hours=1))]])
    first = next(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"] and p["numInputRows"])
    assert first <= 2 * O.BUCKETS < 2 * 3000
    assert len(got) == 9000 and all(g[4] for g in got)


@pytest.mark.parametrize("buckets", [1, 3])
def test_submissions_that_share_a_bucket(spark, tmp_path, monkeypatch, buckets):
    rng = random.Random(buckets)
    rows = [(f"s{rng.randrange(5)}", i if i % 9 else None, rng.choice(["pending", "processing", "completed"]), T0 + dt.timedelta(seconds=30 * i)) for i in range(150)]
    arrival = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=rng.randrange(540)))
    got, _ = run(spark, tmp_path, [arrival[i : i + 30] for i in range(0, 150, 30)], buckets=buckets)
    assert got == batch_form(spark, rows, max(r[3] for r in rows) - dt.timedelta(minutes=10))


def test_ended_submissions_leave_a_shared_bucket(spark, tmp_path):
    batches = [[(f"{n}-{i}", i, "completed", T0 + dt.timedelta(hours=n)) for i in range(40)] + [("on", n, "processing", T0 + dt.timedelta(hours=n, seconds=1))] for n in range(6)]
    got, query = run(spark, tmp_path, batches, keep_final=1800, keep_any=86_400, buckets=1)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) < 2 * 40 + 10
    assert [g[1] for g in sorted((g for g in got if g[0] == "on"), key=lambda g: g[3])] == [None] + ["processing"] * 4
