"""Structured Streaming forms of the operational jobs.

Late data: the watermark is ten minutes, twice the five-minute stale bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slabspark import params as P
from slabspark.session import materialize
from slabspark.sources.ledger import KeyLedger
from slabspark.sources.store import TableStore

STALE_OUTPUT = "submission_id STRING, status STRING, rejection_reason STRING, updated_at TIMESTAMP, " \
    "stale_for_seconds DOUBLE"
LIFECYCLE_OUTPUT = "submission_id STRING, previous STRING, status STRING, at TIMESTAMP, legal BOOLEAN"


def run_available(query_writer, checkpoint: str):
    """Start a writer on everything available now and wait for it."""
    query = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# ------------------------------------------------------------ stale runs


def _watch_run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        status, seen_ms, reason = state.get
        state.remove()
        if status == "processing":
            now_ms = state.getCurrentWatermarkMs()
            yield pd.DataFrame({
                "submission_id": [key[0]], "status": ["failed"], "rejection_reason": [reason or P.RECONCILE_REASON],
                "updated_at": [pd.Timestamp(seen_ms, unit="ms")], "stale_for_seconds": [(now_ms - seen_ms) / 1000.0]})
        return
    status, seen_ms, reason = state.get if state.exists else (None, -1, None)
    for pdf in batches:
        newest = pdf.sort_values(["updated_at", "status"]).iloc[-1]
        at = int(newest["updated_at"].value // 1_000_000)
        if at >= seen_ms:
            status, seen_ms = newest["status"], at
            reason = None if pd.isna(newest["rejection_reason"]) else newest["rejection_reason"]
    if status != "processing":
        if state.exists:
            state.remove()
        return
    state.update((status, seen_ms, reason))
    # strict bound: the timer fires once the watermark passes seen + 5 min
    state.setTimeoutTimestamp(max(seen_ms + P.STALE_SECONDS * 1000, state.getCurrentWatermarkMs() + 1))


def stale_runs(updates: DataFrame, watermark: str = P.WATERMARK) -> DataFrame:
    """Stream of (submission_id, status, rejection_reason, updated_at) -> runs that went stale, once each."""
    return updates.withWatermark("updated_at", watermark).groupBy("submission_id").applyInPandasWithState(
        _watch_run, STALE_OUTPUT, "status STRING, seen_ms LONG, reason STRING", "append",
        GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------- lifecycle


def _legal(previous: str | None, current: str) -> bool:
    from slabspark.operators.ops import LEGAL

    if previous is None:
        return current == "pending"
    if previous == current and previous in ("processing", "completed", "failed"):
        return True
    return current in LEGAL.get(previous, ())


def _walk(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    previous = state.get[0] if state.exists else None
    # Order needs all events of one submission in one micro-batch; the source's
    # maxFilesPerTrigger / maxBytesPerTrigger bounds that number.
    pdf = pd.concat([b[["at", "event_id", "status"]] for b in batches]).sort_values(["at", "event_id"])
    steps = pdf["status"].tolist()
    earlier = [previous, *steps[:-1]]
    state.update((steps[-1],))
    yield pd.DataFrame({"submission_id": key[0], "previous": earlier, "status": steps, "at": pdf["at"].to_numpy(),
                        "legal": [_legal(p, c) for p, c in zip(earlier, steps)]})


def lifecycle_steps(events: DataFrame) -> DataFrame:
    """Stream of (submission_id, event_id, status, at) -> every step with its predecessor and legality."""
    return events.groupBy("submission_id").applyInPandasWithState(
        _walk, LIFECYCLE_OUTPUT, "status STRING", "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------- windows and budgets


def rate_windows(requests: DataFrame, key: str, ts: str, per_minute: int, watermark: str = P.WATERMARK) -> DataFrame:
    """Requests per key and minute, with the excess flag."""
    counted = requests.withWatermark(ts, watermark).groupBy(F.window(ts, "1 minute"), key).agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("minute"), key, "n", (F.col("n") > per_minute).alias("over_limit"))


def daily_budget_windows(calls: DataFrame, source: str, ts: str, cost: Column, cap: int = P.DAILY_CAP,
                         watermark: str = P.WATERMARK) -> DataFrame:
    """Spend per source and UTC day against the cap."""
    spent = calls.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day"), source).agg(F.sum(cost).alias("spent"))
    return spent.select(F.to_date("window.start").alias("day"), source, "spent",
                        (F.col("spent") > cap).alias("exhausted"))


# --------------------------------------------------- micro-batch writers


def stream_of(batch: DataFrame) -> str:
    """The id of the stream a micro-batch belongs to; it lives in the checkpoint and outlasts restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def upsert_batches(store: TableStore, table: str, keys: list[str], schema: T.StructType,
                   partition_by: list[str], order: list[Column]) -> Callable:
    """foreachBatch body that keeps the last row per key in ``order``.

    Only the partitions a batch touches are rewritten.  The batch's number is
    committed with its rows, so that a batch counts once however often it runs.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        store.upsert_partitions(table, batch.select(*schema.fieldNames()), keys, schema, partition_by, order, (stream_of(batch), epoch))

    return write


def ingest_new(store: TableStore, table: str, keys: list[str], schema: T.StructType) -> Callable:
    """foreachBatch body that appends only keys the table does not hold yet.

    A ledger of the keys says which are new, so the table itself isn't read.
    Rows are committed with the number of their batch, then the ledger follows;
    if the writer is lost in between, the ledger catches up first.  Duplicates
    inside one batch collapse to one row per key.
    """
    ledger = KeyLedger(store, table, keys, schema)

    def write(batch: DataFrame, number: int) -> None:
        epoch = (stream_of(batch), number)
        ledger.repair()
        if store.committed(table, epoch[0]) >= number:
            return
        rest = [c for c in schema.fieldNames() if c not in keys]
        one = batch.groupBy(*keys).agg(F.min(F.struct(*rest, F.lit(0))).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])
        one = materialize(one, "batch")
        fresh = materialize(ledger.unseen(one), "fresh-keys")
        rows = one.join(fresh, [one[k].eqNullSafe(fresh[k]) for k in keys], "left_semi")
        store.append(table, rows.select(*schema.fieldNames()), epoch=epoch)
        ledger.add(fresh, epoch)

    return write


def accumulate_batches(store: TableStore, catalog: DataFrame, dim: int, now: str | None = None) -> Callable:
    """foreachBatch body for continuous exemplar accumulation.

    The exemplar rows carry the cert they came from, so the consumed log is
    rebuilt from them when a batch is replayed half-written.  Both tables
    commit the batch's number with its rows.
    """
    from slabspark.plans.jobs import accumulate_exemplars

    def write(batch: DataFrame, epoch: int) -> None:
        accumulate_exemplars(store, batch, catalog, dim, added_at=now, epoch=(stream_of(batch), epoch))

    return write
