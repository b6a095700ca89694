"""Lifecycle steps in the order of events, whatever the order of arrival.

Submissions are dealt out to buckets by a hash; state and calls belong to a
bucket, since a call for each submission costs far more than its few events.
Events wait in a list until the watermark has passed them; then none that
belongs before them can come any more, and they are told in order.  A timer
for each bucket names the earliest event that waits, or the next look for
submissions whose time is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slabspark import params as P
from slabspark.streaming.jobs import LIFECYCLE_OUTPUT, _legal

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of event time without news after which a run in a final state, or in any, is forgotten.
FINAL, KEEP_FINAL, KEEP_ANY = ("completed", "failed"), 86_400, 30 * 86_400
#: Groups that submissions are dealt out to: several for each core of a large cluster.  A checkpoint goes with its number.
BUCKETS = 1024
#: Events wait in chunks, each a row of the state that holds up to so many.
CHUNK = 10_000
_EVENTS = "submission_id ARRAY<STRING>, at_us ARRAY<LONG>, event_id ARRAY<LONG>, status ARRAY<STRING>"
#: Takes the place of an event id that is null, which comes first.
_NO_ID = -(1 << 63)


def _us(stamps: pd.Series) -> list[int]:
    return stamps.astype("datetime64[us]").astype("int64").tolist()


class _Steps(StatefulProcessor):
    """``told``: last status told of each submission and its time; ``timer``: the bucket's timer, and when ended submissions are next looked for."""

    def __init__(self, keep_final: int, keep_any: int):
        self.keep_final, self.keep_any = keep_final, keep_any
        self.pause = 1000 * max(1, min(keep_final, keep_any))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENTS)
        self.told = handle.getMapState("told", "submission_id STRING", "status STRING, at_us LONG")
        self.timer = handle.getValueState("timer", "next_ms LONG, look_ms LONG")

    def close(self) -> None:
        pass

    def _end(self, status: str, at_us: int) -> int:
        """Millisecond until which a step with this status is remembered, whether or not it has been looked for by then."""
        return at_us // 1000 + 1000 * (self.keep_final if status in FINAL else self.keep_any)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, look = self.timer.get() or (None, None)
        first = timer
        for pdf in rows:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a : a + CHUNK]
                stamps = _us(part["at"])
                self.waiting.appendValue((part["submission_id"].tolist(), stamps, part["event_id"].tolist(), part["status"].tolist()))
                mine = _due(min(stamps))
                first = mine if first is None else min(first, mine)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            self.timer.update((first, look))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, look = self.timer.get()
        watermark = timerValues.getCurrentWatermarkInMs()
        ready, rest = [], []
        for chunk in self.waiting.get():
            for event in zip(*chunk):
                (ready if event[1] <= watermark * 1000 else rest).append(event)
        if rest and ready:
            self.waiting.put([tuple(map(list, zip(*rest[a : a + CHUNK]))) for a in range(0, len(rest), CHUNK)])
        elif ready:
            self.waiting.clear()
        ready.sort()
        earlier = []
        for name, events in groupby(ready, itemgetter(0)):
            status, at = self.told.getValue((name,)) or (None, None)
            for _, stamp, _, step in events:
                earlier.append(None if status is None or stamp > self._end(status, at) * 1000 else status)
                status, at = step, stamp
            self.told.updateValue((name,), (status, at))
        look = self._look(look, watermark, bool(ready))
        timers = [_due(min(e[1] for e in rest))] if rest else []
        timers += [] if look is None else [look]
        if timers:
            self.handle.registerTimer(min(timers))
            self.timer.update((min(timers), look))
        else:
            self.timer.clear()
        if ready:
            names, stamps, _, steps = zip(*ready)
            yield pd.DataFrame({"submission_id": names, "previous": pd.Series(earlier, dtype=object), "status": pd.Series(steps, dtype=object),
                                "at": pd.Series(stamps, dtype="int64").astype("datetime64[us]"), "legal": [_legal(p, c) for p, c in zip(earlier, steps)]})

    def _look(self, look: int | None, watermark: int, news: bool) -> int | None:
        """Forget ended submissions if it is time to; when to look next, if any is left."""
        if look is None:
            return watermark + self.pause if news else None
        if look > watermark:
            return look
        held = [(name[0], self._end(*last)) for name, last in self.told.iterator()]
        ended = [name for name, end in held if end <= watermark]
        for name in ended:
            self.told.removeKey((name,))
        return watermark + self.pause if len(ended) < len(held) else None


def _due(at_us: int) -> int:
    """The first millisecond by which an event has passed."""
    return -(-at_us // 1000)


def ordered_lifecycle(events: DataFrame, watermark: str = P.WATERMARK, keep_final: int = KEEP_FINAL, keep_any: int = KEEP_ANY, buckets: int = BUCKETS) -> DataFrame:
    """Stream of (submission_id, event_id, status, at) -> every step with its predecessor and legality.

    Steps equal those of ``ops.lifecycle`` over the events up to the watermark,
    in whatever order and batches they come; events older than the watermark on
    arrival are left out, as in any windowed stream.  State is one row for each
    submission and the events of the watermark's span.  A submission is known
    for ``keep_final`` seconds of event time after a final status and for
    ``keep_any`` after any other; if it comes back later it begins anew.  Its
    row goes at the bucket's next look, the shorter of both spans later at
    most.  Rows without an id, a time or a status are left out.  Needs
    ``ROCKSDB`` as the session's state store.
    """
    known = events.where("submission_id is not null and at is not null and status is not null")
    name = F.col("submission_id").cast("string")
    rows = known.select(F.pmod(F.xxhash64(name), F.lit(buckets)).alias("bucket"), name.alias("submission_id"), F.coalesce("event_id", F.lit(_NO_ID)).alias("event_id"), "status", "at")
    return rows.withWatermark("at", watermark).groupBy("bucket").transformWithStateInPandas(_Steps(keep_final, keep_any), LIFECYCLE_OUTPUT, "Append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
