"""Operations over events and line items: budgets, timings, streams, robust statistics."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions import quads
from slabspark.operators import ops
from slabspark.operators import robust as R
from slabspark.registry import views as V
from slabspark.registry.core import Tables, query
from slabspark.sources.store import TableStore

# ------------------------------------------------------------ batch windows


@query("daily_budget", sql="""SELECT event_id, event_type, CAST(spent AS BIGINT) AS spent, spent <= 100 AS accepted FROM (
  SELECT event_id, event_type, sum(CASE WHEN value > 20 THEN 2 ELSE 1 END) OVER (
    PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)""")
def daily_budget(t: Tables) -> DataFrame:
    """Running daily cost per source against the cap; paired calls cost two."""
    cost = F.when(F.col("value") > 20, 2).otherwise(1)
    return ops.daily_budget(t.events, "event_type", "ts", "event_id", cost).select(
        "event_id", "event_type", "spent", "accepted")


@query("stage_durations", sql="""SELECT event_id, previous, (epoch_us(ts) - epoch_us(p)) / 1e6 AS seconds FROM (
  SELECT event_id, ts, lag(ts) OVER w AS p, lag(event_type) OVER w AS previous FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def stage_durations(t: Tables) -> DataFrame:
    """Seconds between consecutive events of a key, with the transition."""
    return ops.stage_durations(t.events, "user_id", "ts", "event_type", "event_id").select(
        "event_id", "previous", "seconds")


@query("latency_percentiles", sql="""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n
FROM events GROUP BY 1""")
def latency_percentiles(t: Tables) -> DataFrame:
    """Exact latency percentiles per route."""
    rows = ops.latency_percentiles(t.events, ["event_type"], "value")
    return rows.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


LIFE_SQL = """life AS (SELECT user_id AS submission_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'pending'
  WHEN 'view' THEN 'capturing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status
  FROM events)"""


def _life(t: Tables) -> DataFrame:
    kind = F.create_map(*[F.lit(v) for v in ("signup", "pending", "view", "capturing", "click", "processing",
                                             "purchase", "completed", "error", "failed")])
    return t.events.select(F.col("user_id").alias("submission_id"), "event_id", "ts", kind[F.col("event_type")].alias("status"))


@query("lifecycle_status", sql=f"""WITH {LIFE_SQL}
SELECT submission_id, arg_max(status, event_id) AS status, count(*) AS n_events FROM life GROUP BY 1""")
def lifecycle_status(t: Tables) -> DataFrame:
    """Latest status per submission folded from its events."""
    return ops.lifecycle(_life(t), "submission_id", "ts", "status", "event_id")[0].select("submission_id", "status", "n_events")


ILLEGAL = """NOT coalesce((previous IS NULL AND status = 'pending')
    OR (previous = status AND previous IN ('processing', 'completed', 'failed', 'capturing'))
    OR (previous = 'pending' AND status IN ('capturing', 'rejected_quality', 'processing'))
    OR (previous = 'capturing' AND status IN ('processing', 'rejected_quality'))
    OR (previous = 'processing' AND status IN ('completed', 'failed', 'capturing')), false)"""


@query("illegal_transitions", sql=f"""WITH {LIFE_SQL}
SELECT event_id, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY submission_id ORDER BY ts, event_id) AS previous
  FROM life) WHERE {ILLEGAL}""")
def illegal_transitions(t: Tables) -> DataFrame:
    """Steps the status model does not allow."""
    return ops.lifecycle(_life(t), "submission_id", "ts", "status", "event_id")[1].select("event_id", "previous", "status")


@query("reconcile", sql=f"""WITH {V.SUBMISSIONS_SQL},
clock AS (SELECT max(updated_at) AS now FROM submissions)
SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status,
  CASE WHEN stale THEN coalesce(rejection_reason, 'worker_timeout_reconciled') ELSE rejection_reason END AS rejection_reason,
  CASE WHEN stale THEN 1 ELSE 0 END AS audit_rows
FROM (SELECT s.*, status = 'processing' AND epoch(now - updated_at) > 300 AS stale FROM submissions s, clock)""")
def reconcile(t: Tables) -> DataFrame:
    """Stale runs failed with one audit row each; a kept reason stays."""
    subs = V.submissions(t)
    now = F.lit(subs.agg(F.max("updated_at")).first()[0])
    updated, audit = ops.reconcile(subs, now)
    n = audit.groupBy(F.col("submission_id").alias("id")).agg(F.count(F.lit(1)).alias("audit_rows"))
    return updated.join(n, "id", "left").select("id", "status", "rejection_reason",
                                                F.coalesce("audit_rows", F.lit(0)).alias("audit_rows"))


@query("reconcile_tick", sql=f"""WITH {V.SUBMISSIONS_SQL},
clock AS (SELECT max(updated_at) AS now FROM submissions)
SELECT id AS submission_id, 'reconciler' AS actor, 'reconcile_stale_processing' AS action FROM submissions, clock
WHERE status = 'processing' AND epoch(now - updated_at) > 300 ORDER BY updated_at, id LIMIT 50""")
def reconcile_tick(t: Tables) -> DataFrame:
    """Audit rows of one bounded tick (fifty longest-waiting runs)."""
    subs = V.submissions(t)
    now = F.lit(subs.agg(F.max("updated_at")).first()[0])
    return ops.reconcile(subs, now, batch=P.RECONCILE_BATCH)[1].select("submission_id", "actor", "action")


@query("resume_cursor", sql="""SELECT coalesce(max(event_id + 10) FILTER (event_type <> 'error'), 80000010) AS next_cert_id,
  count(*) FILTER (event_type <> 'error') AS runs FROM events""")
def resume_cursor(t: Tables) -> DataFrame:
    """Resume point over the run log; aborted runs do not move it."""
    from slabspark.sources.store import next_cursor

    stop = F.when(F.col("event_type") == "error", F.lit("ingest_aborted")).otherwise(F.col("event_type"))
    log = t.events.select((F.col("event_id") + 10).alias("ending_cert_id"), stop.alias("stop_reason"),
                          F.col("ts").cast("string").alias("timestamp"))
    return next_cursor(log, 80_000_010).select("next_cert_id", "runs")


# ----------------------------------------------------------------- streams


def _event_stream(t: Tables) -> DataFrame:
    """The events file as a stream (timestamps with the session's UTC zone)."""
    batch = t.events
    stream = t.spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


CLOSED = "FROM events, (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events) WHERE epoch_ms(date_trunc('{0}', ts)) + {1} <= mark"


@query("rate_windows", sql=f"""SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, event_type, count(*) AS n,
  count(*) > 2 AS over_limit {CLOSED.format('minute', 60000)} GROUP BY 1, 2""")
def rate_windows(t: Tables) -> DataFrame:
    """Streaming: requests per key and minute, emitted once the watermark closes the window."""
    from slabspark.streaming import jobs as J

    rows = _append_stream(t, J.rate_windows(_event_stream(t), "event_type", "ts", 2), "rates")
    return rows.withColumn("minute", F.col("minute").cast("bigint"))


@query("daily_budget_windows", sql=f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type,
  CAST(sum(CASE WHEN value > 20 THEN 2 ELSE 1 END) AS BIGINT) AS spent,
  sum(CASE WHEN value > 20 THEN 2 ELSE 1 END) > 100 AS exhausted {CLOSED.format('day', 86400000)} GROUP BY 1, 2""")
def daily_budget_windows(t: Tables) -> DataFrame:
    """Streaming: spend per source and closed day against the cap."""
    from slabspark.streaming import jobs as J

    spend = J.daily_budget_windows(_event_stream(t), "event_type", "ts", F.when(F.col("value") > 20, 2).otherwise(1))
    return _append_stream(t, spend, "spend").withColumn("day", F.col("day").cast("string"))


def _scratch(t: Tables, label: str) -> str:
    import uuid

    from slabspark.session import scratch_root

    return f"{scratch_root(t.spark)}/stream-{label}-{uuid.uuid4().hex}"


@query("incremental_ingest", sql="SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def incremental_ingest(t: Tables) -> DataFrame:
    """Streaming: only unseen keys are appended, a replay adds nothing."""
    from slabspark.streaming import jobs as J

    rows = _event_stream(t).select("user_id", "event_id")
    root = _scratch(t, "ingest")
    store = TableStore(t.spark, f"{root}/tables")
    J.run_available(rows.writeStream.foreachBatch(J.ingest_new(store, "seen", ["user_id"], rows.schema)), f"{root}/checkpoint")
    J.ingest_new(store, "seen", ["user_id"], rows.schema)(t.events.select("user_id", "event_id"), 99)
    return store.read("seen", rows.schema)


@query("ledger_ingest", sql="""SELECT user_id, count(*) AS n, 1 AS copies FROM events GROUP BY 1""")
def ledger_ingest(t: Tables) -> DataFrame:
    """Streaming: four micro-batches into a keyed table, then all of them once more under another checkpoint; each key stays single."""
    from slabspark.streaming import jobs as J

    root = _scratch(t, "ledger")
    rows = t.events.select("user_id", "event_id")
    rows.repartition(4, "event_id").write.parquet(f"{root}/source")
    store = TableStore(t.spark, f"{root}/tables")
    for attempt in range(2):
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
        J.run_available(stream.writeStream.foreachBatch(J.ingest_new(store, "seen", ["user_id"], rows.schema)), f"{root}/checkpoint-{attempt}")
    copies = store.read("seen", rows.schema).groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(copies, "user_id", "left")


@query("snapshot_versions", sql="""WITH states AS (
  SELECT 1 AS version, o_orderkey, 1 AS writer FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT 2, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
  UNION ALL SELECT 3, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END FROM orders
    WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)
SELECT version, writer, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM states GROUP BY ALL""")
def snapshot_versions(t: Tables) -> DataFrame:
    """Three keyed upserts of orders into a bucketed table; every version is read back."""
    store = TableStore(t.spark, _scratch(t, "snapshots"))
    orders = t.orders.select("o_orderkey")
    schema = orders.withColumn("writer", F.lit(1)).schema
    for writer, step in ((1, 2), (2, 3), (3, 5)):
        source = orders.where(F.col("o_orderkey") % step == 0).withColumn("writer", F.lit(writer))
        store.upsert_buckets("orders", source, ["o_orderkey"], schema, order=[F.col("writer")], buckets=16)
    versions = [store.read("orders", schema, v).withColumn("version", F.lit(v)) for v in store.versions("orders")]
    every = functools.reduce(DataFrame.unionByName, versions)
    return every.groupBy("version", "writer").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("stale_run_stream", sql="""WITH last AS (SELECT user_id, arg_max(event_type, ts) AS st, max(ts) AS seen FROM events GROUP BY 1),
mark AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM events)
SELECT CAST(user_id AS VARCHAR) AS submission_id, 'failed' AS status, 'worker_timeout_reconciled' AS rejection_reason
FROM last, mark WHERE st <> 'purchase' AND epoch_ms(seen) + 300000 < w""")
def stale_run_stream(t: Tables) -> DataFrame:
    """Streaming: runs whose last event is older than five minutes of event time."""
    from slabspark.streaming import jobs as J

    status = F.when(F.col("event_type") == "purchase", F.lit("completed")).otherwise(F.lit("processing"))
    updates = _event_stream(t).select(
        F.col("user_id").cast("string").alias("submission_id"), status.alias("status"),
        F.lit(None).cast("string").alias("rejection_reason"), F.col("ts").alias("updated_at"))
    return _append_stream(t, J.stale_runs(updates), "stale").select("submission_id", "status", "rejection_reason")


@query("lifecycle_stream", sql=f"""WITH {LIFE_SQL}
SELECT CAST(submission_id AS VARCHAR) AS submission_id, coalesce(previous, '') AS previous, status, {ILLEGAL} AS illegal, count(*) AS n
FROM (SELECT *, lag(status) OVER (PARTITION BY submission_id ORDER BY ts, event_id) AS previous FROM life) GROUP BY ALL""")
def lifecycle_stream(t: Tables) -> DataFrame:
    """Streaming: every status step with its predecessor and legality."""
    from slabspark.streaming import jobs as J

    kind = F.create_map(*[F.lit(v) for v in ("signup", "pending", "view", "capturing", "click", "processing",
                                             "purchase", "completed", "error", "failed")])
    events = _event_stream(t).select(F.col("user_id").cast("string").alias("submission_id"), "event_id",
                                     kind[F.col("event_type")].alias("status"), F.col("ts").alias("at"))
    steps = _append_stream(t, J.lifecycle_steps(events), "steps")
    return steps.groupBy("submission_id", F.coalesce("previous", F.lit("")).alias("previous"), "status",
                         (~F.col("legal")).alias("illegal")).agg(F.count(F.lit(1)).alias("n"))


@query("ordered_lifecycle_stream", sql=f"""WITH {LIFE_SQL}, mark AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM life)
SELECT CAST(submission_id AS VARCHAR) AS submission_id, coalesce(previous, '') AS previous, status, {ILLEGAL} AS illegal, count(*) AS n
FROM (SELECT *, lag(status) OVER (PARTITION BY submission_id ORDER BY ts, event_id) AS previous FROM life), mark
WHERE epoch_us(ts) <= w * 1000 GROUP BY ALL""")
def ordered_lifecycle_stream(t: Tables) -> DataFrame:
    """Streaming: the same steps from batches in which earlier events follow later ones, told as the watermark passes."""
    from slabspark.streaming import ordered

    kind = F.create_map(*[F.lit(v) for v in ("signup", "pending", "view", "capturing", "click", "processing",
                                             "purchase", "completed", "error", "failed")])
    # Files of a few minutes each, whose rows are dealt out by hash: order holds neither in a file nor between neighbours.
    folder = _scratch(t, "arrivals")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(6, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id")).write.parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 6).parquet(folder)
    events = stream.select(F.col("user_id").cast("string").alias("submission_id"), "event_id", kind[F.col("event_type")].alias("status"), F.col("ts").alias("at"))
    ages = 100 * 365 * 86_400  # the SQL remembers for ever
    with ordered.rocksdb(t.spark):
        steps = _append_stream(t, ordered.ordered_lifecycle(events, keep_final=ages, keep_any=ages), "ordered-steps")
    return steps.groupBy("submission_id", F.coalesce("previous", F.lit("")).alias("previous"), "status",
                         (~F.col("legal")).alias("illegal")).agg(F.count(F.lit(1)).alias("n"))


def _append_stream(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream into a file sink and read it back."""
    from slabspark.streaming.jobs import run_available

    root = _scratch(t, label)
    run_available(stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out"), f"{root}/checkpoint")
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


# ------------------------------------------------------- robust statistics

MAD_SQL = """mid AS (SELECT {0} AS k, median({1}) AS med FROM {2} GROUP BY 1),
mads AS (SELECT k, any_value(med) AS med, median(abs({1} - med)) AS mad FROM {2} JOIN mid ON k = {0} GROUP BY 1)"""


@query("outlier_fraction", sql=f"""WITH {MAD_SQL.format('user_id', 'value', 'events')}
SELECT user_id, count(*) AS length, count(*) FILTER (abs(value - med) > 4 * greatest(mad, 1.5)) AS anomaly_count,
  round(count(*) FILTER (abs(value - med) > 4 * greatest(mad, 1.5)) / count(*), 6) AS anomaly_fraction,
  round(stddev_pop(value), 6) AS stddev FROM events JOIN mads ON k = user_id GROUP BY 1""")
def outlier_fraction(t: Tables) -> DataFrame:
    """Share of a series beyond four MADs of its median."""
    return R.outlier_fraction(t.events, ["user_id"], "value").select(
        "user_id", "length", "anomaly_count", F.round("anomaly_fraction", 6).alias("anomaly_fraction"),
        F.round("stddev", 6).alias("stddev"))


@query("paired_shift", sql=f"""WITH base AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'),
{MAD_SQL.format('l_suppkey', 'l_quantity', 'base')},
sides AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS nb, count(*) FILTER (l_linestatus = 'O') AS na,
  median(l_quantity) FILTER (l_linestatus = 'O') - median(l_quantity) FILTER (l_linestatus = 'F') AS delta FROM lineitem GROUP BY 1)
SELECT l_suppkey, nb AS n_border_pixels, CASE WHEN ok THEN delta END AS delta_b, CASE WHEN ok THEN mad END AS border_mad,
  CASE WHEN ok THEN round(1 / (1 + exp(-0.4 * (delta + 3.0))), 6) ELSE 0.5 END AS score,
  CASE WHEN ok THEN round(least(0.7, greatest(0.4, CASE WHEN mad <= 1 THEN 1.0 WHEN mad >= 3 THEN 0.4 ELSE 1 - 0.3 * (mad - 1) END)), 6)
    ELSE 0.0 END AS confidence,
  CASE WHEN na = 0 THEN 'flash_not_captured' WHEN nb < 250 THEN 'border_too_small' END AS abstain_reason
FROM (SELECT *, na > 0 AND nb >= 250 AS ok FROM sides LEFT JOIN mads ON k = l_suppkey)""")
def paired_shift(t: Tables) -> DataFrame:
    """Median shift between two conditions with a MAD confidence."""
    rows = R.paired_shift(t.lineitem, "l_suppkey", "l_linestatus", "l_quantity", "F", "O", min_rows=250)
    return rows.withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 6)})


@query("tail_statistic", sql="""WITH s AS (SELECT l_suppkey,
    avg(l_extendedprice / 300) FILTER (l_returnflag = 'N') AS m, stddev_pop(l_tax * 200) FILTER (l_returnflag = 'N') AS x,
    stddev_pop(l_extendedprice / 300) FILTER (l_returnflag = 'N') AS sd,
    quantile_cont(l_extendedprice / 300, 0.95) FILTER (l_returnflag <> 'N') AS p FROM lineitem GROUP BY 1),
g AS (SELECT *, m < 140 OR sd > 54 AS bad FROM s)
SELECT l_suppkey, round(m, 6) AS band_mean, round(sd, 6) AS band_stddev, CASE WHEN bad THEN 0.0 ELSE round(p, 6) END AS p95,
  CASE WHEN bad THEN 0.5 ELSE round(1 / (1 + exp(-0.12 * (p - 40))), 6) END AS score,
  CASE WHEN bad THEN 0.0 ELSE round(least(1, greatest(0, 1 - sd / 18)), 6) END AS confidence FROM g""")
def tail_statistic(t: Tables) -> DataFrame:
    """95th percentile gated by the mean and spread of a reference band."""
    rows = t.lineitem.select("l_suppkey", "l_returnflag", (F.col("l_extendedprice") / 300).alias("v"))
    out = R.tail_statistic(rows, "l_suppkey", F.col("l_returnflag") == "N", "v")
    return out.withColumns({c: F.round(c, 6) for c in ("band_mean", "band_stddev", "p95", "score", "confidence")})


@query("inside_contrast", sql="""WITH s AS (SELECT user_id, avg(value) FILTER (event_type = 'error') AS i,
    avg(value) FILTER (event_type <> 'error') AS o, count(*) FILTER (event_type = 'error') / count(*) AS share FROM events GROUP BY 1),
g AS (SELECT *, share < 0.02 OR i IS NULL OR o IS NULL AS bad, i / greatest(o, 0.05) AS r FROM s)
SELECT user_id, round(share, 6) AS mask_fraction, CASE WHEN NOT bad THEN round(r, 6) END AS flow_ratio,
  CASE WHEN bad THEN 0.5 ELSE round(1 / (1 + exp(-3.0 * (r - 2.0))), 6) END AS score,
  CASE WHEN bad THEN 0.0 WHEN share >= 0.05 THEN 0.85 ELSE round(0.55 + (share - 0.02) / 0.03 * 0.3, 6) END AS confidence,
  CASE WHEN bad THEN 'no_holo_region' END AS abstain_reason FROM g""")
def inside_contrast(t: Tables) -> DataFrame:
    """Mean inside over mean outside a mask."""
    out = R.inside_contrast(t.events, "user_id", F.col("event_type") == "error", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mask_fraction", "flow_ratio", "score", "confidence")})


PROFILE_SQL = """prof AS (SELECT user_id, CAST(floor(value / 4) AS INT) AS bin,
  avg(CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS level FROM events GROUP BY 1, 2)"""


def _profile(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "value", F.from_json("props", "k INT")["k"].cast("double").alias("k"))
    return R.binned_profile(rows, "user_id", F.col("value") / 4, "k")


@query("binned_profile", sql=f"WITH {PROFILE_SQL} SELECT user_id, bin, round(level, 6) AS level FROM prof")
def binned_profile(t: Tables) -> DataFrame:
    """Mean level per integer bin of a series."""
    return _profile(t).withColumn("level", F.round("level", 6))


@query("band_prominence", sql=f"""WITH {PROFILE_SQL},
p AS (SELECT user_id, max(level) FILTER (bin BETWEEN 5 AND 14) AS peak,
  avg(level) FILTER (bin >= 3 AND bin NOT BETWEEN 5 AND 14) AS base FROM prof GROUP BY 1),
s AS (SELECT user_id, CASE WHEN peak IS NOT NULL AND base > 1e-6 THEN peak / base ELSE 0.0 END AS v FROM p)
SELECT user_id, round(v, 6) AS peak_strength, 1 AS analyzed_patches, round(1 / (1 + exp(-1.4 * (v - 3.5))), 6) AS score,
  0.2 AS confidence FROM s""")
def band_prominence(t: Tables) -> DataFrame:
    """Peak inside a band over the level outside it, scored per series."""
    out = R.rosette_measurement(R.band_prominence(_profile(t), "user_id"), "user_id")
    return out.withColumns({"peak_strength": F.round("peak_strength", 6), "score": F.round("score", 6)})


@query("peak_position", sql="""WITH m AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS pk FROM events)
SELECT user_id, round(sum(event_id * value) / sum(value), 6) AS position FROM m WHERE value >= 0.8 * pk GROUP BY 1""")
def peak_position(t: Tables) -> DataFrame:
    """Weighted centroid of the positions near the peak."""
    return R.peak_position(t.events, "user_id", "event_id", "value").withColumn("position", F.round("position", 6))


@query("share_above", sql="""SELECT l_suppkey, round(avg(CASE WHEN l_quantity > 45 AND l_discount < 0.03 THEN 1 ELSE 0 END), 6) AS share,
  avg(CASE WHEN l_quantity > 45 AND l_discount < 0.03 THEN 1 ELSE 0 END) > 0.025 AS above_cap FROM lineitem GROUP BY 1""")
def share_above(t: Tables) -> DataFrame:
    """Share of rows meeting two conditions, against a cap."""
    hit = (F.col("l_quantity") > 45) & (F.col("l_discount") < 0.03)
    return R.share_above(t.lineitem, "l_suppkey", hit, 0.025).withColumn("share", F.round("share", 6))


TRACK_SQL = """tr AS (SELECT user_id, event_id, event_type <> 'error' AS seen, value / 8 AS x, event_id % 7 + 0.0 AS y FROM events),
lagged AS (SELECT *, lag(seen, 1) OVER w AS s1, lag(seen, 2) OVER w AS s2, lag(seen, 3) OVER w AS s3,
    lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2, lag(x, 3) OVER w AS x3,
    lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(y, 3) OVER w AS y3 FROM tr WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
st AS (SELECT *, coalesce(seen AND s1 AND sqrt((x - x1) ** 2 + (y - y1) ** 2) <= 30, false) AS f1,
    coalesce(s1 AND s2 AND sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) <= 30, false) AS f2,
    coalesce(s2 AND s3 AND sqrt((x2 - x3) ** 2 + (y2 - y3) ** 2) <= 30, false) AS f3 FROM lagged),
dp AS (SELECT *, CASE WHEN f1 AND f2 AND f3 THEN 4 WHEN f1 AND f2 THEN 3 WHEN f1 THEN 2 ELSE 1 END AS d FROM st),
bf AS (SELECT *, [x, x1, x2, x3][1:d] AS bx, [y, y1, y2, y3][1:d] AS b_y FROM dp),
mn AS (SELECT *, list_avg(bx) AS mx, list_avg(b_y) AS my FROM bf),
dv AS (SELECT *, list_max(list_transform(range(1, d + 1), lambda i: sqrt((bx[i] - mx) ** 2 + (b_y[i] - my) ** 2))) AS dev FROM mn)"""


@query("track_lock", sql=f"""WITH {TRACK_SQL}
SELECT event_id, CASE WHEN seen THEN round(mx, 8) END AS left_x, CASE WHEN seen THEN round(dev, 8) ELSE 0.0 END AS deviation,
  CASE WHEN seen THEN d / 4 ELSE 0.0 END AS progress, seen AND d = 4 AND dev <= 6 AS locked FROM dv""")
def track_lock(t: Tables) -> DataFrame:
    """Rolling smoothing and lock over a track of outlines."""
    x, y = F.col("value") / 8, F.col("event_id") % 7 + 0.0
    point = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    quad = F.when(F.col("event_type") != "error", F.array(point(0, 0), point(10, 0), point(10, 14), point(0, 14)))
    rows = R.track_lock(t.events.select("user_id", "event_id", quad.alias("quad")), "user_id", "event_id", "quad")
    return rows.select("event_id", F.round(F.col("smoothed")[0]["x"], 8).alias("left_x"),
                       F.round("deviation", 8).alias("deviation"), "progress", "locked")


@query("quad_metrics", sql="""WITH q AS (SELECT event_id, value / 50 AS dx, (event_id % 11) / 4.0 AS dy FROM events),
s AS (SELECT event_id, dx, dy, 10.0 AS top, sqrt((10 + dx) ** 2 + dy ** 2) AS bottom, 14.0 AS "left", sqrt(dx ** 2 + (14 + dy) ** 2) AS "right" FROM q),
a AS (SELECT *, abs(acos(greatest(-1, least(1, 0.0))) - pi() / 2) AS a1,
  abs(acos(greatest(-1, least(1, (-10 * dx) / (top * "right")))) - pi() / 2) AS a2,
  abs(acos(greatest(-1, least(1, (dx * (10 + dx) + (14 + dy) * dy) / ("right" * bottom)))) - pi() / 2) AS a3,
  abs(acos(greatest(-1, least(1, (-14 * dy) / (bottom * "left")))) - pi() / 2) AS a4 FROM s)
SELECT event_id, round(least(1, greatest(abs(top - bottom) / greatest(top, bottom), abs("left" - "right") / greatest("left", "right"),
    greatest(a1, a2, a3, a4) / (pi() / 2))), 6) AS irregularity,
  round(greatest(degrees(acos(least(top, bottom) / greatest(top, bottom))), degrees(acos(least("left", "right") / greatest("left", "right")))), 6)
    AS off_axis, round((10 + dx) * (14 + dy) / 1271.0, 6) AS fill FROM a""")
def quad_metrics(t: Tables) -> DataFrame:
    """Irregularity, off-axis angle and fill ratio of an outline."""
    dx, dy = F.col("value") / 50, (F.col("event_id") % 11) / 4.0
    point = lambda px, py: F.struct(F.lit(px).cast("double").alias("x") if not hasattr(px, "alias") else px.alias("x"),
                                    F.lit(py).cast("double").alias("y") if not hasattr(py, "alias") else py.alias("y"))
    quad = F.array(point(0, 0), point(10, 0), point(dx + 10, dy + 14), point(0, 14))
    rows = t.events.select("event_id", quad.alias("q"), dx.alias("dx"), dy.alias("dy"))
    fill = quads.fill_ratio(F.col("dx") + 10, F.col("dy") + 14, F.lit(31), F.lit(41))
    return rows.select("event_id", F.round(quads.irregularity(F.col("q")), 6).alias("irregularity"),
                       F.round(quads.off_axis_degrees(F.col("q")), 6).alias("off_axis"), F.round(fill, 6).alias("fill"))
