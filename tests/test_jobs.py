"""Composite jobs, sampling and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slabspark import schemas as SC
from slabspark.operators import sampling as S
from slabspark.plans import jobs
from slabspark.sources.store import TableStore
from slabspark.streaming import jobs as J


@pytest.fixture()
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "lake"))


def _certs(spark):
    rows = [(1, "f1", 0, [1.0, 0.0]), (2, "f2", None, [0.99, 0.01]), (3, "", None, [1.0, 0.0]), (4, "f4", None, [-1.0, -1.0]),
            (5, "f5", None, [1.0])]
    return spark.createDataFrame(rows, "cert_id long, front_image_path string, phash long, embedding array<float>")


def _catalog(spark):
    return spark.createDataFrame([("v1", "mtg", 0, [1.0, 0.0]), ("v2", "mtg", None, [0.0, 1.0])],
                                 "variant_id string, manufacturer string, phash long, embedding array<float>")


def test_accumulate_exemplars_is_idempotent(spark, store):
    first = {r.outcome: r.n for r in jobs.accumulate_exemplars(store, _certs(spark), _catalog(spark), 2, "t").collect()}
    assert first == {"appended": 2, "skipped_no_image": 1, "skipped_unidentified": 2}
    rows = store.read("exemplars", jobs.STORED_EXEMPLARS).collect()
    assert sorted((r.variant_id, r.exemplar_ix, r.cert_id) for r in rows) == [("v1", 0, 1), ("v1", 1, 2)]
    second = {r.outcome: r.n for r in jobs.accumulate_exemplars(store, _certs(spark), _catalog(spark), 2, "t").collect()}
    assert second["skipped_already_consumed"] == 2 and "appended" not in second
    assert store.read("exemplars", jobs.STORED_EXEMPLARS).count() == 2 and store.read("consumed_log", SC.CONSUMED_LOG).count() == 2


def test_a_lost_log_does_not_repeat_exemplars(spark, store):
    jobs.accumulate_exemplars(store, _certs(spark), _catalog(spark), 2)
    store.replace("consumed_log", spark.createDataFrame([], SC.CONSUMED_LOG))
    jobs.accumulate_exemplars(store, _certs(spark), _catalog(spark), 2)
    assert store.read("exemplars", jobs.STORED_EXEMPLARS).count() == 2


def test_embed_new_references(spark, store):
    refs = spark.createDataFrame([("mtg", "a", "f"), ("mtg", "b", ""), ("mtg", "c", "g"), ("mtg", "bad", "h")],
                                 "manufacturer string, variant_id string, front_image_path string")

    def encode(rows):
        return rows.withColumn("embedding", F.when(F.col("variant_id") == "bad", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))

    run = lambda force=False: {r.outcome: r.n for r in jobs.embed_new_references(store, refs, encode, 2, force).collect()}
    assert run() == {"embedded": 2, "skipped_no_image": 1, "embedder_failures": 1}
    assert run() == {"skipped_existing": 2, "skipped_no_image": 1, "embedder_failures": 1}
    assert run(True) == {"embedded": 2, "skipped_no_image": 1, "embedder_failures": 1}
    assert store.read("exemplars", jobs.STORED_EXEMPLARS).count() == 2


def test_grade_job(spark, store):
    faces = spark.createDataFrame([("s", "front", 50.0, 50.0, .8)], "submission_id string, face string, left double, top double, confidence double")
    sides = spark.createDataFrame([("s", "front", 0, 100), ("x", "front", 0, 100)], "submission_id string, face string, anomaly_count int, length int")
    for _ in range(2):
        regions, orphans = jobs.grade(store, faces, sides)
        assert regions.count() == 10 and [r.submission_id for r in orphans.collect()] == ["x"]
    g = store.read("grades", SC.GRADES).collect()
    assert len(g) == 1 and (g[0].centering, g[0].edges, g[0].final) == (10.0, 10.0, None)


def test_authenticate_job(spark, store):
    refs = spark.createDataFrame([(i, "v", [1.0, float(i) / 100]) for i in range(12)], "rid long, g string, e array<float>").withColumnRenamed("rid", "id")
    subs = spark.createDataFrame([(1, "v", [1.0, 0.05]), (2, "w", [1.0, 0.0])], "id long, g string, e array<float>")
    m = jobs.measure_embeddings(subs, refs, "id", "id", "g", "e", 2)
    for _ in range(2):
        out = {r.submission_id: r for r in jobs.authenticate(store, m).collect()}
    assert out["1"].verdict == "authentic" and out["1"].confidence == 1.0
    assert out["2"].verdict == "unverified" and out["2"].confidence == 0.0 and len(out) == 2


def test_certificate_table(spark):
    t0 = dt.datetime(2026, 1, 1)
    subs = spark.createDataFrame([("s1", "u", "completed", "v1", .9, None, t0, t0, t0)], SC.SUBMISSIONS)
    grades = spark.createDataFrame([("s1", "psa", 9.0, 9.0, 9.0, 9.0, 9.0, None, None, None, None, .8, {})], SC.GRADES)
    auth = spark.createDataFrame([("s1", "authentic", .7, ["ok"])], "submission_id string, verdict string, confidence double, reasons array<string>")
    variants = spark.createDataFrame([("v1", "mtg", "x", "232", "Lotus", None, {}, None, None)], SC.CARD_VARIANTS)
    sets = spark.createDataFrame([("x", "mtg", "LEA", "LEA")], SC.CARD_SETS)
    prices = spark.createDataFrame([("Lotus", "LEA", "232", t0, 9.5, None, None, None, "u")], SC.PRICES)
    certs, regions = jobs.certificate_table(subs, grades, auth, variants, sets, prices, F.lit(t0 + dt.timedelta(hours=5)))
    r = certs.first()
    assert r.market_price == 9.5 and r.this_rank == 1 and regions.count() == 10
    stale, _ = jobs.certificate_table(subs, grades, auth, variants, sets, prices, F.lit(t0 + dt.timedelta(hours=24)))
    assert stale.first().market_price is None


def test_recalibrate_with_cert_labels(spark):
    outcomes = spark.createDataFrame([(f"psa-{i}", None, "color", .8 + i / 100, .9, "authentic", None) for i in range(10)]
                                     + [("x", None, "color", .1, .9, "suspicious", None), ("nolabel", None, "color", .1, .9, "suspicious", None)], SC.OUTCOMES)
    labels = spark.createDataFrame([("x", "counterfeit")], "sample_id string, ground_truth string")
    certs = spark.createDataFrame([(i, "f") for i in range(10)], "cert_id long, front_image_path string")
    advice, dist = jobs.recalibrate(outcomes, labels, certs)
    r = advice.first()
    assert (r["mode"], r.n_authentic, r.n_counterfeit) == ("two_sided", 10, 1) and dist.count() == 2


# ---------------------------------------------------------------- sampling


def _samples(spark):
    return spark.createDataFrame([(i, f"k{i % 7}" if i % 7 else "solo%d" % i, i // 2) for i in range(200)], "sid long, key string, cert_id long")


@pytest.mark.parametrize("is_hot", [False, True])
def test_triplets_are_valid(spark, request, is_hot):
    if is_hot:
        request.getfixturevalue("hot")
    rows = S.drop_singletons(_samples(spark))
    info = {r.sid: r for r in rows.collect()}
    got = S.triplets(rows, "sid").collect()
    assert len(got) == len(info)
    for t in got:
        a, p = info[t.anchor], info[t.positive]
        assert a.key == p.key and a.cert_id != p.cert_id and t.negative != t.anchor and t.negative in info
    assert len({t.positive for t in got}) > 50
    assert {(t.anchor, t.positive, t.negative) for t in S.triplets(rows.repartition(5), "sid").collect()} == {
        (t.anchor, t.positive, t.negative) for t in got}


def test_singletons_are_counted(spark):
    r = S.singleton_counts(_samples(spark)).first()
    assert (r.kept, r.dropped) == (S.drop_singletons(_samples(spark)).count(), 29)


def test_split_keeps_ids_together(spark):
    out = S.split_by_id(_samples(spark), "cert_id", .2)
    sides = {}
    for r in out.collect():
        sides.setdefault(r.cert_id, set()).add(r.split)
    assert all(len(v) == 1 for v in sides.values())
    assert sum(v == {"val"} for v in sides.values()) == 20 and out.count() == 200
    tiny = spark.createDataFrame([(1,), (2,)], "cert_id long")
    assert S.split_by_id(tiny, "cert_id").where("split = 'val'").count() == 1


def test_corner_override_length_is_checked(spark):
    certs = spark.createDataFrame([(1, "f", 9.0), (2, "g", 8.0)], "cert_id long, front_image_path string, grade double")
    over = spark.createDataFrame([(2, [1.0, 2.0, 3.0, 4.0])], "cert_id long, corner_grades array<double>")
    got = sorted((r.cert_id, r.corner_index, r.grade) for r in S.corner_fan_out(certs, over).collect())
    assert got == [(1, i, 9.0) for i in range(4)] + [(2, i, i + 1.0) for i in range(4)]
    with pytest.raises(Exception, match="4 values"):
        S.corner_fan_out(certs, spark.createDataFrame([(2, [1.0])], over.schema)).collect()


# ---------------------------------------------------------------- streaming


def _drop(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_stale_runs_fire_once(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1, 12)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    schema = "submission_id string, status string, rejection_reason string, updated_at timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    batches = [[("a", "processing", None, at(0)), ("b", "processing", "kept", at(0)), ("c", "processing", None, at(1))],
               [("c", "completed", None, at(3)), ("d", "processing", None, at(40))], [("d", "processing", None, at(41))]]
    for rows in batches:
        _drop(spark.createDataFrame(rows, schema), src)
        stream = J.stale_runs(spark.readStream.schema(schema).parquet(src))
        J.run_available(stream.writeStream.format("parquet").outputMode("append").option("path", out), ck)
    got = spark.read.parquet(out).collect()
    assert sorted((r.submission_id, r.status, r.rejection_reason) for r in got) == [
        ("a", "failed", "worker_timeout_reconciled"), ("b", "failed", "kept")]
    assert all(r.updated_at == t0 and r.stale_for_seconds > 300 for r in got)


def test_incremental_ingest_across_restarts(spark, tmp_path, store):
    schema = spark.createDataFrame([], "k long, v string").schema
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    for rows in ([(1, "a"), (1, "a"), (2, "b")], [(2, "z"), (3, "c")]):
        _drop(spark.createDataFrame(rows, schema), src)
        stream = spark.readStream.schema(schema).parquet(src)
        J.run_available(stream.writeStream.foreachBatch(J.ingest_new(store, "t", ["k"], schema)), ck)
    assert sorted(tuple(r) for r in store.read("t", schema).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_continuous_accumulation(spark, tmp_path, store):
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    certs = _certs(spark)
    for part in (certs.where("cert_id < 3"), certs):
        _drop(part, src)
        stream = spark.readStream.schema(certs.schema).parquet(src)
        J.run_available(stream.writeStream.foreachBatch(J.accumulate_batches(store, _catalog(spark), 2, "t")), ck)
    assert sorted(r.cert_id for r in store.read("exemplars", jobs.STORED_EXEMPLARS).collect()) == [1, 2]


def test_lifecycle_stream_keeps_state_between_batches(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    schema = "submission_id string, event_id long, status string, at timestamp"
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    steps = ["pending", "capturing", "processing", "processing", "completed", "capturing"]
    for part in (steps[:3], steps[3:]):
        start = 0 if part == steps[:3] else 3
        rows = [("s", start + i, s, t0 + dt.timedelta(minutes=start + i)) for i, s in enumerate(part)]
        _drop(spark.createDataFrame(rows, schema), src)
        stream = J.lifecycle_steps(spark.readStream.schema(schema).parquet(src))
        J.run_available(stream.writeStream.format("parquet").outputMode("append").option("path", out), ck)
    got = sorted((r["at"], r.previous, r.status, r.legal) for r in spark.read.parquet(out).collect())
    assert [g[1:] for g in got] == [(None, "pending", True), ("pending", "capturing", True), ("capturing", "processing", True),
                                    ("processing", "processing", True), ("processing", "completed", True), ("completed", "capturing", False)]
