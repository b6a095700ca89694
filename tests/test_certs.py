"""Population goldens, hot variants, certificates and as-of prices."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slabspark.operators import certs as C
from slabspark.operators import dashboard as D
from slabspark.operators import grading as G
from slabspark.operators import ops


def _graded(spark, finals, variant="v"):
    t0 = dt.datetime(2026, 1, 1)
    return spark.createDataFrame(
        [(f"s{i}", variant, f, t0 + dt.timedelta(days=i)) for i, f in enumerate(finals)],
        "submission_id string, variant_id string, final double, completed_at timestamp")


def test_population_golden(spark):
    rows = {r.submission_id: r for r in C.population(_graded(spark, [9.5, 9.0, 8.5, 8.0, 7.5])).collect()}
    r = rows["s1"]
    assert (r.total_graded, r.this_rank, r.max_grade, r.chronological_index) == (5, 2, 9.5, 2)


def test_population_ties_and_nulls(spark):
    rows = {r.submission_id: r.this_rank for r in C.population(_graded(spark, [9.0, None, 9.0, 8.0, None])).collect()}
    assert rows == {"s0": 1, "s2": 1, "s3": 3, "s1": 4, "s4": 4}


def test_population_of_a_hot_variant(spark, hot):
    finals = [None if i % 7 == 0 else (i * 5 % 19) / 2 for i in range(90)]
    rows = _graded(spark, finals).unionByName(_graded(spark, [1.0, 2.0], "w").withColumn(
        "submission_id", F.concat(F.lit("w"), "submission_id")))
    got = {r.submission_id: r for r in C.population(rows).collect()}
    assert len(got) == 92
    for i, f in enumerate(finals):
        ahead = sum(1 for x in finals if x is not None and (f is None or x > f))
        r = got[f"s{i}"]
        assert (r.total_graded, r.this_rank, r.max_grade, r.chronological_index) == (90, ahead + 1, 9.0, i + 1)


def test_unidentified_has_no_population(spark):
    assert C.population(_graded(spark, [9.0], None)).count() == 0


def test_primary_grade(spark):
    g = spark.createDataFrame([("a", "bgs", 9.0), ("a", "psa", 8.0), ("b", "trugrade", 7.0), ("b", "bgs", 6.0)],
                              "submission_id string, scheme string, final double")
    assert {r.submission_id: r.scheme for r in C.primary_grades(g).collect()} == {"a": "psa", "b": "bgs"}


@pytest.mark.parametrize("is_hot", [False, True])
def test_latest_within(spark, request, is_hot):
    if is_hot:
        request.getfixturevalue("hot")
    t0 = dt.datetime(2026, 1, 1)
    h = lambda n: t0 + dt.timedelta(hours=n)
    snaps = spark.createDataFrame([("a", h(i * 3), float(i) if i % 5 else None) for i in range(30)] + [("b", h(0), 5.0)],
                                  "name string, fetched timestamp, price double")
    asks = spark.createDataFrame([(i, "a", h(i * 4 + 1)) for i in range(40)] + [(100, "b", h(24)), (101, "b", h(23)), (102, "z", h(1))],
                                 "rid long, name string, at timestamp")
    got = {r.rid: r.price for r in C.latest_within(asks, snaps, ["name"], "at", "fetched", 86400, "rid", ["price"]).collect()}
    assert got[100] is None and got[101] == 5.0 and got[102] is None
    for i in range(40):
        at = i * 4 + 1
        j = max(k for k in range(30) if k * 3 <= at)
        want = None if at - j * 3 >= 24 or j % 5 == 0 else float(j)
        assert got[i] == want, i


def test_certificates_only_completed(spark):
    t0 = dt.datetime(2026, 1, 1)
    subs = spark.createDataFrame([("s1", "completed", "v1", None, t0), ("s2", "processing", "v1", .9, None), ("s3", "completed", None, None, t0)],
                                 "id string, status string, identified_variant_id string, identification_confidence double, completed_at timestamp")
    grades = spark.createDataFrame([("s1", "psa", 9.0, None, 9.0, None, None, .8), ("s1", "bgs", 9.0, 9.0, 9.0, 9.0, 9.0, .8)],
                                   "submission_id string, scheme string, centering double, corners double, edges double, surface double, final double, confidence double")
    auth = spark.createDataFrame([("s1", "authentic", .7, ["ok"])], "submission_id string, verdict string, confidence double, reasons array<string>")
    variants = spark.createDataFrame([("v1", "Lotus", "232", "x")], "id string, name string, card_number string, set_id string")
    sets = spark.createDataFrame([("x", "LEA")], "id string, code string")
    rows = {r.submission_id: r for r in C.certificates(subs, grades, auth, variants, sets).collect()}
    assert set(rows) == {"s1", "s3"}
    assert rows["s1"].set_code == "LEA" and rows["s1"].match_confidence == 0.0 and len(rows["s1"].grades) == 2
    assert rows["s1"].total_graded == 1 and rows["s1"].max_grade is None
    assert rows["s3"].grades == [] and rows["s3"].card_name is None and rows["s3"].match_confidence is None


def test_regions_and_defects(spark):
    g = spark.createDataFrame([("s", 10.0, None, 9.0, 8.0)], "submission_id string, centering double, corners double, edges double, surface double")
    rows = G.regions(g).collect()
    assert len(rows) == 10
    by = {(r.kind, r.position): (r.severity, r.reasons) for r in rows}
    assert by[("centering", "whole_card")] == ("ok", [])
    assert by[("edge", "left")] == ("minor", ["Minor edge wear"])
    assert by[("corner", "top_left")] == ("unknown", ["Analysis pending"])
    assert by[("surface", "whole_card")] == ("major", ["Significant surface damage"])
    kinds = [r.kind for r in G.defect_list(G.regions(g)).collect()]
    assert kinds == ["corner"] * 4 + ["edge"] * 4 + ["surface"]
    clean = spark.createDataFrame([("s", 10.0, 10.0, 10.0, 10.0)], g.schema)
    assert G.defect_list(G.regions(clean)).count() == 0


def test_worse_face_tie_goes_to_front(spark):
    f = spark.createDataFrame([("a", "back", 9.0, .6), ("a", "front", 9.0, .8), ("b", "front", 9.0, 1.0), ("b", "back", 8.0, .5), ("c", "front", 7.0, .5)],
                              "submission_id string, face string, subgrade double, confidence double")
    got = {r.submission_id: (r.subgrade, r.worse_face, round(r.confidence, 6)) for r in G.worse_face(f).collect()}
    assert got == {"a": (9.0, "front", .7), "b": (8.0, "back", .75), "c": (7.0, "front", .5)}


def test_quality_gate(spark):
    shots = spark.createDataFrame([
        ("front_full", 100.0, .001, True, .5, 5.0), ("front_full", 89.0, .013, True, .2, 21.0), ("front_full", 100.0, None, False, None, None),
        ("corner_tl", 100.0, .001, False, None, None), ("front_full_flash", 100.0, .08, True, .96, 5.0), ("tilt_30", 100.0, .05, True, .5, 45.0)],
        "kind string, blur double, glare double, card_detected boolean, card_fill double, perspective double")
    got = [(r.passed, len(r.reasons)) for r in G.quality_gate(shots).collect()]
    assert got == [(True, 0), (False, 4), (False, 1), (True, 0), (False, 1), (True, 0)]


def test_shots(spark):
    t0 = dt.datetime(2026, 1, 1)
    later = t0 + dt.timedelta(1)
    shots = spark.createDataFrame([("1", "s", "front_full", True, t0), ("2", "s", "front_full", False, later), ("3", "s", "back_full", False, t0),
                                   ("4", "u", "front_full", True, t0), ("5", "u", "front_full", True, t0)],
                                  "id string, submission_id string, kind string, quality_passed boolean, created_at timestamp")
    latest = {(r.submission_id, r.kind): r.id for r in ops.latest_shots(shots).collect()}
    assert latest == {("s", "front_full"): "2", ("s", "back_full"): "3", ("u", "front_full"): "4"}
    assert ops.usable_shots(ops.latest_shots(shots)).where("kind = 'back_full'").count() == 0
    subs = spark.createDataFrame([("s",), ("u",), ("w",)], "id string")
    assert [r.submission_id for r in ops.missing_shots(subs, shots).collect()] == ["w"]


def test_reconcile(spark):
    now = dt.datetime(2026, 1, 1, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    subs = spark.createDataFrame([("a", "processing", None, ago(330)), ("b", "processing", "kept", ago(400)), ("c", "processing", None, ago(300)),
                                  ("d", "completed", None, ago(9999)), ("e", "failed", "x", ago(9999))],
                                 "id string, status string, rejection_reason string, updated_at timestamp")
    updated, audit = ops.reconcile(subs, F.lit(now))
    got = {r.id: (r.status, r.rejection_reason) for r in updated.collect()}
    assert got["a"] == ("failed", "worker_timeout_reconciled") and got["b"] == ("failed", "kept")
    assert got["c"] == ("processing", None) and got["d"] == ("completed", None) and got["e"] == ("failed", "x")
    assert sorted(r.submission_id for r in audit.collect()) == ["a", "b"]
    assert ops.reconcile(updated, F.lit(now))[1].count() == 0


def test_card_views(spark):
    t0 = dt.datetime(2026, 1, 1)
    cols = ("id string, status string, rejection_reason string, created_at timestamp, completed_at timestamp, card_name string, set_code string, "
            "card_number string, has_grade boolean, centering double, corners double, edges double, surface double, final double, "
            "grade_confidence double, auth_verdict string, auth_confidence double")
    sid = "abcd1234-ef56-0000-0000-000000000000"
    rows = spark.createDataFrame([
        (sid, "completed", None, t0, None, "Lotus", "LEA", "1", True, 9.0, None, 9.0, None, None, .5, None, None),
        ("b" * 36, "rejected_quality", "blurry", t0, None, None, None, None, False, None, None, None, None, None, None, None, None),
        ("c" * 36, "completed", None, t0, t0, "Ace", "X", "2", True, 9.0, 9.5, 9.0, 9.0, 9.0, .9, "authentic", .8)], cols)
    v = {r.id[0]: r for r in D.card_views(rows).collect()}
    assert v["a"].short_id == "PG-ABCD-EF56" and v["a"].flag.startswith("Preliminary") and v["a"].auth_verdict == "unverified"
    assert v["b"].flag == "Rejected at quality gate" and v["b"].name == "Unidentified card"
    assert v["c"].flag is None
    stats = D.workbench_stats(D.card_views(rows)).first()
    assert (stats.total, stats.flagged, stats.pending_heads, stats.top_tier, stats.mean_final, stats.highest_name) == (3, 2, 2, 1, 9.0, "Ace")


def test_certificates_of_a_hot_variant(spark, hot):
    t0 = dt.datetime(2026, 1, 1)
    subs = spark.createDataFrame([(f"s{i:02d}", "completed", "v1" if i % 4 else None, .9, t0 + dt.timedelta(i)) for i in range(40)],
                                 "id string, status string, identified_variant_id string, identification_confidence double, completed_at timestamp")
    grades = spark.createDataFrame([(f"s{i:02d}", "psa" if i % 5 else "bgs", 9.0, 9.0, 9.0, 9.0, float(i % 7), .8) for i in range(40)],
                                   "submission_id string, scheme string, centering double, corners double, edges double, surface double, final double, confidence double")
    auth = spark.createDataFrame([], "submission_id string, verdict string, confidence double, reasons array<string>")
    variants = spark.createDataFrame([("v1", "Lotus", "232", "x")], "id string, name string, card_number string, set_id string")
    sets = spark.createDataFrame([("x", "LEA")], "id string, code string")
    rows = {r.submission_id: r for r in C.certificates(subs, grades, auth, variants, sets).collect()}
    peers = [i for i in range(40) if i % 4 and i % 5]
    assert len(rows) == 40
    for i in range(40):
        r = rows[f"s{i:02d}"]
        if i in peers:
            want = (len(peers), 1 + sum(1 for j in peers if j % 7 > i % 7), 6.0, peers.index(i) + 1)
        else:
            want = (None,) * 4
        assert (r.total_graded, r.this_rank, r.max_grade, r.chronological_index) == want
