"""Authenticity rules, evaluation and recalibration."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabspark.operators import authenticity as A
from slabspark.operators import evaluate as E
from slabspark.operators import grading as G
from slabspark.operators import robust as R
from slabspark import schemas as SC


def _combine(spark, verdicts):
    rows = spark.createDataFrame([("s", "d", v, .5) for v in verdicts], "submission_id string, detector string, verdict string, confidence double")
    return A.combine(rows).first()


@pytest.mark.parametrize("verdicts,want", [
    (["authentic", "likely_counterfeit"], "likely_counterfeit"), (["unverified", "unverified"], "unverified"),
    (["authentic", "unverified"], "authentic"), (["authentic", "suspicious"], "suspicious"), (["suspicious"], "suspicious"),
    (["unverified", "likely_counterfeit"], "likely_counterfeit")])
def test_combined_verdict(spark, verdicts, want):
    assert _combine(spark, verdicts).verdict == want


def test_unknown_verdict_is_an_error(spark):
    with pytest.raises(Exception, match="unknown verdict"):
        _combine(spark, ["authentic", "maybe"])


def test_confidence_policies(spark):
    rows = spark.createDataFrame([("s", "rosette", "authentic", .9), ("s", "color", "authentic", .6), ("s", "substrate", "unverified", .1),
                                  ("t", "color", "unverified", .2)], "submission_id string, detector string, verdict string, confidence double")
    strict = {r.submission_id: r.confidence for r in A.combine(rows).collect()}
    loose = {r.submission_id: r.confidence for r in A.combine(rows, policy="all").collect()}
    assert strict == {"s": .6, "t": 0.0} and loose == {"s": .1, "t": .2}
    with pytest.raises(ValueError):
        A.combine(rows, policy="x")


def test_authenticity_row_and_reasons(spark):
    rows = spark.createDataFrame([
        ("s", "rosette", .95, 1.0, None, {"peak_strength": 5.555, "analyzed_patches": 5.0}, None),
        ("s", "typography", .1, .85, None, {"levenshtein": 7.0}, "Bob's"),
        ("s", "substrate", .5, 0.0, "flash_not_captured", {}, None),
        ("s", "embedding_anomaly", .5, 0.0, "odd", {"n_references": 0.0}, None),
        ("s", "knn_reference", .5, 0.0, "insufficient_references", {"k": 3.0, "n_references_used": 2.0}, None),
        ("s", "substrate_x", .5, 0.0, None, {}, None)], SC.MEASUREMENTS)
    r = A.authenticity_rows(rows.where("detector <> 'substrate_x'")).first()
    assert r.verdict == "likely_counterfeit" and r.confidence == .85
    assert r.reasons == [
        "halftone rosette pattern detected (rosette_score=0.95, peak_strength=5.55)",
        "insufficient references for centroid analysis (n_references=0, confidence=0.00)",
        "OCR'd title diverges from identified card name (typography_score=0.10, levenshtein=7, extracted=\"Bob's\")",
        "insufficient authentic exemplars for k-NN top-3 (n_references=2, need >= 3)",
        "front_full_flash shot not captured — substrate-fluorescence signal skipped (optional capture step)"]
    assert set(r.detector_scores) == {"rosette", "typography", "substrate", "embedding_anomaly", "knn_reference"}
    assert json.loads(r.detector_scores["rosette"])["verdict"] == "authentic"
    assert r.model_versions["thresholds.color_counterfeit"] == "0.2" and r.model_versions["substrate"] == "delta-b-flash-v1"


def test_unpack_blob(spark):
    blob = json.dumps({"rosette": {"score": .4, "verdict": "suspicious", "confidence": .5, "peak": 3}, "old": .7, "bare": {}})
    rows = {r.detector: r for r in A.unpack_detectors(spark.createDataFrame([("s", blob)], "submission_id string, detector_scores string")).collect()}
    assert set(rows) == {"rosette", "bare"}
    assert rows["rosette"].metadata == {"peak": "3"} and rows["bare"].verdict == "unverified" and rows["bare"].score == 0.0


def test_embedding_detectors_abstain(spark):
    refs = spark.createDataFrame([(i, "v", [1.0, float(i) / 10]) for i in range(3)] + [(9, "w", [1.0, 0.0])], "id long, g string, e array<float>")
    subs = spark.createDataFrame([(1, "v", [1.0, 0.0]), (2, "w", [0.0, 1.0]), (3, "x", [1.0, 1.0]), (4, "v", None)], "id long, g string, e array<float>")
    c = {r.id: r for r in A.centroid_distance(subs.where("id < 4"), refs, "id", "g", "e").collect()}
    assert c[3].abstain_reason == "no_references" and (c[3].score, c[3].confidence) == (.5, 0.0)
    assert c[2].distance_from_centroid == pytest.approx(1.0) and c[2].confidence == .4
    m = np.array([[1, 0], [1, .1], [1, .2]])
    u = (m / np.linalg.norm(m, axis=1, keepdims=True)).mean(axis=0)
    assert c[1].distance_from_centroid == pytest.approx(1 - u[0] / np.linalg.norm(u), abs=1e-7)
    n = {r.id: r for r in A.neighbour_distance(subs, refs, "id", "id", "g", "e").collect()}
    assert n[2].abstain_reason == "insufficient_references" and n[3].n_references_used == 0
    assert n[4].abstain_reason == "no_submitted_embedding" and n[1].confidence == pytest.approx(.4)
    d = 1 - m[:, 0] / np.linalg.norm(m, axis=1)
    assert n[1].mean_topk_distance == pytest.approx(d.mean(), abs=1e-7)


def test_text_match_paths(spark):
    rows = spark.createDataFrame([(1, "Black Lotus", "black lotus!"), (2, None, "x"), (3, "A", None), (4, "Abc", "  "), (5, " ", "x")],
                                 "id int, e string, t string")
    r = {x.id: x for x in A.text_match(rows, "e", "t").collect()}
    assert (r[1].levenshtein, r[1].confidence) == (0, .85) and r[1].score > .98
    assert [r[i].abstain_reason for i in (2, 3, 5)] == ["no_expected_text", "ocr_unavailable", "no_expected_text"]
    assert r[4].levenshtein is None and r[4].confidence == .45 and r[4].score < .001


# -------------------------------------------------------------- thresholds


def _outcomes(spark, a, c, detector="rosette", extra=()):
    rows = [(f"a{i}", "authentic", detector, float(s), .9, "suspicious", None) for i, s in enumerate(a)]
    rows += [(f"c{i}", "counterfeit", detector, float(s), .9, "suspicious", None) for i, s in enumerate(c)]
    return spark.createDataFrame(rows + list(extra), SC.OUTCOMES)


def _sweep(a, c):
    pts = np.unique(np.concatenate([a, c]))
    if len(pts) == 1:
        return float(pts[0])
    cand = np.concatenate([[max(0, pts[0] - 1e-3)], (pts[:-1] + pts[1:]) / 2, [min(1, pts[-1] + 1e-3)]])
    j = np.array([(c < t).mean() - (a < t).mean() for t in cand])
    return float(np.median(cand[j >= j.max() - 1e-12]))


@pytest.mark.parametrize("seed,is_hot", [(0, False), (1, True), (2, True)])
def test_two_sided_threshold_matches_a_full_sweep(spark, request, seed, is_hot):
    if is_hot:
        request.getfixturevalue("hot")
    rng = np.random.default_rng(seed)
    a, c = np.clip(rng.normal(.7, .2, 80).round(2), 0, 1), np.clip(rng.normal(.4, .2, 60).round(2), 0, 1)
    got = E.two_sided_thresholds(E.confident_scores(_outcomes(spark, a, c))).first()
    assert got.authentic_threshold == pytest.approx(_sweep(a, c), abs=1e-12)


def test_top_score_of_one_and_single_score(spark):
    a, c = np.array([1.0, 1.0, .5]), np.array([1.0, .2])
    assert E.two_sided_thresholds(E.confident_scores(_outcomes(spark, a, c))).first().authentic_threshold == pytest.approx(_sweep(a, c))
    one = E.two_sided_thresholds(E.confident_scores(_outcomes(spark, [.4, .4], [.4]))).first()
    assert one.authentic_threshold == .4


def test_recommendation_modes(spark):
    rng = np.random.default_rng(7)
    a, c = np.clip(rng.normal(.9, .02, 100), 0, 1), np.clip(rng.normal(.1, .02, 100), 0, 1)
    r = E.recommendations(_outcomes(spark, a, c)).first()
    assert r["mode"] == "two_sided" and .2 < r.authentic_threshold < .85 and r.counterfeit_threshold < r.authentic_threshold
    assert r.authentic_recall >= .95 and r.counterfeit_recall >= .95 and r.authentic_fpr <= .05 and r.notes == []
    r = E.recommendations(_outcomes(spark, a[:20], [])).first()
    assert r["mode"] == "authentic_only" and r.authentic_threshold == pytest.approx(np.percentile(a[:20], 5), abs=1e-9)
    assert r.counterfeit_threshold is None and len(r.notes) == 2
    r = E.recommendations(_outcomes(spark, [], c[:5])).first()
    assert r["mode"] == "insufficient" and r.authentic_threshold is None and r.n_counterfeit == 5


def _cap(a, budget):
    s, k = np.sort(a), int(np.floor(budget * len(a)))
    return max(0, s[0] - 1e-3) if k == 0 else s[-1] if k >= len(s) else (s[k - 1] + s[k]) / 2


@pytest.mark.parametrize("budget", [0.0, .01, .1, .5, 1.0])
def test_fpr_cap(spark, budget):
    a = np.random.default_rng(4).random(57).round(2)
    got = E.fpr_caps(E.confident_scores(_outcomes(spark, a, [.1])), budget).first().fpr_cap
    assert got == pytest.approx(_cap(a, budget), abs=1e-12)


def test_abstained_rows_and_unknown_labels(spark):
    extra = [("x", "authentic", "rosette", .5, .1, "unverified", None), ("y", "odd", "rosette", None, .9, "suspicious", "boom"),
             ("z", "odd", "rosette", .5, .9, "suspicious", None), ("e", "authentic", "ensemble", .5, .9, "suspicious", None)]
    r = E.score_counts(_outcomes(spark, [.9], [.1], extra=extra)).collect()
    assert [(x.detector, x.n_authentic, x.n_counterfeit, x.n_abstained) for x in r] == [("rosette", 1, 1, 2)]


def test_confusion_with_empty_denominators(spark):
    rows = spark.createDataFrame([("1", "authentic", "color", .9, .9, "authentic", None), ("2", "authentic", "color", .9, .9, "unverified", None)], SC.OUTCOMES)
    r = E.confusion(rows).first()
    assert (r.n_samples, r.n_abstained, r.true_negatives, r.true_positive_rate, r.false_positive_rate, r.accuracy) == (2, 1, 1, None, 0.0, 1.0)


# ------------------------------------------------------------ robust, grades


def test_outlier_fraction_hot_and_cold(spark, hot):
    rng = np.random.default_rng(2)
    data = [("big", float(v)) for v in np.where(rng.random(200) < .1, 90.0, rng.normal(20, 2, 200))] + [("flat", 5.0)] * 4
    got = {r.k: r for r in R.outlier_fraction(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    v = np.array([x for k, x in data if k == "big"])
    mad = np.median(np.abs(v - np.median(v)))
    assert got["big"].anomaly_count == int((np.abs(v - np.median(v)) > 4 * max(mad, 1.5)).sum())
    assert got["flat"].anomaly_count == 0


def _lock(track):
    buf, out = [], []
    for q in track:
        if q is None:
            buf = []
            out.append((False, 0.0, 0.0))
            continue
        step = np.hypot(*(np.array(q) - np.array(buf[-1])).T).mean() if buf else 0
        buf = [q] if buf and step > 30 else (buf + [q])[-4:]
        mean = np.mean(buf, axis=0)
        dev = max(np.hypot(*(np.array(b) - mean).T).max() for b in buf)
        out.append((len(buf) == 4 and dev <= 6, len(buf) / 4, dev))
    return out


@pytest.mark.parametrize("is_hot", [False, True])
def test_track_lock(spark, request, is_hot):
    if is_hot:
        request.getfixturevalue("hot")
    rng = np.random.default_rng(9)
    track, at = [], np.zeros(2)
    for i in range(80):
        at = at + (rng.normal(0, 60, 2) if i % 17 == 0 else rng.normal(0, 2, 2))
        track.append(None if i % 13 == 5 else [tuple(float(x) for x in at + d) for d in ((0, 0), (50, 0), (50, 70), (0, 70))])
    rows = [("t", i, None if q is None else [dict(x=x, y=y) for x, y in q]) for i, q in enumerate(track)]
    df = spark.createDataFrame(rows, "k string, f int, quad array<struct<x:double,y:double>>")
    got = {r.f: r for r in R.track_lock(df, "k", "f", "quad").collect()}
    assert any(w[0] for w in _lock(track))
    for i, (locked, progress, dev) in enumerate(_lock(track)):
        assert (got[i].locked, got[i].progress) == (locked, progress), i
        assert got[i].deviation == pytest.approx(dev, abs=1e-9)


def test_grade_parts(spark):
    empty = spark.createDataFrame([], SC.GRADES)
    faces = spark.createDataFrame([("s", "front", 52.0, 50.0, .8), ("s", "back", 80.0, 50.0, .6), ("n", "back", 50.0, 50.0, .9)],
                                  "submission_id string, face string, left double, top double, confidence double")
    grades = G.upsert_centering(empty, G.centering_from_ratios(faces))
    r = grades.first()
    assert grades.count() == 1 and (r.centering, r.final, r.back_centering_lr) == (9.0, None, 80.0) and r.confidence == pytest.approx(.7)
    sides = spark.createDataFrame([("s", "front", 1, 100), ("s", "front", 0, 100), ("o", "front", 0, 10)],
                                  "submission_id string, face string, anomaly_count int, length int")
    worse = G.worse_face(G.edge_face(sides, ["submission_id", "face"]))
    full = grades.withColumns({"corners": F.lit(9.5), "surface": F.lit(8.26)})
    merged, orphans = G.upsert_edges(full, worse)
    m = merged.first()
    assert (m.edges, m.final, m.confidence) == (10.0, 8.5, pytest.approx(.7))
    assert m.model_versions == {"centering": "geometric-v1", "edges": "geometric-v1", "edges_worse_face": "front"}
    assert [x.submission_id for x in orphans.collect()] == ["o"]
    again, _ = G.upsert_edges(merged, worse)
    assert again.first() == m
