"""Detector evaluation, recalibration and the authenticity ensemble.

Labelled documents play evaluation samples: quality is the ground truth, and
every document yields one measurement per detector from its length, language
and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions import scalars as S
from slabspark.operators import authenticity as A
from slabspark.operators import evaluate as E
from slabspark.plans import jobs
from slabspark.registry.core import Tables, query

# detector -> headline metric of a document with n characters
METRIC = {
    "rosette": ("n / 700.0", lambda n: n / 700.0),
    "color": ("n / 60.0", lambda n: n / 60.0),
    "embedding_anomaly": ("200.0 / (n + 300)", lambda n: F.lit(200.0) / (n + 300)),
    "typography": ("n / 6000.0", lambda n: n / 6000.0),
    "holographic": ("sqrt(n) / 25.0", lambda n: F.sqrt(n) / 25.0),
    "knn_reference": ("(n % 97) / 200.0", lambda n: (n % 97) / 200.0),
    "substrate": ("(n % 13) - 8.0", lambda n: (n % 13) - 8.0),
}
ROWS = " UNION ALL ".join(f"SELECT '{name}' AS detector, {sql}::DOUBLE AS metric, doc_id, lang, n FROM docs"
                          for name, (sql, _) in METRIC.items())
PARAMS = ", ".join(f"('{d.name}', {d.midpoint}, {d.slope}, {d.authentic}, {d.counterfeit}, {d.min_confidence})"
                   for d in P.DETECTORS)
MEASURED_SQL = f"""docs AS (SELECT doc_id, lang, n_chars AS n FROM documents),
par AS (SELECT * FROM (VALUES {PARAMS}) AS p(detector, mid, slope, a, c, mc)),
measured AS (
  SELECT r.doc_id, r.detector, r.metric, 1 / (1 + exp(-p.slope * (r.metric - p.mid))) AS score,
    CASE r.lang WHEN 'en' THEN 0.9 WHEN 'es' THEN 0.7 WHEN 'de' THEN 0.5
      ELSE CASE WHEN r.n % 2 = 0 THEN 0.3 ELSE 0.45 END END AS confidence, p.a, p.c, p.mc
  FROM ({ROWS}) r JOIN par p USING (detector)),
judged AS (
  SELECT *, CASE WHEN confidence < mc THEN 'unverified' WHEN score >= a THEN 'authentic'
    WHEN score < c THEN 'likely_counterfeit' ELSE 'suspicious' END AS verdict FROM measured),
outcomes AS (
  SELECT j.doc_id AS sample_id, CASE WHEN l.quality = 1 THEN 'authentic' ELSE 'counterfeit' END AS ground_truth,
    detector, score, confidence, verdict FROM judged j JOIN labels l USING (doc_id))"""
WITH = f"WITH {MEASURED_SQL}"


def _measured(t: Tables) -> DataFrame:
    n, lang = F.col("n_chars"), F.col("lang")
    items = F.array(*[F.struct(F.lit(name).alias("detector"), fn(n).cast("double").alias("metric"))
                      for name, (_, fn) in METRIC.items()])
    confidence = (F.when(lang == "en", F.lit(0.9)).when(lang == "es", F.lit(0.7)).when(lang == "de", F.lit(0.5))
                  .when(n % 2 == 0, F.lit(0.3)).otherwise(F.lit(0.45)))
    rows = t.documents.select("doc_id", confidence.alias("confidence"), F.inline(items))
    return rows.withColumn("score", S.score_by_detector(F.col("detector"), F.col("metric")))


def _outcomes(t: Tables) -> DataFrame:
    truth = t.labels.select(F.col("doc_id").alias("sample_id"), F.when(
        F.col("quality") == 1, F.lit("authentic")).otherwise(F.lit("counterfeit")).alias("ground_truth"))
    rows = A.with_verdict(_measured(t)).withColumnRenamed("doc_id", "sample_id").withColumn(
        "error", F.lit(None).cast("string"))
    return E.label_outcomes(rows, truth).select("sample_id", "ground_truth", "detector", "score", "confidence", "verdict", "error")


@query("detector_scores", sql=f"""{WITH}
SELECT doc_id, detector, round(score, 6) AS score, confidence, verdict FROM judged""")
def detector_scores(t: Tables) -> DataFrame:
    """Logistic score and tri-state verdict of every detector."""
    return A.with_verdict(_measured(t)).select("doc_id", "detector", F.round("score", 6).alias("score"), "confidence", "verdict")


@query("combined_verdicts", sql=f"""{WITH}
SELECT doc_id, CASE WHEN bool_or(verdict = 'likely_counterfeit') THEN 'likely_counterfeit'
    WHEN bool_and(verdict = 'unverified') THEN 'unverified' WHEN bool_and(verdict IN ('authentic', 'unverified')) THEN 'authentic'
    ELSE 'suspicious' END AS verdict,
  coalesce(min(confidence) FILTER (confidence >= mc), 0.0) AS confidence, min(confidence) AS confidence_all
FROM judged GROUP BY 1""")
def combined_verdicts(t: Tables) -> DataFrame:
    """Ensemble verdict with both confidence policies."""
    rows = A.with_verdict(_measured(t))
    strict = A.combine(rows, "doc_id")
    loose = A.combine(rows, "doc_id", policy="all").select("doc_id", F.col("confidence").alias("confidence_all"))
    return strict.join(loose, "doc_id")


def _measurements(t: Tables) -> DataFrame:
    """Measurement rows with the metrics the explanations quote."""
    metric = F.create_map(*[F.lit(v) for d in P.DETECTORS for v in (d.name, d.metric)])[F.col("detector")]
    return _measured(t).select(
        F.col("doc_id").cast("string").alias("submission_id"), "detector", "score", "confidence",
        F.lit(None).cast("string").alias("abstain_reason"), F.create_map(
            metric, F.col("metric"), F.lit("k"), F.lit(3.0), F.lit("n_references"), F.lit(12.0),
            F.lit("n_references_used"), F.lit(12.0), F.lit("mask_fraction"), F.lit(0.25), F.lit("border_mad"), F.lit(1.5),
            F.lit("border_stddev"), F.lit(20.0), F.lit("analyzed_patches"), F.lit(2.0)).alias("metrics"),
        F.lit(None).cast("string").alias("extracted_text"))


@query("detector_reasons", sql=f"""{WITH}
SELECT CAST(doc_id AS VARCHAR) AS submission_id, detector, CASE detector
  WHEN 'rosette' THEN CASE verdict
    WHEN 'unverified' THEN printf('insufficient flat regions for FFT analysis (analyzed_patches=2, confidence=%.2f)', confidence)
    WHEN 'authentic' THEN printf('halftone rosette pattern detected (rosette_score=%.2f, peak_strength=%.2f)', score, metric)
    WHEN 'likely_counterfeit' THEN printf('no halftone rosette pattern in expected band (rosette_score=%.2f, peak_strength=%.2f)', score, metric)
    ELSE printf('weak rosette signal — borderline halftone evidence (rosette_score=%.2f, peak_strength=%.2f)', score, metric) END
  WHEN 'embedding_anomaly' THEN CASE verdict
    WHEN 'unverified' THEN printf('insufficient references for centroid analysis (n_references=12, confidence=%.2f)', confidence)
    WHEN 'authentic' THEN printf('submitted embedding consistent with authentic exemplars (embedding_score=%.2f, distance=%.3f, n_refs=12)', score, metric)
    WHEN 'likely_counterfeit' THEN printf('submitted embedding far from authentic centroid (embedding_score=%.2f, distance=%.3f, n_refs=12)', score, metric)
    ELSE printf('borderline embedding distance — neither clearly authentic nor counterfeit (embedding_score=%.2f, distance=%.3f, n_refs=12)', score, metric) END
  WHEN 'holographic' THEN CASE verdict
    WHEN 'unverified' THEN printf('insufficient holographic-parallax confidence (confidence=%.2f, reason=unknown)', confidence)
    WHEN 'authentic' THEN printf('strong differential parallax flow consistent with real holo (holographic_score=%.2f, flow_ratio=%.2f, mask_fraction=0.250)', score, metric)
    WHEN 'likely_counterfeit' THEN printf('flat foil region — no parallax shift between front and tilt (holographic_score=%.2f, flow_ratio=%.2f, mask_fraction=0.250)', score, metric)
    ELSE printf('borderline parallax flow — neither clearly holo nor flat (holographic_score=%.2f, flow_ratio=%.2f)', score, metric) END
  WHEN 'color' THEN CASE verdict
    WHEN 'unverified' THEN printf('unreliable white-balance calibration (border_stddev=20.0, confidence=%.2f)', confidence)
    WHEN 'authentic' THEN printf('high chroma consistent with offset print (color_score=%.2f, p95_chroma=%.1f)', score, metric)
    WHEN 'likely_counterfeit' THEN printf('low chroma — gamut clipping consistent with consumer printer (color_score=%.2f, p95_chroma=%.1f)', score, metric)
    ELSE printf('borderline chroma — neither clearly offset nor inkjet (color_score=%.2f, p95_chroma=%.1f)', score, metric) END
  WHEN 'typography' THEN CASE verdict
    WHEN 'unverified' THEN printf('insufficient OCR confidence (confidence=%.2f, reason=unknown)', confidence)
    WHEN 'authentic' THEN printf('OCR''d title matches identified card name (typography_score=%.2f, levenshtein=None)', score)
    WHEN 'likely_counterfeit' THEN printf('OCR''d title diverges from identified card name (typography_score=%.2f, levenshtein=None, extracted=None)', score)
    ELSE printf('OCR''d title partially matches identified card name (typography_score=%.2f, levenshtein=None)', score) END
  WHEN 'knn_reference' THEN CASE verdict
    WHEN 'unverified' THEN printf('insufficient k-NN reference confidence (confidence=%.2f, reason=unknown)', confidence)
    WHEN 'authentic' THEN printf('submitted embedding consistent with top-3 authentic exemplars (knn_score=%.2f, mean_topk_distance=%.3f, n_refs=12)', score, metric)
    WHEN 'likely_counterfeit' THEN printf('submitted embedding far from all authentic exemplars (knn_score=%.2f, mean_topk_distance=%.3f, n_refs=12)', score, metric)
    ELSE printf('borderline distance to nearest authentic exemplars (knn_score=%.2f, mean_topk_distance=%.3f, n_refs=12)', score, metric) END
  ELSE CASE verdict
    WHEN 'unverified' THEN printf('insufficient substrate confidence (confidence=%.2f, reason=unknown)', confidence)
    WHEN 'authentic' THEN printf('flash-vs-ambient border b* shift consistent with offset stock (substrate_score=%.2f, delta_b=%+.2f, border_mad=1.50)', score, metric)
    WHEN 'likely_counterfeit' THEN printf('strong negative b* shift on border under flash — optical-brightener signature consistent with photo paper (substrate_score=%.2f, delta_b=%+.2f, border_mad=1.50)', score, metric)
    ELSE printf('borderline border b* shift — neither cleanly authentic nor cleanly fluorescent (substrate_score=%.2f, delta_b=%+.2f)', score, metric) END END AS reason
FROM judged""")
def detector_reasons(t: Tables) -> DataFrame:
    """One explanation per detector and verdict with its metrics."""
    rows = A.with_verdict(_measurements(t))
    return rows.select("submission_id", "detector", A.reason_text().alias("reason"))


@query("authenticity_rows", sql=f"""{WITH}
SELECT CAST(doc_id AS VARCHAR) AS submission_id, CASE WHEN bool_or(verdict = 'likely_counterfeit') THEN 'likely_counterfeit'
    WHEN bool_and(verdict = 'unverified') THEN 'unverified' WHEN bool_and(verdict IN ('authentic', 'unverified')) THEN 'authentic'
    ELSE 'suspicious' END AS verdict, coalesce(min(confidence) FILTER (confidence >= mc), 0.0) AS confidence,
  7 AS n_detectors, 7 AS n_reasons, 28 AS n_versions,
  max(verdict) FILTER (detector = 'knn_reference') AS knn_verdict FROM judged GROUP BY 1""")
def authenticity_rows(t: Tables) -> DataFrame:
    """Measurements to one result row: payload map, reasons, versions."""
    rows = A.authenticity_rows(_measurements(t))
    return rows.select("submission_id", "verdict", "confidence", F.size("detector_scores").alias("n_detectors"),
                       F.size("reasons").alias("n_reasons"), F.size("model_versions").alias("n_versions"),
                       F.get_json_object(F.col("detector_scores")["knn_reference"], "$.verdict").alias("knn_verdict"))


@query("authenticity_upsert", sql=f"""{WITH},
target AS (SELECT doc_id, 'stale' AS verdict FROM labels WHERE toxic = 1 UNION ALL SELECT -1 - item_id, 'kept' FROM benchmark),
fresh AS (SELECT doc_id, CASE WHEN bool_or(verdict = 'likely_counterfeit') THEN 'likely_counterfeit'
    WHEN bool_and(verdict = 'unverified') THEN 'unverified' WHEN bool_and(verdict IN ('authentic', 'unverified')) THEN 'authentic'
    ELSE 'suspicious' END AS verdict FROM judged GROUP BY 1)
SELECT coalesce(f.doc_id, t.doc_id) AS submission_id, coalesce(f.verdict, t.verdict) AS verdict
FROM fresh f FULL JOIN target t USING (doc_id)""")
def authenticity_upsert(t: Tables) -> DataFrame:
    """One authenticity row per submission, stale ones replaced."""
    stale = t.labels.where("toxic = 1").select(F.col("doc_id").alias("submission_id"), F.lit("stale").alias("verdict"))
    kept = t.benchmark.select((-1 - F.col("item_id")).alias("submission_id"), F.lit("kept").alias("verdict"))
    fresh = A.combine(A.with_verdict(_measured(t)), "doc_id").select(F.col("doc_id").alias("submission_id"), "verdict")
    return A.upsert_authenticity(stale.unionByName(kept), fresh)


@query("labelled_outcomes", sql=f"""{WITH}
SELECT detector, ground_truth, count(*) AS n, round(avg(score), 6) AS mean_score FROM outcomes GROUP BY 1, 2""")
def labelled_outcomes(t: Tables) -> DataFrame:
    """Outcomes joined to ground truth; unlabelled samples drop out."""
    return _outcomes(t).groupBy("detector", "ground_truth").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


CONFUSION = """SELECT detector, count(*) AS n_samples, count(*) FILTER (verdict = 'unverified') AS n_abstained,
  count(*) FILTER (verdict IN ('suspicious', 'likely_counterfeit') AND ground_truth = 'counterfeit') AS true_positives,
  count(*) FILTER (verdict IN ('suspicious', 'likely_counterfeit') AND ground_truth = 'authentic') AS false_positives,
  count(*) FILTER (verdict = 'authentic' AND ground_truth = 'authentic') AS true_negatives,
  count(*) FILTER (verdict = 'authentic' AND ground_truth = 'counterfeit') AS false_negatives FROM {0} GROUP BY 1"""


@query("confusion_matrix", sql=f"""{WITH}, ens AS (
  SELECT sample_id, ground_truth, CASE WHEN bool_or(verdict = 'likely_counterfeit') THEN 'likely_counterfeit'
    WHEN bool_and(verdict = 'unverified') THEN 'unverified' WHEN bool_and(verdict IN ('authentic', 'unverified')) THEN 'authentic'
    ELSE 'suspicious' END AS verdict FROM outcomes GROUP BY 1, 2),
every AS (SELECT detector, ground_truth, verdict FROM outcomes UNION ALL SELECT 'ensemble', ground_truth, verdict FROM ens),
m AS ({CONFUSION.format('every')})
SELECT *, round(true_positives / nullif(true_positives + false_negatives, 0), 6) AS true_positive_rate,
  round(false_positives / nullif(false_positives + true_negatives, 0), 6) AS false_positive_rate,
  round((true_positives + true_negatives) / nullif(true_positives + true_negatives + false_positives + false_negatives, 0), 6)
    AS accuracy FROM m""")
def confusion_matrix(t: Tables) -> DataFrame:
    """Confusion counts and rates per detector, ensemble included."""
    metrics, _ = jobs.benchmark(_outcomes(t))
    return metrics.withColumns({c: F.round(c, 6) for c in ("true_positive_rate", "false_positive_rate", "accuracy")})


@query("benchmark_report", sql=f"""{WITH}
SELECT 1 AS schema_version, count(DISTINCT sample_id) AS corpus_size,
  count(DISTINCT sample_id) FILTER (ground_truth = 'authentic') AS authentic,
  count(DISTINCT sample_id) FILTER (ground_truth = 'counterfeit') AS counterfeit, 8 AS n_detectors,
  count(*) FILTER (detector = 'color' AND verdict = 'unverified') AS color_abstained FROM outcomes""")
def benchmark_report(t: Tables) -> DataFrame:
    """Structured one-row metrics report."""
    _, report = jobs.benchmark(_outcomes(t))
    return report.select("schema_version", "corpus_size", F.col("ground_truth_counts.authentic").alias("authentic"),
                         F.col("ground_truth_counts.counterfeit").alias("counterfeit"), F.size("metrics").alias("n_detectors"),
                         F.col("metrics")["color"]["n_abstained"].alias("color_abstained"))


@query("sample_report", sql=f"""{WITH}
SELECT sample_id, ground_truth, count(*) AS n_outcomes, string_agg(detector || '=' || verdict, ',' ORDER BY detector) AS verdicts
FROM outcomes GROUP BY 1, 2""")
def sample_report(t: Tables) -> DataFrame:
    """Per-sample outcomes of the report."""
    listed = F.array_join(F.transform("outcomes", lambda o: F.concat(o["detector"], F.lit("="), o["verdict"])), ",")
    return E.sample_report(_outcomes(t)).select("sample_id", "ground_truth", F.size("outcomes").alias("n_outcomes"),
                                                listed.alias("verdicts"))


SCORES = "conf AS (SELECT detector, ground_truth, score FROM outcomes WHERE verdict <> 'unverified')"


@query("score_counts", sql=f"""{WITH}
SELECT detector, count(*) FILTER (verdict <> 'unverified' AND ground_truth = 'authentic') AS n_authentic,
  count(*) FILTER (verdict <> 'unverified' AND ground_truth = 'counterfeit') AS n_counterfeit,
  count(*) FILTER (verdict = 'unverified') AS n_abstained FROM outcomes GROUP BY 1""")
def score_counts(t: Tables) -> DataFrame:
    """Confident scores by label and abstentions."""
    return E.score_counts(_outcomes(t))


@query("score_distributions", sql=f"""{WITH}, {SCORES}
SELECT detector, ground_truth, count(*) AS n, round(min(score), 6) AS "min", round(quantile_cont(score, 0.05), 6) AS p5,
  round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50,
  round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95, round(max(score), 6) AS "max",
  round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS stddev FROM conf GROUP BY 1, 2""")
def score_distributions(t: Tables) -> DataFrame:
    """Distribution summary per detector and label."""
    rows = E.distributions(E.confident_scores(_outcomes(t)))
    return rows.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean", "stddev", *E.QUANTILES)})


SWEEP_SQL = f"""{WITH}, {SCORES},
pts AS (SELECT DISTINCT detector, score FROM conf),
nx AS (SELECT *, lead(score) OVER (PARTITION BY detector ORDER BY score) AS nxt,
  min(score) OVER (PARTITION BY detector) AS lo, max(score) OVER (PARTITION BY detector) AS hi FROM pts),
cand AS (
  SELECT detector, (score + nxt) / 2 AS candidate FROM nx WHERE nxt IS NOT NULL
  UNION ALL SELECT DISTINCT detector, CASE WHEN lo = hi THEN lo ELSE greatest(0.0, lo - 1e-3) END FROM nx
  UNION ALL SELECT DISTINCT detector, least(1.0, hi + 1e-3) FROM nx WHERE lo <> hi),
swept AS (
  SELECT c.detector, c.candidate, count(*) FILTER (s.score < c.candidate AND s.ground_truth = 'authentic') AS below_a,
    count(*) FILTER (s.score < c.candidate AND s.ground_truth = 'counterfeit') AS below_c,
    count(*) FILTER (s.ground_truth = 'authentic') AS n_a, count(*) FILTER (s.ground_truth = 'counterfeit') AS n_c
  FROM cand c JOIN conf s USING (detector) GROUP BY 1, 2),
js AS (SELECT *, below_c / n_c - below_a / n_a AS j FROM swept WHERE n_a > 0 AND n_c > 0),
best AS (SELECT detector, max(j) AS max_j FROM js GROUP BY 1),
two AS (SELECT detector, max(max_j) AS max_j, median(candidate) AS a FROM js JOIN best USING (detector)
  WHERE j >= max_j - 1e-12 GROUP BY 1),
good AS (SELECT detector, score, row_number() OVER (PARTITION BY detector ORDER BY score) AS rn,
  count(*) OVER (PARTITION BY detector) AS n FROM conf WHERE ground_truth = 'authentic'),
caps AS (SELECT detector, CASE WHEN floor(0.005 * max(n)) = 0 THEN greatest(0, min(score) - 1e-3)
    WHEN floor(0.005 * max(n)) >= max(n) THEN max(score)
    ELSE (max(score) FILTER (rn = floor(0.005 * n)) + max(score) FILTER (rn = floor(0.005 * n) + 1)) / 2 END AS cap
  FROM good GROUP BY 1),
low AS (SELECT t.detector, greatest(0, least(c.cap, (SELECT max(score) FROM conf s WHERE s.detector = t.detector
    AND ground_truth = 'counterfeit'), greatest(0, t.a - 0.01))) AS c FROM two t JOIN caps c USING (detector))"""


@query("threshold_candidates", sql=f"""{SWEEP_SQL}
SELECT detector, round(candidate, 9) AS candidate, below_a, below_c FROM swept""")
def threshold_candidates(t: Tables) -> DataFrame:
    """Every candidate threshold with its running counts."""
    return E.threshold_sweep(E.confident_scores(_outcomes(t))).withColumn("candidate", F.round("candidate", 9))


@query("two_sided_thresholds", sql=f"""{SWEEP_SQL}
SELECT detector, round(a, 9) AS authentic_threshold, round(max_j, 9) AS max_j FROM two""")
def two_sided(t: Tables) -> DataFrame:
    """Median of the plateau that maximizes TPR - FPR."""
    return E.two_sided_thresholds(E.confident_scores(_outcomes(t))).select(
        "detector", F.round("authentic_threshold", 9).alias("authentic_threshold"), F.round("max_j", 9).alias("max_j"))


@query("one_sided_thresholds", sql=f"""{WITH}, {SCORES}
SELECT detector, round(quantile_cont(score, 0.05), 9) AS authentic_threshold FROM conf WHERE ground_truth = 'authentic' GROUP BY 1""")
def one_sided(t: Tables) -> DataFrame:
    """Low percentile of the authentic scores."""
    return E.one_sided_thresholds(E.confident_scores(_outcomes(t))).select(
        "detector", F.round("authentic_threshold", 9).alias("authentic_threshold"))


@query("counterfeit_thresholds", sql=f"""{SWEEP_SQL} SELECT detector, round(c, 9) AS counterfeit_threshold FROM low""")
def counterfeit(t: Tables) -> DataFrame:
    """Lowest of the budget, territory and band caps."""
    scores = E.confident_scores(_outcomes(t))
    return E.counterfeit_thresholds(scores, E.two_sided_thresholds(scores)).select(
        "detector", F.round("counterfeit_threshold", 9).alias("counterfeit_threshold"))


@query("recommendations", sql=f"""{SWEEP_SQL},
rates AS (SELECT t.detector, count(*) FILTER (s.ground_truth = 'authentic' AND s.score >= t.a) AS keep,
    count(*) FILTER (s.ground_truth = 'authentic' AND s.score < t.a) AS lost,
    count(*) FILTER (s.ground_truth = 'counterfeit' AND s.score < t.a) AS caught,
    count(*) FILTER (s.ground_truth = 'authentic') AS n_a, count(*) FILTER (s.ground_truth = 'counterfeit') AS n_c
  FROM two t JOIN conf s USING (detector) GROUP BY 1)
SELECT r.detector, 'two_sided' AS mode, round(t.a, 9) AS authentic_threshold, round(l.c, 9) AS counterfeit_threshold,
  round(keep / n_a, 6) AS authentic_recall, round(caught / n_c, 6) AS counterfeit_recall, round(lost / n_a, 6) AS authentic_fpr,
  round(t.a - p.a, 6) AS authentic_delta, round(l.c - p.c, 6) AS counterfeit_delta,
  CASE WHEN n_a < 30 THEN 1 ELSE 0 END + CASE WHEN n_c < 10 THEN 1 ELSE 0 END AS n_notes
FROM rates r JOIN two t USING (detector) JOIN low l USING (detector) JOIN par p USING (detector)""")
def recommendations(t: Tables) -> DataFrame:
    """Recommended thresholds with achieved rates, deltas and notes."""
    truth = t.labels.select(F.col("doc_id").alias("sample_id"), F.when(
        F.col("quality") == 1, F.lit("authentic")).otherwise(F.lit("counterfeit")).alias("ground_truth"))
    advice, _ = jobs.recalibrate(_outcomes(t), truth)
    return advice.select(
        "detector", "mode", F.round("authentic_threshold", 9).alias("authentic_threshold"),
        F.round("counterfeit_threshold", 9).alias("counterfeit_threshold"),
        *[F.round(c, 6).alias(c) for c in ("authentic_recall", "counterfeit_recall", "authentic_fpr", "authentic_delta",
                                           "counterfeit_delta")], F.size("notes").alias("n_notes"))


# ------------------------------------------------------ validation metrics


@query("regression_error", sql="""SELECT round(avg(abs(p_retailprice / 200 - p_size / 5.0)), 6) AS mae, count(*) AS n FROM part""")
def regression_error(t: Tables) -> DataFrame:
    """Mean absolute error of predicted grades."""
    rows = t.part.select((F.col("p_retailprice") / 200).alias("p"), (F.col("p_size") / 5.0).alias("y"))
    return E.regression_error(rows, "p", "y").withColumn("mae", F.round("mae", 6))


@query("triplet_error", sql="""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
tr AS (SELECT a.e AS a, p.e AS p, n.e AS n FROM v a
  JOIN v p ON p.vec_id = a.vec_id + 1 JOIN v n ON n.vec_id = a.vec_id + 2),
d AS (SELECT list_distance(a, p) AS dp, list_distance(a, n) AS dn FROM tr)
SELECT round(avg(dp), 6) AS mean_positive, round(avg(dn), 6) AS mean_negative,
  round(avg(greatest(0, dp - dn + 0.3)), 6) AS loss, count(*) AS n FROM d""")
def triplet_error(t: Tables) -> DataFrame:
    """Mean positive and negative distance with the margin loss."""
    v = t.embeddings
    anchor = v.select("vec_id", F.col("embedding").alias("a"))
    positive = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("p"))
    negative = v.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("n"))
    out = E.triplet_error(anchor.join(positive, "vec_id").join(negative, "vec_id"), "a", "p", "n", 0.3)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_positive", "mean_negative", "loss")})


@query("label_accuracy", sql="""WITH m AS (SELECT list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN 2 WHEN x > -0.05 THEN 1 ELSE 0 END) AS p,
  list_transform(list_reverse(embedding), lambda x: CASE WHEN x > 0.05 THEN 2 WHEN x > -0.05 THEN 1 ELSE 0 END) AS y FROM embeddings),
f AS (SELECT unnest(p) AS p, unnest(y) AS y FROM m)
SELECT count(*) FILTER (p = y) AS correct, count(*) AS total, count(*) FILTER (p = y) / count(*) AS accuracy FROM f""")
def label_accuracy(t: Tables) -> DataFrame:
    """Correct positions of paired label arrays."""
    bucket = lambda x: F.when(x > 0.05, F.lit(2)).when(x > -0.05, F.lit(1)).otherwise(F.lit(0))
    rows = t.embeddings.select(F.transform("embedding", bucket).alias("p"),
                               F.transform(F.reverse("embedding"), bucket).alias("y"))
    return E.label_accuracy(rows, "p", "y")
