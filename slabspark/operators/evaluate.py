"""Detector evaluation: confusion metrics and threshold recalibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions.scalars import threshold
from slabspark.functions.vectors import l2_distance
from slabspark.operators.hot import exact_percentiles, ordered_scan
from slabspark.session import materialize

AUTHENTIC, COUNTERFEIT = "authentic", "counterfeit"


def label_outcomes(outcomes: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes with their ground truth; samples without a known label drop out."""
    known = labels.where(F.col("ground_truth").isin(AUTHENTIC, COUNTERFEIT)).select("sample_id", "ground_truth")
    return outcomes.join(known, "sample_id")


def confusion(outcomes: DataFrame) -> DataFrame:
    """Per detector: counts and rates; UNVERIFIED rows abstain."""
    verdict, truth = F.col("verdict"), F.col("ground_truth")
    confident = verdict != "unverified"
    positive = verdict.isin("suspicious", "likely_counterfeit")
    bad, good = truth == COUNTERFEIT, truth == AUTHENTIC
    counts = outcomes.groupBy("detector").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(~confident).alias("n_abstained"),
        F.count_if(confident & bad & positive).alias("true_positives"),
        F.count_if(confident & good & positive).alias("false_positives"),
        F.count_if(confident & good & ~positive).alias("true_negatives"),
        F.count_if(confident & bad & ~positive).alias("false_negatives"))
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    return counts.withColumns({
        "true_positive_rate": F.try_divide(tp, tp + fn), "false_positive_rate": F.try_divide(fp, fp + tn),
        "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn)})


def ensemble_outcomes(outcomes: DataFrame, policy: str = "all") -> DataFrame:
    """Add the combined row per sample (minimum confidence over all detectors)."""
    from slabspark.operators.authenticity import combined_confidence, combined_verdict

    combined = outcomes.groupBy("sample_id", "ground_truth").agg(
        combined_verdict(F.col("verdict")).alias("verdict"),
        combined_confidence(F.col("detector"), F.col("confidence"), policy).alias("confidence"))
    return outcomes.unionByName(combined.withColumns({
        "detector": F.lit("ensemble"), "score": F.lit(None).cast("double"), "error": F.lit(None).cast("string")}),
        allowMissingColumns=True)


def usable(outcomes: DataFrame) -> DataFrame:
    """Rows of the recalibratable detectors."""
    return outcomes.where(F.col("detector").isin(*[d.name for d in P.DETECTORS]))


def confident_scores(outcomes: DataFrame) -> DataFrame:
    """Scores that carry threshold signal, for the two known labels."""
    return usable(outcomes).where(
        (F.col("verdict") != "unverified") & F.col("score").isNotNull()
        & F.col("ground_truth").isin(AUTHENTIC, COUNTERFEIT)).select("detector", "ground_truth", "score")


def score_counts(outcomes: DataFrame) -> DataFrame:
    """Confident and abstained counts per detector (abstention is tested first)."""
    abstained = (F.col("verdict") == "unverified") | F.col("score").isNull()
    truth = F.col("ground_truth")
    return usable(outcomes).groupBy("detector").agg(
        F.count_if(~abstained & (truth == AUTHENTIC)).alias("n_authentic"),
        F.count_if(~abstained & (truth == COUNTERFEIT)).alias("n_counterfeit"),
        F.count_if(abstained).alias("n_abstained"))


QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95}


def distributions(scores: DataFrame) -> DataFrame:
    """Distribution summary per (detector, label); population stddev, exact percentiles."""
    keys = ["detector", "ground_truth"]
    basic = scores.groupBy(*keys).agg(
        F.count("score").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("stddev"))
    return basic.join(exact_percentiles(scores, keys, "score", QUANTILES), keys)


def score_points(outcomes: DataFrame) -> DataFrame:
    """(detector, score, na, nc, abstained): all counts of one pass over the outcomes; abstentions under a null score."""
    abstained = (F.col("verdict") == "unverified") | F.col("score").isNull()
    truth = F.col("ground_truth")
    return usable(outcomes).groupBy("detector", F.when(~abstained, F.col("score")).alias("score")).agg(
        F.count_if(~abstained & (truth == AUTHENTIC)).alias("na"), F.count_if(~abstained & (truth == COUNTERFEIT)).alias("nc"),
        F.count_if(abstained).alias("abstained"))


def prefix_table(points: DataFrame) -> DataFrame:
    """Points (detector, score, na, nc) with running counts: ``_ua``, ``_uc`` up to a score, ``_prev`` the score before it."""
    known = points.where(F.col("score").isNotNull() & (F.col("na") + F.col("nc") > 0)).select("detector", "score", "na", "nc")
    return ordered_scan(known, ["detector"], [("score", True)], sums={"_ua": F.col("na"), "_uc": F.col("nc")}, lags={"_prev": ("score", 1)})


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """Every candidate threshold with the counts strictly below it.

    Scores are first counted per distinct value, then one ordered pass gives
    the midpoints and running counts; the two bookends are added from the
    extremes.  Output: detector, candidate, below_a, below_c.
    """
    a, c = F.col("ground_truth") == AUTHENTIC, F.col("ground_truth") == COUNTERFEIT
    points = scores.groupBy("detector", "score").agg(F.count_if(a).alias("na"), F.count_if(c).alias("nc"))
    return _swept(prefix_table(points))


def _swept(scan: DataFrame) -> DataFrame:
    """The sweep from a prefix table."""
    midpoints = scan.where(F.col("_prev").isNotNull()).select(
        "detector", ((F.col("_prev") + F.col("score")) / 2.0).alias("candidate"),
        (F.col("_ua") - F.col("na")).alias("below_a"), (F.col("_uc") - F.col("nc")).alias("below_c"))
    ends = scan.groupBy("detector").agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("na").alias("a"), F.sum("nc").alias("c"),
        F.max_by("na", "score").alias("top_a"), F.max_by("nc", "score").alias("top_c"))
    zero = F.lit(0).cast("bigint")
    # a top score of exactly 1 is not below the clamped upper bookend
    upper = F.least(F.lit(1.0), F.col("hi") + F.lit(P.BOOKEND))
    clear = upper > F.col("hi")
    single = F.col("lo") == F.col("hi")
    edges = ends.select("detector", F.explode(F.when(single, F.array(
        F.struct(F.col("lo").alias("candidate"), zero.alias("below_a"), zero.alias("below_c")))).otherwise(F.array(
            F.struct(F.greatest(F.lit(0.0), F.col("lo") - F.lit(P.BOOKEND)).alias("candidate"),
                     zero.alias("below_a"), zero.alias("below_c")),
            F.struct(upper.alias("candidate"),
                     F.when(clear, F.col("a")).otherwise(F.col("a") - F.col("top_a")).alias("below_a"),
                     F.when(clear, F.col("c")).otherwise(F.col("c") - F.col("top_c")).alias("below_c")))))
        .alias("e")).select("detector", "e.*")
    return midpoints.unionByName(edges)


def two_sided_thresholds(scores: DataFrame) -> DataFrame:
    """Median of the candidates that maximize TPR - FPR, per detector with both labels."""
    a, c = F.col("ground_truth") == AUTHENTIC, F.col("ground_truth") == COUNTERFEIT
    return _two_sided(prefix_table(scores.groupBy("detector", "score").agg(F.count_if(a).alias("na"), F.count_if(c).alias("nc"))))


def _two_sided(prefix: DataFrame) -> DataFrame:
    sizes = prefix.groupBy("detector").agg(F.sum("na").alias("n_a"), F.sum("nc").alias("n_c")).where("n_a > 0 AND n_c > 0")
    swept = _swept(prefix).join(F.broadcast(sizes), "detector")  # one row per detector
    j = F.col("below_c") / F.col("n_c") - F.col("below_a") / F.col("n_a")
    swept = materialize(swept.select("detector", "candidate", j.alias("j")), "sweep")
    best = swept.groupBy("detector").agg(F.max("j").alias("max_j"))
    plateau = swept.join(F.broadcast(best), "detector").where(F.col("j") >= F.col("max_j") - F.lit(P.PLATEAU_TOLERANCE))
    mid = exact_percentiles(plateau, ["detector"], "candidate", {"authentic_threshold": 0.5})
    return mid.join(best, "detector")


def _one_sided(prefix: DataFrame, target_recall: float) -> DataFrame:
    """``one_sided_thresholds`` from running counts: the two order statistics around a place, weighed."""
    share = max(0.0, min(1.0, 1.0 - target_recall))
    sizes = prefix.groupBy("detector").agg(F.sum("na").alias("n")).where("n > 0").withColumn("at", F.lit(share) * (F.col("n") - 1))
    placed = prefix.where("na > 0").join(F.broadcast(sizes), "detector")  # one row per detector
    value = lambda k: F.min(F.when(F.col("_ua") > k, F.col("score")))
    met = placed.groupBy("detector", "at").agg(value(F.floor("at")).alias("low"), value(F.ceil("at")).alias("high"))
    weight = F.col("at") - F.floor("at")
    return met.select("detector", F.when(weight == 0, F.col("low")).otherwise(F.col("low") * (1 - weight) + F.col("high") * weight).alias("authentic_threshold"))


def one_sided_thresholds(scores: DataFrame, target_recall: float = P.TARGET_AUTHENTIC_RECALL) -> DataFrame:
    share = max(0.0, min(1.0, 1.0 - target_recall))
    return exact_percentiles(scores.where(F.col("ground_truth") == AUTHENTIC), ["detector"], "score",
                             {"authentic_threshold": share})


def fpr_caps(scores: DataFrame, fpr_budget: float = P.COUNTERFEIT_FPR_BUDGET) -> DataFrame:
    """Highest threshold that keeps the share of authentics below it in budget.

    The two neighbouring order statistics come from running counts over
    distinct scores, so no detector's scores are sorted in one task.
    """
    good = scores.where(F.col("ground_truth") == AUTHENTIC)
    return _caps(prefix_table(good.groupBy("detector", "score").agg(F.count(F.lit(1)).alias("na"), F.lit(0).alias("nc"))), fpr_budget)


def _caps(prefix: DataFrame, fpr_budget: float) -> DataFrame:
    upto = prefix.where("na > 0").withColumnRenamed("_ua", "_upto")
    sizes = upto.groupBy("detector").agg(F.sum("na").alias("size"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    allowed = F.floor(F.lit(float(fpr_budget)) * F.col("size"))
    placed = upto.join(F.broadcast(sizes), "detector").withColumn("allowed", allowed)  # one row per detector
    edge = placed.groupBy("detector").agg(
        F.first("allowed").alias("allowed"), F.first("size").alias("size"), F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
        F.min(F.when(F.col("_upto") >= F.col("allowed"), F.col("score"))).alias("under"),
        F.min(F.when(F.col("_upto") > F.col("allowed"), F.col("score"))).alias("over"))
    return edge.select("detector", F.when(
        F.col("allowed") == 0, F.greatest(F.lit(0.0), F.col("lo") - F.lit(P.BOOKEND)))
        .when(F.col("allowed") >= F.col("size"), F.col("hi"))
        .otherwise((F.col("under") + F.col("over")) / 2.0).alias("fpr_cap"))


def counterfeit_thresholds(scores: DataFrame, authentic: DataFrame,
                           fpr_budget: float = P.COUNTERFEIT_FPR_BUDGET) -> DataFrame:
    """Lowest of the budget cap, the highest counterfeit score and the band cap."""
    worst = scores.where(F.col("ground_truth") == COUNTERFEIT).groupBy("detector").agg(F.max("score").alias("_cf"))
    return _lower(authentic, fpr_caps(scores, fpr_budget), worst)


def _lower(authentic: DataFrame, caps: DataFrame, worst: DataFrame) -> DataFrame:
    rows = authentic.select("detector", "authentic_threshold").join(caps, "detector").join(worst, "detector", "left")
    band = F.greatest(F.lit(0.0), F.col("authentic_threshold") - F.lit(P.SUSPICIOUS_BAND))
    return rows.select("detector", F.greatest(F.lit(0.0), F.least(
        "fpr_cap", F.coalesce("_cf", F.lit(1.0)), band)).alias("counterfeit_threshold"))


def _notes(n_a: Column, n_c: Column) -> Column:
    return F.array_compact(F.array(
        F.when(n_a == 0, F.lit(
            "no confident authentic samples — cannot recommend any thresholds. Either supply authentic samples in "
            "the corpus, or relax detector MIN_CONFIDENCE gates (the latter has knock-on effects, prefer the former).")),
        F.when((n_a > 0) & (n_a < 30), F.format_string(
            "only %d confident authentic samples — recommendation is noisy; aim for ≥ 30 before locking the threshold.",
            n_a)),
        F.when((n_a > 0) & (n_c == 0), F.lit(
            "no counterfeit samples in corpus → only AUTHENTIC threshold recalibrated. COUNTERFEIT threshold left at "
            "current value; needs counterfeit data to recalibrate.")),
        F.when((n_a > 0) & (n_c > 0) & (n_c < 10), F.format_string(
            "only %d confident counterfeit samples — counterfeit-side recommendation is highly noisy; aim for ≥ 30.",
            n_c))))


def recommendations(outcomes: DataFrame, target_recall: float = P.TARGET_AUTHENTIC_RECALL,
                    fpr_budget: float = P.COUNTERFEIT_FPR_BUDGET) -> DataFrame:
    """Recommended thresholds per detector with mode, achieved rates, deltas and notes.

    The outcomes are read once, into counts per detector and score; everything
    else follows from their running sums.
    """
    points = materialize(score_points(outcomes), "score-points")
    prefix = materialize(prefix_table(points), "score-prefix")
    counts = points.groupBy("detector").agg(F.sum("na").alias("n_authentic"), F.sum("nc").alias("n_counterfeit"), F.sum("abstained").alias("n_abstained"))
    two = _two_sided(prefix).select("detector", F.col("authentic_threshold").alias("_two"))
    one = _one_sided(prefix, target_recall).select("detector", F.col("authentic_threshold").alias("_one"))
    n_a, n_c = F.col("n_authentic"), F.col("n_counterfeit")
    mode = F.when(n_a == 0, F.lit("insufficient")).when(n_c == 0, F.lit("authentic_only")).otherwise(F.lit("two_sided"))
    chosen = counts.join(two, "detector", "left").join(one, "detector", "left").withColumn("mode", mode).withColumn(
        "authentic_threshold", F.when(F.col("mode") == "two_sided", F.col("_two"))
        .when(F.col("mode") == "authentic_only", F.col("_one"))).drop("_two", "_one")
    chosen = materialize(chosen, "chosen")  # one row per detector, read three times
    worst = prefix.where("nc > 0").groupBy("detector").agg(F.max("score").alias("_cf"))
    low = _lower(chosen.where(F.col("mode") == "two_sided"), _caps(prefix, fpr_budget), worst)
    sides = prefix.join(F.broadcast(chosen.select("detector", "authentic_threshold")), "detector")
    below = F.col("score") < F.col("authentic_threshold")
    part = lambda n, cond: F.coalesce(F.sum(F.when(cond, F.col(n))), F.lit(0))
    rates = sides.groupBy("detector").agg(part("na", ~below).alias("_keep"), part("na", below).alias("_lost"), part("nc", below).alias("_caught"))
    both = F.col("mode") == "two_sided"
    cur_a = threshold(F.col("detector"), "authentic")
    cur_c = threshold(F.col("detector"), "counterfeit")
    return chosen.join(low, "detector", "left").join(rates, "detector", "left").select(
        "detector", "mode", "n_authentic", "n_counterfeit", "n_abstained", "authentic_threshold",
        "counterfeit_threshold",
        F.when(n_a > 0, F.try_divide(F.col("_keep"), n_a)).alias("authentic_recall"),
        F.when(both, F.try_divide(F.col("_caught"), n_c)).alias("counterfeit_recall"),
        F.when(both, F.try_divide(F.col("_lost"), n_a)).alias("authentic_fpr"),
        cur_a.alias("current_authentic_threshold"), cur_c.alias("current_counterfeit_threshold"),
        (F.col("authentic_threshold") - cur_a).alias("authentic_delta"),
        (F.col("counterfeit_threshold") - cur_c).alias("counterfeit_delta"), _notes(n_a, n_c).alias("notes"))


def metrics_report(metrics: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One-row report: corpus size, label counts and metrics per detector.

    Per-sample outcomes grow with the corpus and are written as their own
    table (``sample_report``) instead of one list.
    """
    samples = outcomes.select("sample_id", "ground_truth").distinct().agg(
        F.count(F.lit(1)).alias("corpus_size"),
        F.struct(F.count_if(F.col("ground_truth") == AUTHENTIC).alias(AUTHENTIC),
                 F.count_if(F.col("ground_truth") == COUNTERFEIT).alias(COUNTERFEIT)).alias("ground_truth_counts"))
    listed = metrics.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "detector", F.struct(*[c for c in metrics.columns if c != "detector"]).alias("m"))))).alias("metrics"))
    return samples.select(F.lit(1).alias("schema_version"), "*", listed.scalar().alias("metrics"))


def sample_report(outcomes: DataFrame) -> DataFrame:
    """One row per sample with its (at most eight) detector outcomes."""
    return outcomes.groupBy("sample_id", "ground_truth").agg(F.sort_array(F.collect_list(F.struct(
        "detector", "score", "confidence", "verdict", "error"))).alias("outcomes"))


# ------------------------------------------------------ validation metrics


def regression_error(predictions: DataFrame, predicted: str, actual: str) -> DataFrame:
    return predictions.agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"), F.count(actual).alias("n"))


def triplet_error(triplets: DataFrame, anchor: str, positive: str, negative: str, margin: float) -> DataFrame:
    dp, dn = l2_distance(F.col(anchor), F.col(positive)), l2_distance(F.col(anchor), F.col(negative))
    return triplets.select(dp.alias("dp"), dn.alias("dn")).agg(
        F.avg("dp").alias("mean_positive"), F.avg("dn").alias("mean_negative"),
        F.avg(F.greatest(F.lit(0.0), F.col("dp") - F.col("dn") + F.lit(float(margin)))).alias("loss"),
        F.count(F.lit(1)).alias("n"))


def label_accuracy(maps: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Correct positions over all positions of paired label arrays."""
    right = F.size(F.filter(F.zip_with(predicted, actual, lambda p, a: p == a), lambda x: x))
    return maps.agg(F.sum(right).cast("bigint").alias("correct"),
                    F.sum(F.size(actual)).cast("bigint").alias("total")).withColumn(
        "accuracy", F.try_divide("correct", "total"))
