"""Detector measurements -> scores, verdicts, reasons and combined results."""

from __future__ import annotations

import re

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions import scalars as S
from slabspark.functions import text as X
from slabspark.functions.vectors import cosine_distance, l2_normalize, norm
from slabspark.operators.search import nearest_mean
from slabspark.sources.store import merge_by_key

# ---------------------------------------------------------------- detectors


def centroids(references: DataFrame, group: str, vec: str) -> DataFrame:
    """Unit centroid and size per group; partial sums are combined map-side."""
    unit = references.where(F.col(vec).isNotNull()).select(
        F.col(group).alias(group), array_to_vector(l2_normalize(F.col(vec))).alias("_u"))
    mean = unit.groupBy(group).agg(Summarizer.mean(F.col("_u")).alias("_m"), F.count(F.lit(1)).alias("n_references"))
    raw = vector_to_array("_m")
    return mean.select(group, "n_references", norm(raw).alias("centroid_norm"), l2_normalize(raw).alias("centroid"))


def centroid_distance(submissions: DataFrame, references: DataFrame, sub_id: str, group: str, vec: str,
                      ref_vec: str | None = None) -> DataFrame:
    """Distance of each submission to its group's centroid.

    Submissions meet one centroid row per group, never the references
    themselves; no references -> abstain.
    """
    centre = centroids(references, group, ref_vec or vec)
    joined = submissions.join(centre, group, "left")
    n = F.coalesce("n_references", F.lit(0))
    distance = cosine_distance(F.col(vec), F.col("centroid"))
    return joined.select(
        sub_id, group, n.alias("n_references"),
        F.when(n > 0, distance).otherwise(F.lit(0.0)).alias("distance_from_centroid"),
        F.when(n > 0, S.detector_score("embedding_anomaly", distance)).otherwise(F.lit(0.5)).alias("score"),
        S.centroid_confidence(n).alias("confidence"),
        F.when(n == 0, F.lit("no_references")).alias("abstain_reason"),
    )


def reference_spread(references: DataFrame, ref_id: str, group: str, vec: str) -> DataFrame:
    """Distance of every reference to its own group's centroid."""
    centre = centroids(references, group, vec).select(group, "centroid")
    return references.join(centre, group).select(
        ref_id, group, cosine_distance(F.col(vec), F.col("centroid")).alias("distance_from_centroid"))


def neighbour_distance(submissions: DataFrame, references: DataFrame, sub_id: str, ref_id: str, group: str, vec: str,
                       k: int = P.DEFAULT_K, dim: int | None = None) -> DataFrame:
    """Mean distance to the k nearest references of the group; fewer than k -> abstain."""
    counts = references.where(F.col(vec).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sized = submissions.join(counts, group, "left").withColumn("n_references_used", F.coalesce("_n", F.lit(0)))
    enough = sized.where((F.col("n_references_used") >= k) & F.col(vec).isNotNull())
    means = nearest_mean(enough, references, sub_id, vec, ref_id, vec, group, k, dim)
    out = sized.join(means, sub_id, "left")
    mean = F.col("mean_topk_distance")
    return out.select(
        sub_id, group, "n_references_used", F.lit(k).alias("k"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_topk_distance"),
        F.when(mean.isNotNull(), S.detector_score("knn_reference", mean)).otherwise(F.lit(0.5)).alias("score"),
        F.when(mean.isNotNull(), S.neighbour_confidence(F.col("n_references_used"))).otherwise(F.lit(0.0))
        .alias("confidence"),
        F.when(F.col(vec).isNull(), F.lit("no_submitted_embedding"))
        .when(F.col("n_references_used") < k, F.lit("insufficient_references")).alias("abstain_reason"),
    )


def text_match(rows: DataFrame, expected: str, extracted: str) -> DataFrame:
    """Compare recognized text with the expected name.

    No expected name or no recognizer output (null) abstains; an empty result
    is scored at distance 1 with less confidence.
    """
    e, t = F.col(expected), X.strip(F.col(extracted))
    want, got = X.comparison_text(e), X.comparison_text(t)
    share = X.edit_distance_share(got, want)
    abstain = F.when(e.isNull() | (X.strip(e) == ""), F.lit("no_expected_text")).when(
        t.isNull(), F.lit("ocr_unavailable"))
    read = abstain.isNull() & (t != "")
    empty = abstain.isNull() & (t == "")
    return rows.withColumns({
        "levenshtein": F.when(read, F.levenshtein(got, want)),
        "normalized_distance": F.when(read, share).when(empty, F.lit(1.0)),
        "score": F.when(read, S.detector_score("typography", share))
        .when(empty, S.detector_score("typography", F.lit(1.0))).otherwise(F.lit(0.5)),
        "confidence": F.when(read, F.lit(P.OCR_CONFIDENCE_HIT)).when(empty, F.lit(P.OCR_CONFIDENCE_EMPTY))
        .otherwise(F.lit(0.0)),
        "abstain_reason": abstain,
    })


# ----------------------------------------------------------- verdict, reasons


def with_verdict(measurements: DataFrame) -> DataFrame:
    return measurements.withColumn(
        "verdict", S.verdict_by_detector(F.col("detector"), F.col("score"), F.col("confidence")))


def _quoted(c: Column) -> Column:
    """Text in single quotes, double ones when it holds an apostrophe only."""
    double = c.contains("'") & ~c.contains('"')
    body = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def _argument(name: str) -> Column:
    metrics = F.col("metrics")
    whole = {"analyzed_patches", "n_references", "n_references_used", "k"}
    if name in ("score", "confidence"):
        return F.col(name)
    if name == "reason":
        return F.coalesce("abstain_reason", F.lit("unknown"))
    if name == "extracted_text":
        return F.coalesce(_quoted(F.col("extracted_text")), F.lit("None"))
    if name == "levenshtein":
        return F.coalesce(metrics[name].cast("bigint").cast("string"), F.lit("None"))
    value = F.coalesce(metrics[name], F.lit(0.0))
    return value.cast("bigint") if name in whole else value


def _formatted(value: Column, spec: str) -> Column:
    """Decimals rounded half-even on the exact binary value (format_string rounds half-up)."""
    if not spec.endswith("f"):
        return value
    shape = "0." + "0" * int(spec[-2])
    if "+" in spec:
        shape = f"+{shape};-{shape}"
    return F.call_function("format_number", value, F.lit(shape))


def reason_text() -> Column:
    """Explanation of one measurement row (needs verdict, metrics, extracted_text)."""
    def render(entry) -> Column:
        fmt, names = entry
        if not names:
            return F.lit(fmt)
        specs = re.findall(r"%\+?(?:\.\d)?[dfs]", fmt)
        args = [_formatted(_argument(n), spec) for n, spec in zip(names, specs)]
        return F.format_string(re.sub(r"%\+?\.\df", "%s", fmt), *args)

    detector = F.col("detector")
    chain = None
    for name, table in P.REASONS.items():
        inner = None
        for key, entry in table.items():
            if key == "*":
                continue
            cond = F.col("verdict") == key if key in P.VERDICTS else (
                (F.col("verdict") == "unverified") & (F.col("abstain_reason") == key))
            inner = F.when(cond, render(entry)) if inner is None else inner.when(cond, render(entry))
        inner = inner.otherwise(render(table["*"]))
        chain = F.when(detector == name, inner) if chain is None else chain.when(detector == name, inner)
    return chain


# ----------------------------------------------------------------- combining


def combined_verdict(verdict: Column) -> Column:
    """Aggregate: any likely counterfeit wins, then consensus, else suspicious."""
    known = F.when(verdict.isin(*P.VERDICTS), verdict).otherwise(
        F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce(verdict, F.lit("null")))))
    any_bad = F.bool_or(known == "likely_counterfeit")
    confident = F.count_if(known != "unverified")
    all_good = F.bool_and((known == "authentic") | (known == "unverified"))
    return (F.when(any_bad, F.lit("likely_counterfeit")).when(confident == 0, F.lit("unverified"))
            .when(all_good, F.lit("authentic")).otherwise(F.lit("suspicious")))


def combined_confidence(detector: Column, confidence: Column, policy: str = "confident") -> Column:
    """Aggregate: minimum over confident detectors, or over all of them."""
    if policy == "all":
        return F.coalesce(F.min(confidence), F.lit(0.0))
    if policy != "confident":
        raise ValueError(f"confidence policy {policy!r}")
    return F.coalesce(F.min(F.when(confidence >= S.threshold(detector, "min_confidence", 0.0), confidence)),
                      F.lit(0.0))


def combine(measurements: DataFrame, key: str = "submission_id", policy: str = "confident") -> DataFrame:
    """One verdict and confidence per submission (verdict column required)."""
    return measurements.groupBy(key).agg(
        combined_verdict(F.col("verdict")).alias("verdict"),
        combined_confidence(F.col("detector"), F.col("confidence"), policy).alias("confidence"))


def model_versions() -> Column:
    """Detector versions plus the thresholds in force, as a flat map."""
    entries: dict[str, str] = {d.name: d.version for d in P.DETECTORS}
    for d in P.DETECTORS:
        entries[f"thresholds.{d.threshold_prefix}_authentic"] = str(d.authentic)
        entries[f"thresholds.{d.threshold_prefix}_counterfeit"] = str(d.counterfeit)
        entries[f"thresholds.{d.threshold_prefix}_min_confidence"] = str(d.min_confidence)
    return F.create_map(*[F.lit(v) for item in entries.items() for v in item])


def authenticity_rows(measurements: DataFrame) -> DataFrame:
    """Measurements -> one result row per submission.

    One column per detector is picked with an aggregate over a fixed list of
    seven names, so a group never has to be collected.
    """
    judged = with_verdict(measurements)
    judged = judged.withColumn("reason", reason_text())
    payload = F.struct("score", "verdict", "confidence", "abstain_reason", "metrics", "extracted_text", "reason")
    picked = [F.max_by(F.when(F.col("detector") == d.name, payload),
                       F.when(F.col("detector") == d.name, F.struct("confidence", "score"))).alias(f"_{d.name}")
              for d in P.DETECTORS]
    grouped = judged.groupBy("submission_id").agg(
        combined_verdict(F.col("verdict")).alias("verdict"),
        combined_confidence(F.col("detector"), F.col("confidence")).alias("confidence"), *picked)
    entries = F.filter(F.array(*[
        F.struct(F.lit(d.name).alias("key"), F.to_json(F.col(f"_{d.name}").dropFields("reason")).alias("value"))
        for d in P.DETECTORS]), lambda e: e["value"].isNotNull())
    reasons = F.array_compact(F.array(*[F.col(f"_{d.name}.reason") for d in P.DETECTORS]))
    return grouped.select("submission_id", "verdict", "confidence", F.map_from_entries(entries).alias("detector_scores"),
                          reasons.alias("reasons"), model_versions().alias("model_versions"))


def upsert_authenticity(target: DataFrame, rows: DataFrame) -> DataFrame:
    return merge_by_key(target, rows, ["submission_id"])


def unpack_detectors(rows: DataFrame, column: str = "detector_scores") -> DataFrame:
    """JSON blob of detector payloads -> one row per detector object.

    Payloads that are no objects are skipped; score, verdict and confidence
    become columns, everything else stays in ``metadata``.
    """
    entries = rows.select("submission_id", F.explode(F.from_json(column, "map<string,string>")).alias("detector", "p"))
    objects = entries.where(F.col("p").startswith("{")).withColumn("m", F.from_json("p", "map<string,string>"))
    m = F.col("m")
    return objects.select(
        "submission_id", "detector",
        F.coalesce(F.try_element_at(m, F.lit("score")).try_cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(F.try_element_at(m, F.lit("verdict")), F.lit("unverified")).alias("verdict"),
        F.coalesce(F.try_element_at(m, F.lit("confidence")).try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.map_filter(m, lambda k, _: ~k.isin("score", "verdict", "confidence")).alias("metadata"))


