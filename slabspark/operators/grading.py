"""Capture gate, subgrades, final grade and grade rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions import scalars as S
from slabspark.sources.store import merge_by_key


def _limit(kind: Column, index: int) -> Column:
    """Per-kind limit as a constant map lookup, default for unknown kinds."""
    pairs = [F.lit(v) for k, row in P.QUALITY_BY_KIND.items() for v in (k, row[index])]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(P.DEFAULT_QUALITY[index]))


def quality_gate(shots: DataFrame) -> DataFrame:
    """Pass flag and reasons from measured metrics.

    Needs kind, blur, glare (may be null), card_detected, card_fill,
    perspective.
    """
    kind, R = F.col("kind"), P.QUALITY_REASONS
    detected = F.col("card_detected")
    low, high = F.col("card_fill") < _limit(kind, 3), F.col("card_fill") > _limit(kind, 4)
    checks = [
        F.when(F.col("blur") < _limit(kind, 0), F.lit(R["blur"])),
        F.when(F.col("glare") > _limit(kind, 1), F.lit(R["glare"])),
        F.when(_limit(kind, 5) & ~detected, F.lit(R["missing"])),
        F.when(detected & low, F.lit(R["small"])).when(detected & high, F.lit(R["large"])),
        F.when(detected & (F.col("perspective") > _limit(kind, 2)), F.lit(R["tilt"])),
    ]
    reasons = F.array_compact(F.array(*checks))
    return shots.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def worse_face(faces: DataFrame, key: str = "submission_id") -> DataFrame:
    """Lowest face subgrade (front on a tie) and mean confidence over faces."""
    rank = F.when(F.col("face") == "front", 0).otherwise(1)
    return faces.groupBy(key).agg(
        F.min("subgrade").alias("subgrade"),
        F.min_by("face", F.struct("subgrade", rank)).alias("worse_face"),
        F.avg("confidence").alias("confidence"))


def centering_from_ratios(faces: DataFrame, key: str = "submission_id") -> DataFrame:
    """Rows (key, face, left, top, confidence) -> centering subgrade per key."""
    face = F.col("face")
    offset = S.centering_offset(F.col("left"), F.col("top"))
    return faces.groupBy(key).agg(
        F.max(F.when(face == "front", offset)).alias("_f"), F.max(F.when(face == "back", offset)).alias("_b"),
        F.max(F.when(face == "front", F.col("left"))).alias("front_centering_lr"),
        F.max(F.when(face == "front", F.col("top"))).alias("front_centering_tb"),
        F.max(F.when(face == "back", F.col("left"))).alias("back_centering_lr"),
        F.max(F.when(face == "back", F.col("top"))).alias("back_centering_tb"),
        F.avg("confidence").alias("confidence"),
    ).where(F.col("_f").isNotNull()).select(
        key, S.centering_subgrade(F.col("_f"), F.col("_b")).alias("centering"), "front_centering_lr",
        "front_centering_tb", "back_centering_lr", "back_centering_tb", "confidence")


def edge_face(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Per-side counts (anomaly_count, length) -> fraction, subgrade, confidence; a side without length has no anomalies."""
    share = F.coalesce(F.try_divide(F.col("anomaly_count"), F.col("length")), F.lit(0.0))
    return sides.groupBy(*keys).agg(
        F.try_divide(F.sum("anomaly_count"), F.sum("length")).alias("fraction"),
        (F.max(share) - F.min(share)).alias("spread"),
    ).select(*keys, F.coalesce("fraction", F.lit(0.0)).alias("fraction"),
             S.edge_subgrade(F.coalesce("fraction", F.lit(0.0))).alias("subgrade"),
             F.greatest(F.lit(0.5), F.lit(1.0) - F.lit(2.0) * F.col("spread")).alias("confidence"))


def regions(grades: DataFrame, key: str = "submission_id") -> DataFrame:
    """One grade row -> ten region rows with score, severity and reasons."""
    items = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(position).alias("position"),
                 (F.col(P.REGION_COLUMN[kind]) / F.lit(10.0)).alias("score"))
        for kind, position in P.REGIONS])
    flat = grades.select(key, F.explode(items).alias("r")).select(key, "r.*")
    return flat.withColumn("severity", S.severity(F.col("score"))).withColumn(
        "reasons", S.defect_reasons(F.col("kind"), F.col("severity")))


def defect_list(region_rows: DataFrame, key: str = "submission_id") -> DataFrame:
    """Flagged defects, grouped by kind in display order."""
    order = F.create_map(*[F.lit(v) for i, k in enumerate(P.DEFECT_KIND_ORDER) for v in (k, i)])
    return region_rows.where(F.size("reasons") > 0).select(
        key, order[F.col("kind")].alias("kind_order"), "kind", "position", F.explode("reasons").alias("reason"),
    ).orderBy(key, "kind_order", "position", "reason")


# ------------------------------------------------------------- persistence


def _final() -> Column:
    return S.final_grade(F.col("centering"), F.col("corners"), F.col("edges"), F.col("surface"))


def upsert_centering(grades: DataFrame, measured: DataFrame, scheme: str = "psa",
                     versions: dict[str, str] | None = None) -> DataFrame:
    """Insert or update the centering part; other parts stay, final is recomputed."""
    old = grades.where(F.col("scheme") == scheme).select("submission_id", "corners", "edges", "surface")
    version = {"centering": P.GEOMETRIC_VERSION, **(versions or {})}
    rows = measured.join(old, "submission_id", "left").withColumn("scheme", F.lit(scheme)).withColumn(
        "final", _final()).withColumn(
        "model_versions", F.create_map(*[F.lit(v) for item in version.items() for v in item]))
    return merge_by_key(grades, rows.select(*grades.columns), ["submission_id", "scheme"])


def upsert_edges(grades: DataFrame, measured: DataFrame, scheme: str = "psa",
                 versions: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(grades with the edges part set, measurements without a grade row).

    Confidence becomes the minimum so far and versions are merged.
    """
    new = measured.select("submission_id", F.col("subgrade").alias("_e"), F.col("confidence").alias("_c"),
                          F.col("worse_face").alias("_w"))
    own = grades.where(F.col("scheme") == scheme)
    orphans = new.join(own.select("submission_id"), "submission_id", "left_anti").select("submission_id")
    added = {"edges": P.GEOMETRIC_VERSION, **(versions or {})}
    fresh = F.map_concat(F.create_map(*[F.lit(v) for item in added.items() for v in item]),
                         F.create_map(F.lit("edges_worse_face"), F.col("_w")))
    kept = F.map_filter(F.coalesce("model_versions", F.create_map().cast("map<string,string>")),
                        lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    rows = own.join(new, "submission_id").withColumns({
        "edges": F.col("_e"), "confidence": F.least("confidence", "_c"),
        "model_versions": F.map_concat(kept, fresh)}).withColumn("final", _final())
    return merge_by_key(grades, rows.select(*grades.columns), ["submission_id", "scheme"]), orphans
