"""Robust statistics over measured series: outliers, shifts, tails, profiles.

Medians and percentiles go through ``exact_percentiles`` so one series may
hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabspark import params as P
from slabspark.functions.scalars import detector_score, mad_confidence
from slabspark.operators.hot import exact_percentiles, ordered_scan, split_hot


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe equi-join of per-group statistics back to the rows."""
    renamed = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in stats.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return df.join(renamed, cond).drop(*[f"_k_{k}" for k in keys])


def median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: median and median absolute deviation (two exact passes)."""
    mid = exact_percentiles(df, keys, value, {"median": 0.5})
    off = attach(df.select(*keys, value), mid, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    return attach(mid, exact_percentiles(off, keys, "_dev", {"mad": 0.5}), keys)


def with_median_and_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with their group's median and median absolute deviation.

    Ordinary groups need one shuffle: both medians are window aggregates over
    the same partitioning.  Hot groups join exact percentiles back instead.
    """
    rows = df.select(*keys, value).where(F.col(value).isNotNull())
    ordinary, hot = split_hot(rows, keys)
    group = Window.partitionBy(*keys)
    out = ordinary.withColumn("median", F.percentile(value, F.lit(0.5)).over(group)).withColumn(
        "_dev", F.abs(F.col(value) - F.col("median"))).withColumn(
        "mad", F.percentile("_dev", F.lit(0.5)).over(group)).drop("_dev")
    return out if hot is None else out.unionByName(attach(hot, median_and_mad(hot, keys, value), keys))


def outlier_fraction(df: DataFrame, keys: Sequence[str], value: str, factor: float = P.MAD_FACTOR,
                     floor: float = P.MAD_FLOOR) -> DataFrame:
    """Per series: length, anomaly count and fraction of |x - median| > factor * max(MAD, floor)."""
    flagged = with_median_and_mad(df, keys, value)
    far = F.abs(F.col(value) - F.col("median")) > F.lit(factor) * F.greatest(F.col("mad"), F.lit(floor))
    return flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"), F.count_if(far).alias("anomaly_count"),
        F.avg(far.cast("int")).alias("anomaly_fraction"), F.stddev_pop(value).alias("stddev"))


def paired_shift(df: DataFrame, key: str, condition: str, value: str, before: str, after: str,
                 min_rows: int = P.MIN_REFERENCE_ROWS) -> DataFrame:
    """median(after) - median(before) with a confidence from the MAD of ``before``.

    Abstains when either condition is missing or ``before`` has too few rows.
    """
    mid = exact_percentiles(df, [key, condition], value, {"median": 0.5})
    base = df.where(F.col(condition) == before).select(key, value)
    mad = median_and_mad(base, [key], value).select(key, "mad")
    sizes = df.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count_if(F.col(condition) == before).alias("n_before"), F.count_if(F.col(condition) == after).alias("n_after"))
    sides = mid.groupBy(key).agg(
        F.max(F.when(F.col(condition) == before, F.col("median"))).alias("_b"),
        F.max(F.when(F.col(condition) == after, F.col("median"))).alias("_a"))
    mad = mad.withColumnRenamed(key, "_mk")
    joined = attach(sizes, sides, [key]).join(mad, F.col(key).eqNullSafe(F.col("_mk")), "left")
    reason = F.when(F.col("n_after") == 0, F.lit("flash_not_captured")).when(
        F.col("n_before") < min_rows, F.lit("border_too_small"))
    delta = F.when(reason.isNull(), F.col("_a") - F.col("_b"))
    return joined.select(
        key, F.col("n_before").alias("n_border_pixels"), delta.alias("delta_b"),
        F.when(reason.isNull(), F.col("mad")).alias("border_mad"),
        F.when(reason.isNull(), detector_score("substrate", delta)).otherwise(F.lit(0.5)).alias("score"),
        F.when(reason.isNull(), mad_confidence(F.col("mad"))).otherwise(F.lit(0.0)).alias("confidence"),
        reason.alias("abstain_reason"))


def tail_statistic(df: DataFrame, key: str, in_band: Column, value: str) -> DataFrame:
    """p95 of the inner values, gated by mean and spread of the reference band."""
    inner = exact_percentiles(df.where(~in_band), [key], value, {"p95": 0.95})
    band = df.groupBy(key).agg(
        F.avg(F.when(in_band, F.col(value))).alias("band_mean"),
        F.stddev_pop(F.when(in_band, F.col(value))).alias("band_stddev"))
    joined = band.join(inner, key, "left")
    unreliable = (F.col("band_mean").isNull() | (F.col("band_mean") < P.MIN_BAND_MEAN)
                  | (F.col("band_stddev") > P.MAX_BAND_STDDEV * 3) | F.col("p95").isNull())
    quality = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("band_stddev") / F.lit(P.MAX_BAND_STDDEV))
    return joined.select(
        key, "band_mean", "band_stddev", F.when(unreliable, F.lit(0.0)).otherwise(F.col("p95")).alias("p95"),
        F.when(unreliable, F.lit(0.5)).otherwise(detector_score("color", F.col("p95"))).alias("score"),
        F.when(unreliable, F.lit(0.0)).otherwise(F.least(F.lit(1.0), quality)).alias("confidence"))


def inside_contrast(df: DataFrame, key: str, inside: Column, value: str) -> DataFrame:
    """mean(inside) over mean(outside), with the share of inside rows as confidence."""
    stats = df.groupBy(key).agg(
        F.avg(F.when(inside, F.col(value))).alias("_in"), F.avg(F.when(~inside, F.col(value))).alias("_out"),
        F.avg(inside.cast("int")).alias("mask_fraction"))
    share = F.col("mask_fraction")
    abstain = (share < P.HOLO_MIN_FRACTION) | F.col("_in").isNull() | F.col("_out").isNull()
    ratio = F.when(~abstain, F.col("_in") / F.greatest(F.col("_out"), F.lit(P.HOLO_OUTSIDE_FLOOR)))
    span = P.HOLO_FULL_FRACTION - P.HOLO_MIN_FRACTION
    ramp = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (share - P.HOLO_MIN_FRACTION) / span))
    confidence = F.when(share >= P.HOLO_FULL_FRACTION, F.lit(P.HOLO_CONFIDENCE_FULL)).otherwise(
        F.lit(P.HOLO_CONFIDENCE_REDUCED) + ramp * F.lit(P.HOLO_CONFIDENCE_FULL - P.HOLO_CONFIDENCE_REDUCED))
    return stats.select(
        key, share.alias("mask_fraction"), ratio.alias("flow_ratio"),
        F.when(abstain, F.lit(0.5)).otherwise(detector_score("holographic", ratio)).alias("score"),
        F.when(abstain, F.lit(0.0)).otherwise(confidence).alias("confidence"),
        F.when(abstain, F.lit("no_holo_region")).alias("abstain_reason"))


def binned_profile(df: DataFrame, key: str, position: Column, value: str) -> DataFrame:
    """Mean value per integer bin."""
    return df.groupBy(key, F.floor(position).cast("int").alias("bin")).agg(F.avg(value).alias("level"))


def band_prominence(profile: DataFrame, key: str, band: tuple[int, int] = P.ROSETTE_BAND, skip: int = 3) -> DataFrame:
    """Highest level inside the band over the mean level outside it (bins below ``skip`` ignored)."""
    inside = F.col("bin").between(*band)
    outside = (F.col("bin") >= skip) & ~inside
    out = profile.groupBy(key).agg(
        F.max(F.when(inside, F.col("level"))).alias("_peak"), F.avg(F.when(outside, F.col("level"))).alias("_base"))
    usable = F.col("_peak").isNotNull() & (F.col("_base") > 1e-6)
    return out.select(key, F.when(usable, F.col("_peak") / F.col("_base")).otherwise(F.lit(0.0)).alias("peak_strength"))


def rosette_measurement(patches: DataFrame, key: str, wanted: int = 5) -> DataFrame:
    """Patch prominences -> mean, score and confidence by number of patches found."""
    return patches.groupBy(key).agg(
        F.avg("peak_strength").alias("peak_strength"), F.count("peak_strength").alias("analyzed_patches"),
    ).select(key, F.coalesce("peak_strength", F.lit(0.0)).alias("peak_strength"), "analyzed_patches",
             F.coalesce(detector_score("rosette", F.col("peak_strength")), F.lit(0.5)).alias("score"),
             F.least(F.lit(1.0), F.col("analyzed_patches") / F.lit(float(wanted))).alias("confidence"))


def peak_position(df: DataFrame, key: str, position: str, value: str, share: float = P.PEAK_SHARE) -> DataFrame:
    """Weighted centroid of positions at or above a share of the peak.

    A peak at or below zero falls back to its first position.
    """
    peak = df.groupBy(key).agg(
        F.max(value).alias("_peak"),
        F.min_by(position, F.struct(-F.col(value), F.col(position))).alias("_first"))
    high = attach(df.select(key, position, value), peak, [key])
    inside = F.col(value) >= F.col("_peak") * F.lit(share)
    return high.groupBy(key).agg(
        F.first("_peak").alias("_peak"), F.first("_first").alias("_first"),
        F.sum(F.when(inside, F.col(position) * F.col(value))).alias("_wp"),
        F.sum(F.when(inside, F.col(value))).alias("_w"),
    ).select(key, F.when(F.col("_peak") > 0, F.col("_wp") / F.col("_w")).otherwise(F.col("_first").cast("double"))
             .alias("position"))


def share_above(df: DataFrame, key: str, predicate: Column, cap: float = P.GLARE_MAX_SHARE) -> DataFrame:
    """Share of rows that meet the predicate, compared to a cap."""
    return df.groupBy(key).agg(F.avg(predicate.cast("int")).alias("share")).withColumn(
        "above_cap", F.col("share") > F.lit(cap))


def track_lock(track: DataFrame, key: str, frame: str, quad: str) -> DataFrame:
    """Rolling lock over a track of outlines.

    The smoothing buffer holds at most four outlines since the last jump or
    gap, so a row only depends on the three rows before it.  Coordinates are
    plain double columns, which keeps the arithmetic inside generated code.
    """
    axes = [(i, a) for i in range(4) for a in ("x", "y")]
    flat = track.withColumns({f"_{a}{i}": F.col(quad)[i][a] for i, a in axes})
    lags = {f"_{a}{i}_{k}": (f"_{a}{i}", k) for i, a in axes for k in (1, 2, 3)}
    scan = ordered_scan(flat, [key], [(frame, True)], lags=lags).withColumns({f"_{a}{i}_0": F.col(f"_{a}{i}") for i, a in axes})

    def at(axis: str, i: int, k: int) -> Column:
        return F.col(f"_{axis}{i}_{k}")

    def distance(dx: Column, dy: Column) -> Column:
        return F.sqrt(dx * dx + dy * dy)

    def follows(k: int) -> Column:
        """Row k steps back continues the row before it (null corners do not)."""
        total = sum(distance(at("x", i, k) - at("x", i, k + 1), at("y", i, k) - at("y", i, k + 1)) for i in range(4))
        return F.coalesce(total / F.lit(4.0) <= P.LOCK_RESET_DISTANCE, F.lit(False))

    s1 = follows(0)
    s2, s3 = s1 & follows(1), s1 & follows(1) & follows(2)
    sized = scan.withColumn("_n", F.when(s3, 4).when(s2, 3).when(s1, 2).otherwise(1))
    n = F.col("_n")

    def mean(axis: str, i: int) -> Column:
        return sum((F.when(n > k, at(axis, i, k)).otherwise(F.lit(0.0)) for k in (1, 2, 3)), at(axis, i, 0)) / n

    smooth = sized.withColumns({f"_m{a}{i}": mean(a, i) for i, a in axes})
    off = [F.when(n > k, distance(at("x", i, k) - F.col(f"_mx{i}"), at("y", i, k) - F.col(f"_my{i}")))
           for i in range(4) for k in range(4)]
    seen = F.col("_x0").isNotNull()
    smoothed = F.array(*[F.struct(F.col(f"_mx{i}").alias("x"), F.col(f"_my{i}").alias("y")) for i in range(4)])
    return smooth.select(
        *track.columns, F.when(seen, smoothed).alias("smoothed"),
        F.when(seen, F.greatest(*off)).otherwise(F.lit(0.0)).alias("deviation"),
        F.when(seen, n / F.lit(float(P.LOCK_WINDOW))).otherwise(F.lit(0.0)).alias("progress"),
    ).withColumn("locked", (F.col("progress") >= 1.0) & (F.col("deviation") <= P.LOCK_STABLE_DEVIATION))
