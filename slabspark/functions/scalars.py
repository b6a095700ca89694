"""Scalar column expressions: scores, ladders, verdicts and coercions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slabspark import params as P


def logistic(x: Column, midpoint: float, slope: float) -> Column:
    """1 / (1 + exp(-slope * (x - midpoint))); doubles saturate to 0 or 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(slope)) * (x - F.lit(float(midpoint)))))


def interp(x: Column, anchors: Sequence[tuple[float, float]], below: float | None = None) -> Column:
    """Piecewise-linear lookup; flat past the ends unless ``below`` is given."""
    first, last = anchors[0], anchors[-1]
    ladder = F.when(x < F.lit(float(first[0])), F.lit(float(first[1] if below is None else below)))
    for (x0, y0), (x1, y1) in zip(anchors, anchors[1:]):
        slope = (y1 - y0) / (x1 - x0)
        ladder = ladder.when(x <= F.lit(float(x1)), F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit(slope))
    return ladder.when(x.isNotNull(), F.lit(float(last[1])))


def step_lookup(x: Column, steps: Sequence[tuple[float, float]], otherwise: float = 1.0) -> Column:
    """First step whose upper bound is at or above ``x``."""
    ladder = F.when(x.isNull(), F.lit(None).cast("double"))
    for bound, value in steps:
        ladder = ladder.when(x <= F.lit(bound), F.lit(value))
    return ladder.otherwise(F.lit(otherwise))


def detector_score(detector: str, metric: Column) -> Column:
    d = P.DETECTOR_BY_NAME[detector]
    return logistic(metric, d.midpoint, d.slope)


def score_by_detector(detector: Column, metric: Column) -> Column:
    """Score of any detector's headline metric, parameters picked by name."""
    chain = None
    for d in P.DETECTORS:
        cond, value = detector == F.lit(d.name), logistic(metric, d.midpoint, d.slope)
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain


def verdict(score: Column, confidence: Column, authentic: Column, counterfeit: Column,
            min_confidence: Column) -> Column:
    return (
        F.when(confidence < min_confidence, F.lit("unverified"))
        .when(score >= authentic, F.lit("authentic"))
        .when(score < counterfeit, F.lit("likely_counterfeit"))
        .otherwise(F.lit("suspicious"))
    )


def threshold(detector: Column, field: str, default: float | None = None) -> Column:
    """A detector's fixed threshold as a constant map lookup (no join)."""
    pairs = [F.lit(v) for d in P.DETECTORS for v in (d.name, float(getattr(d, field)))]
    found = F.element_at(F.create_map(*pairs), detector)
    return found if default is None else F.coalesce(found, F.lit(default))


def verdict_by_detector(detector: Column, score: Column, confidence: Column) -> Column:
    return verdict(
        score, confidence, threshold(detector, "authentic"), threshold(detector, "counterfeit"),
        threshold(detector, "min_confidence"),
    )


def centroid_confidence(n: Column) -> Column:
    return interp(n, P.CENTROID_CONFIDENCE)


def neighbour_confidence(n: Column) -> Column:
    return interp(n, P.NEIGHBOUR_CONFIDENCE, below=0.0)


def mad_confidence(mad: Column) -> Column:
    """Linear in the MAD, floored and capped."""
    return F.least(
        F.lit(P.MAD_CONFIDENCE_CAP),
        F.greatest(F.lit(P.MAD_CONFIDENCE_FLOOR), interp(mad, P.MAD_CONFIDENCE)),
    )


def hash_score(distance: Column) -> Column:
    return (
        F.when(distance <= 0, F.lit(1.0))
        .when(distance <= 2, F.lit(0.95))
        .when(distance <= P.HASH_MAX_DISTANCE, F.lit(0.85) - F.lit(0.02) * (distance - F.lit(2)))
        .otherwise(F.lit(0.5))
    )


def embedding_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance)


def margin_confidence(method: Column, score: Column, runner_up: Column) -> Column:
    """Score tempered by its margin over the runner-up."""
    factor = F.least(F.lit(1.0), F.greatest(F.lit(0.5), (score - runner_up) * F.lit(5.0) + F.lit(0.5)))
    return F.when(((method == "phash") & (score >= 0.95)) | runner_up.isNull(), score).otherwise(score * factor)


def severity(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit("unknown"))
        .when(score > P.SEVERITY_OK, F.lit("ok"))
        .when(score >= P.SEVERITY_MINOR, F.lit("minor"))
        .otherwise(F.lit("major"))
    )


def defect_reasons(kind: Column, severity_: Column) -> Column:
    """Constant (kind, severity) dimension as a map lookup; no row -> empty array."""
    pairs = [F.lit(v) for (k, s), text in P.DEFECT_REASONS.items() for v in (f"{k}|{s}", text)]
    text = F.element_at(F.create_map(*pairs), F.concat_ws("|", kind, severity_))
    return F.when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def final_grade(centering: Column, corners: Column, edges: Column, surface: Column) -> Column:
    """Null when any part is null, else the minimum on the half-step grid.

    ``least`` skips nulls, hence the guard; ``bround`` is half-even.
    """
    parts = [centering, corners, edges, surface]
    missing = parts[0].isNull()
    for part in parts[1:]:
        missing = missing | part.isNull()
    return F.when(~missing, F.bround(F.least(*parts) * F.lit(2.0)) / F.lit(2.0))


def centering_offset(left: Column, top: Column) -> Column:
    """Distance of the worst axis from a centred 50/50."""
    return F.greatest(F.abs(left - F.lit(50.0)), F.abs(top - F.lit(50.0)))


def centering_subgrade(front_offset: Column, back_offset: Column) -> Column:
    """Front decides alone when there is no back."""
    front = step_lookup(front_offset, P.FRONT_CENTERING_STEPS)
    return F.least(front, step_lookup(back_offset, P.BACK_CENTERING_STEPS))


def edge_subgrade(fraction: Column) -> Column:
    return step_lookup(fraction, P.EDGE_STEPS)


def confidence_band(final: Column, confidence: Column) -> tuple[Column, Column]:
    width = (F.lit(1.0) - confidence) * F.lit(2.0)
    clamp = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(10.0), c))
    return clamp(final - width), clamp(final + width)


def as_double(value: Column) -> Column:
    """Numeric coercion, null when it fails."""
    return value.try_cast("double")


def age_seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def clamp_limit(value: int, low: int = 1, high: int = 200) -> int:
    return max(low, min(high, value))
