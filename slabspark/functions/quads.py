"""Metrics of a four-point outline (TL, TR, BR, BL) held as array of structs."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def _side(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def _corners(quad: Column) -> tuple[Column, Column, Column, Column]:
    return quad[0], quad[1], quad[2], quad[3]


def _sides(quad: Column) -> tuple[Column, Column, Column, Column]:
    tl, tr, br, bl = _corners(quad)
    return _side(tl, tr), _side(bl, br), _side(tl, bl), _side(tr, br)


def irregularity(quad: Column) -> Column:
    """0 for a rectangle, up to 1 for a degenerate outline."""
    tl, tr, br, bl = _corners(quad)
    top, bottom, left, right = _sides(quad)

    def skew(a: Column, b: Column) -> Column:
        return F.when(F.greatest(a, b) <= 0, F.lit(1.0)).otherwise(F.abs(a - b) / F.greatest(a, b))

    def off_right_angle(prev: Column, at: Column, nxt: Column) -> Column:
        n1, n2 = _side(at, prev), _side(at, nxt)
        dot = (prev["x"] - at["x"]) * (nxt["x"] - at["x"]) + (prev["y"] - at["y"]) * (nxt["y"] - at["y"])
        cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (n1 * n2)))
        # null for a zero-length side; greatest() below skips nulls
        return F.when((n1 > 0) & (n2 > 0), F.abs(F.acos(cos) - F.lit(pi / 2)))

    angle = F.greatest(off_right_angle(bl, tl, tr), off_right_angle(tl, tr, br),
                       off_right_angle(tr, br, bl), off_right_angle(br, bl, tl)) / F.lit(pi / 2)
    return F.least(F.greatest(skew(top, bottom), skew(left, right), angle), F.lit(1.0))


def off_axis_degrees(quad: Column) -> Column:
    top, bottom, left, right = _sides(quad)

    def tilt(a: Column, b: Column) -> Column:
        ratio = F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(1.0))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))))

    return F.greatest(tilt(top, bottom), tilt(left, right))


def fill_ratio(width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    return (width * height) / (frame_width * frame_height).cast("double")


def mean_corner_distance(a: Column, b: Column) -> Column:
    steps = F.zip_with(a, b, lambda p, q: _side(p, q))
    return F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d) / F.lit(4.0)
