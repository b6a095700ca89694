"""Scalar functions against fixed values and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slabspark.functions import hashes as H
from slabspark.functions import quads as Q
from slabspark.functions import scalars as S
from slabspark.functions import text as X


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def many(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hash_signs(spark):
    values = [0, 123456, 2**63 - 1, 2**63, 2**64 - 1, 2**64]
    got = many(spark, [str(v) for v in values], "string", lambda x: H.to_signed(x.cast("decimal(21,0)")))
    assert got == [0, 123456, 2**63 - 1, -(2**63), -1, None]
    back = many(spark, [0, 5, -(2**63), -1], "long", H.to_unsigned)
    assert [int(v) for v in back] == [0, 5, 2**63, 2**64 - 1]
    assert many(spark, [0, 255, -1], "long", H.to_hex) == ["0" * 16, "0" * 14 + "ff", "f" * 16]
    assert many(spark, ["ffffffffffffffff", "00ff", "zz", None], "string", H.from_hex) == [-1, 255, None, None]


def test_hamming_is_sign_agnostic(spark):
    assert one(spark, H.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64
    assert one(spark, H.hamming(F.lit(-(2**63)).cast("long"), F.lit(1).cast("long"))) == 2


def test_interpolated_confidence(spark):
    assert many(spark, [0, 1, 2, 3, 4, 5, 10, 50], "int", S.centroid_confidence) == pytest.approx(
        [0, .4, .6, .7, .775, .85, 1, 1])
    assert many(spark, [0, 2, 3, 4, 5, 10, 11], "int", S.neighbour_confidence) == pytest.approx(
        [0, 0, .4, .55, .7, 1, 1])
    assert many(spark, [0.0, 1.0, 2.0, 2.9, 3.0, 9.0], "double", S.mad_confidence) == pytest.approx(
        [.7, .7, .7, .43, .4, .4])


def test_hash_ladder_and_margin(spark):
    assert many(spark, [0, 1, 2, 3, 6, 7], "int", S.hash_score) == pytest.approx([1, .95, .95, .83, .77, .5])
    cases = [("phash", .95, .94), ("embedding", .9, None), ("embedding", .9, .9), ("embedding", .9, .5), ("embedding", .9, .85)]
    df = spark.createDataFrame(cases, "m string, s double, r double")
    got = [r.c for r in df.select(S.margin_confidence(F.col("m"), F.col("s"), F.col("r")).alias("c")).collect()]
    assert got == pytest.approx([.95, .9, .45, .9, .9 * .75])


def test_verdict_bands(spark):
    cases = [("color", .2, .4, "suspicious"), ("color", .19, .4, "likely_counterfeit"), ("rosette", .35, .4, "suspicious"),
             ("rosette", .34, .9, "likely_counterfeit"), ("rosette", .65, .4, "authentic"), ("rosette", .99, .39, "unverified")]
    df = spark.createDataFrame(cases, "d string, s double, c double, want string")
    for r in df.withColumn("v", S.verdict_by_detector(F.col("d"), F.col("s"), F.col("c"))).collect():
        assert r.v == r.want


def test_final_grade(spark):
    cases = [(10.0, 9.0, 8.0, 9.5, 8.0), (10.0, 8.25, 9.0, 9.0, 8.0), (10.0, 8.75, 9.0, 9.0, 9.0), (10.0, None, 9.0, 9.0, None),
             (None, 9.0, 9.0, 9.0, None)]
    df = spark.createDataFrame(cases, "a double, b double, c double, d double, want double")
    for r in df.withColumn("f", S.final_grade(*[F.col(c) for c in "abcd"])).collect():
        assert r.f == r.want


def test_severity(spark):
    assert many(spark, [None, .96, .95, .85, .84], "double", S.severity) == ["unknown", "ok", "minor", "minor", "major"]


def test_subgrade_steps(spark):
    fronts = many(spark, [0.0, 5.0, 5.1, 45.0, 50.0], "double", lambda x: S.centering_subgrade(x, F.lit(None).cast("double")))
    assert fronts == [10, 10, 9, 2, 1]
    assert one(spark, S.centering_subgrade(F.lit(3.0), F.lit(41.0))) == 6
    assert many(spark, [0.0, .005, .006, .35, .36], "double", S.edge_subgrade) == [10, 10, 9, 2, 1]


def test_grade_and_year_tokens(spark):
    texts = ["GEM MT 10", "NM-MT+ 8.5", "MINT 9", "N0: AUTHENTIC", "", None]
    assert many(spark, texts, "string", lambda x: X.parse_grade(x)) == [10, 8.5, 9, None, None, None]
    assert many(spark, ["1999 x", "in 1799", "2024-25", "21999"], "string", X.parse_year) == [1999, None, 2024, None]


def test_text_keys(spark):
    assert many(spark, ["  Pikachu   EX", "Mewtwo & Mew", None], "string", X.group_key) == ["pikachu ex", "mewtwo & mew", ""]
    assert many(spark, ["Jace, the  Mind-Sculptor!", "Voldaren's Pact"], "string", X.comparison_text) == [
        "jace the mindsculptor", "voldarens pact"]


def test_urls(spark):
    urls = ["https://h/x.JPG?y=1", "ftp://h/x.jpg", "https://h/x.gif", "nope", None, "http://h/a b|c.png", "http://h/a.png;v=1", "http://h/q?x.png"]
    assert many(spark, urls, "string", X.is_image_url) == [True, False, False, False, False, True, True, False]
    assert many(spark, ["https://h/a", "http://h/a", "https:///a", None], "string", X.is_https_url) == [True, False, False, False]


@pytest.mark.parametrize("src,want", [
    ("/a/b.png", "https://h.com/a/b.png"), ("c.png", "https://h.com/x/c.png"), ("../c.png", "https://h.com/c.png"),
    ("./c.png", "https://h.com/x/c.png"), ("//cdn/z", "https://cdn/z"), ("http://o/z", "http://o/z"), ("data:abc", None),
    ("  ", None), ("?q=2", "https://h.com/x/y?q=2"), ("#t", "https://h.com/x/y?q=1#t"), (None, None),
])
def test_absolute_url(spark, src, want):
    assert one(spark, X.absolute_url(F.lit(src).cast("string"), F.lit("https://h.com/x/y?q=1"))) == want


def test_storage_keys(spark):
    assert many(spark, ["image/JPEG; a=b", "image/png", "text/html", "", None], "string", X.extension) == [
        "jpg", "png", "bin", "bin", "bin"]
    got = many(spark, ["mtg/a/b", "/x", "x/", "noslash"], "string", X.parse_key)
    assert got[0].manufacturer == "mtg" and got[0].variant_id == "a/b" and got[1:] == [None, None, None]


def _quad(*pts):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


def test_quads(spark):
    flat = _quad((0, 0), (10, 0), (10, 14), (0, 14))
    assert one(spark, Q.irregularity(flat), Q.off_axis_degrees(flat)) == (0.0, 0.0)
    bent = _quad((0, 0), (10, 0), (10, 14), (5, 14))
    assert one(spark, Q.off_axis_degrees(bent)) == pytest.approx(math.degrees(math.acos(.5)))
    assert one(spark, Q.irregularity(_quad((0, 0), (0, 0), (0, 0), (0, 0)))) == 1.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 2), min_size=2, max_size=20))
def test_scores_fall_with_distance(spark, distances):
    ordered = sorted(distances)
    scores = many(spark, ordered, "double", lambda x: S.detector_score("knn_reference", x))
    assert all(0 <= s <= 1 for s in scores) and all(a >= b for a, b in zip(scores, scores[1:]))
