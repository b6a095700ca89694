"""Hot-group paths give what plain windows and numpy give."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slabspark.operators import hot as H


@pytest.fixture()
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        g = [None, "a", "a", "a", "b", f"small{i % 40}"][i % 6]
        v = None if i % 11 == 0 else float(rng.integers(0, 12)) / 2
        data.append((i, g, v, int(rng.integers(0, 50))))
    return spark.createDataFrame(data, "id long, g string, v double, t int")


def _plain(rows):
    w = Window.partitionBy("g").orderBy(F.col("t").asc_nulls_first(), "id")
    r = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("id", F.sum(F.lit(1)).over(r).alias("n"), F.sum("v").over(r).alias("s"),
                       F.lag("v", 1).over(w).alias("l1"), F.lag("id", 3).over(w).alias("l3"),
                       F.last("v", True).over(r).alias("lv"))


def test_ordered_scan(rows, hot):
    out = H.ordered_scan(rows, ["g"], [("t", True), ("id", True)], sums={"n": F.lit(1), "s": F.col("v")},
                         lags={"l1": ("v", 1), "l3": ("id", 3)}, lasts={"lv": "v"})
    assert out.count() == 600
    got = {r.id: r for r in out.collect()}
    for want in _plain(rows).collect():
        r = got[want.id]
        assert (r.n, r.l1, r.l3, r.lv) == (want.n, want.l1, want.l3, want.lv)
        assert (r.s is None) == (want.s is None)
        assert (r.s or 0.0) == pytest.approx(want.s or 0.0)


def test_hot_groups_use_several_slices(rows, hot):
    scanned = H.split_hot(rows, ["g"])[1]
    assert {r.g for r in scanned.select("g").distinct().collect()} == {None, "a", "b"}


def test_ranks(rows, hot):
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    want = {r.id: r.r for r in rows.withColumn("r", F.rank().over(w)).collect()}
    got = {r.id: r.r for r in H.competition_ranks(rows, ["g"], "v", "r").collect()}
    assert got == want


@pytest.mark.parametrize("limit", ["5", "1000000"])
def test_percentiles(spark, rows, hot, limit):
    spark.conf.set(H.HOT_ROWS_CONF, limit)
    probs = {"p5": 0.05, "p50": 0.5, "p100": 1.0}
    got = {r.g: r for r in H.exact_percentiles(rows, ["g"], "v", probs).collect()}
    by = {}
    for r in rows.collect():
        if r.v is not None:
            by.setdefault(r.g, []).append(r.v)
    assert set(got) == set(by)
    for g, values in by.items():
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(np.percentile(values, p * 100), abs=1e-12)


def test_global_positions(spark):
    ids = spark.range(500).withColumnRenamed("id", "k")
    pos = [r.position for r in H.global_positions(ids.union(ids), "k", "s").collect()]
    assert sorted(pos) == list(range(500))
    again = {r.k: r.position for r in H.global_positions(ids.repartition(7), "k", "s").collect()}
    assert again == {r.k: r.position for r in H.global_positions(ids, "k", "s").collect()}


def test_keep_latest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (2, "c", 1)], "k int, v string, o int")
    got = {(r.k, r.v) for r in H.keep_latest(df, ["k"], [F.col("o")]).collect()}
    assert got == {(1, None), (2, "c")}
