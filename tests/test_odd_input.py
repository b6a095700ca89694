"""Input that must not end a job, and answers that must not depend on size."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from slabspark.functions.hashes import sign_signature
from slabspark.operators import grading, normalize
from slabspark.operators.hot import ordered_scan
from slabspark.operators.sampling import seeded
from slabspark.sources.store import TableStore

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_running_sums_of_nulls_in_hot_groups(spark, hot):
    df = spark.createDataFrame([("g", i, None if i < 15 or i % 2 else 10.0) for i in range(80)], "g string, i int, v double")
    got = ordered_scan(df, ["g"], [("i", True)], sums={"s": F.col("v")}).orderBy("i").collect()
    seen, want = None, []
    for i in range(80):
        seen = seen if i < 15 or i % 2 else (seen or 0) + 10.0
        want.append(seen)
    assert [r["s"] for r in got] == want


def test_side_without_length(spark):
    sides = spark.createDataFrame([("a", 3, 10), ("a", 0, 0)], "k string, anomaly_count int, length int")
    assert grading.edge_face(sides, ["k"]).first()["fraction"] == pytest.approx(0.3)


def test_deep_documents(spark):
    deep = '{"a":' * 20000 + '"x"' + "}" * 20000
    df = spark.createDataFrame([(deep,), ('{"b": ["x", {"C": "y"}], "d": 1}',), (None,), ("{",)], "doc string")
    got = [r[0] for r in df.select(normalize.json_text_leaves("doc")).collect()]
    assert [tuple(x) for x in got[1]] == [(".b[0]", "x"), (".b[1].c", "y")]
    assert [len(x) for x in got[2:]] == [0, 0] and len(got[0]) <= 1


def test_signatures_of_long_vectors_are_refused(spark):
    df = spark.createDataFrame([([1.0] * 65,)], "v array<double>")
    with pytest.raises(Exception, match="64 components"):
        df.select(sign_signature(F.col("v"))).collect()


def test_seeded_values_reach_far(spark):
    assert spark.range(200).select(F.max(seeded("s", F.col("id"))).alias("m")).first()["m"] > 1 << 55


def test_partition_upserts_of_repeated_keys(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, 1, 5), (1, 1, 7), (2, 1, 1)], "day int, k int, v int")
    with pytest.raises(ValueError, match="comes twice"):
        store.upsert_partitions("t", rows, ["day", "k"], rows.schema, ["day"])
    for _ in range(2):
        store.upsert_partitions("t", rows, ["day", "k"], rows.schema, ["day"], order=[F.col("v")])
        assert sorted(tuple(r) for r in store.read("t", rows.schema).select("day", "k", "v").collect()) == [(1, 1, 7), (2, 1, 1)]


def test_queries_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["cert_images"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
