"""Snapshots, conflicts, vacuum, exactly-once commits and the key ledger."""

import os

import pytest
from pyspark.sql import functions as F

from slabspark.sources.ledger import KeyLedger
from slabspark.sources.store import BUCKET, TableStore, WriteConflict
from slabspark.streaming import jobs as J

KV = "k long, v string"


@pytest.fixture()
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "lake"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, items):
    return spark.createDataFrame(items, KV)


def test_versions_stay_readable(spark, store):
    schema = frame(spark, []).schema
    states = []
    for n in range(4):
        store.upsert_buckets("t", frame(spark, [(k, f"{n}") for k in range(n * 3, n * 3 + 5)]), ["k"], schema, buckets=8)
        states.append({k: f"{m}" for m in range(n + 1) for k in range(m * 3, m * 3 + 5)})
    assert store.versions("t") == [1, 2, 3, 4]
    for version, state in enumerate(states, 1):
        assert dict(rows(store.read("t", schema, version))) == state
    assert store.read("nothing", schema).collect() == []


def test_a_reader_keeps_its_version(spark, store):
    schema = frame(spark, []).schema
    store.upsert_buckets("t", frame(spark, [(k, "old") for k in range(50)]), ["k"], schema)
    before = store.read("t", schema)
    store.upsert_buckets("t", frame(spark, [(k, "new") for k in range(100)]), ["k"], schema)
    assert rows(before) == [(k, "old") for k in sorted(range(50), key=lambda k: repr((k, "old")))]
    assert store.read("t", schema).where("v = 'new'").count() == 100


def test_only_touched_buckets_are_written(spark, store):
    schema = frame(spark, []).schema
    store.upsert_buckets("t", frame(spark, [(k, "a") for k in range(2000)]), ["k"], schema, buckets=100)
    old = set(store.manifest("t").files)
    assert len({os.path.dirname(f) for f in old}) == 100 == len(old)
    assert store.upsert_buckets("t", frame(spark, [(7, "b")]), ["k"], schema) == 1
    new = set(store.manifest("t").files)
    assert len(old - new) == len(new - old) == 1
    assert rows(store.read("t", schema).where("k in (7, 8)")) == [(7, "b"), (8, "a")]
    with pytest.raises(ValueError):
        store.append("t", frame(spark, [(1, "x")]))
    with pytest.raises(ValueError, match="bucketed"):
        store.upsert_buckets("t", frame(spark, [(1, "x")]), ["v"], schema)
    assert store.upsert_buckets("t", frame(spark, []), ["k"], schema) == 0
    assert store.read("t", schema).count() == 2000


def test_rows_may_be_removed(spark, store):
    schema = frame(spark, []).schema
    store.upsert_buckets("t", frame(spark, [(k, "a") for k in range(20)]), ["k"], schema, buckets=4)
    touched = frame(spark, [(k, "") for k in range(20)])
    store.rewrite("t", touched, ["k"], schema, lambda now: now.where("k > 17"))
    assert rows(store.read("t", schema)) == [(18, "a"), (19, "a")]
    store.rewrite("t", touched, ["k"], schema, lambda now: now.where("false"))
    assert rows(store.read("t", schema)) == []


class Meanwhile(TableStore):
    """A store in which something happens between the writing of files and their publication."""

    def __init__(self, spark, root, act):
        super().__init__(spark, root)
        self.act = act

    def _commit(self, *args, **kwargs):
        act, self.act = self.act, None
        if act:
            act()
        return super()._commit(*args, **kwargs)


@pytest.mark.parametrize("change", ["upsert_buckets", "replace", "upsert"])
def test_of_two_writers_one_fails(spark, store, change):
    schema = frame(spark, []).schema
    write = {"upsert_buckets": lambda s, r: s.upsert_buckets("t", r, ["k"], schema, buckets=2), "replace": lambda s, r: s.replace("t", r),
             "upsert": lambda s, r: s.upsert("t", r, ["k"], schema)}[change]
    write(store, frame(spark, [(1, "a"), (2, "a"), (3, "a")]))
    other = Meanwhile(spark, store.root, lambda: write(store, frame(spark, [(1, "first"), (2, "first"), (3, "first")])))
    with pytest.raises(WriteConflict, match="another writer"):
        write(other, frame(spark, [(1, "second"), (2, "second"), (3, "second")]))
    assert {r.v for r in store.read("t", schema).collect()} == {"first"}


def test_writers_of_other_rows_both_succeed(spark, store):
    schema = frame(spark, []).schema
    number = lambda k: spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(50))).first()[0]
    a, b = 1, next(k for k in range(2, 99) if number(k) != number(1))
    store.upsert_buckets("t", frame(spark, [(a, "x"), (b, "x")]), ["k"], schema, buckets=50)
    other = Meanwhile(spark, store.root, lambda: store.upsert_buckets("t", frame(spark, [(a, "a")]), ["k"], schema))
    other.upsert_buckets("t", frame(spark, [(b, "b")]), ["k"], schema)
    assert rows(store.read("t", schema)) == [(a, "a"), (b, "b")]
    plain = Meanwhile(spark, store.root, lambda: store.append("u", frame(spark, [(1, "one")])))
    plain.append("u", frame(spark, [(2, "two")]))
    assert rows(store.read("u", schema)) == [(1, "one"), (2, "two")]


def test_publishing_a_taken_number_fails(spark, store):
    store.append("t", frame(spark, [(1, "a")]))
    text = store.manifest("t").text()
    with pytest.raises(WriteConflict):
        store._publish("t", 1, "other")
    assert store.manifest("t").text() == text


def test_vacuum(spark, store, tmp_path):
    schema = frame(spark, []).schema
    for n in range(5):
        store.upsert_buckets("t", frame(spark, [(k, f"{n}") for k in range(40)]), ["k"], schema, buckets=4)
    folder = tmp_path / "lake/t/v1/_bucket=0"
    stray = folder / "part-stray.parquet"
    stray.write_bytes(b"x")
    assert store.vacuum("t", keep=2) == 12 and store.versions("t") == [4, 5]
    assert {r.v for r in store.read("t", schema, 4).collect()} == {"3"} and store.read("t", schema).count() == 40
    assert stray.exists()
    os.utime(stray, (0, 0))
    assert store.vacuum("t", keep=2) == 1 and not stray.exists()
    assert store.vacuum("t", keep=1) == 4 and store.read("t", schema).count() == 40
    with pytest.raises(ValueError):
        store.vacuum("t", keep=0)


def test_compaction(spark, store):
    schema = frame(spark, []).schema
    for n in range(6):
        store.append("t", frame(spark, [(n, "x")]), epoch=("s", n))
    store.compact("t", schema)
    assert len(store.manifest("t").files) == 1 and store.committed("t", "s") == 5
    assert rows(store.read("t", schema)) == [(n, "x") for n in range(6)]


def test_epochs_count_once(spark, store):
    schema = frame(spark, []).schema
    for n in (0, 0, 1, 0, 1, 2):
        store.append("t", frame(spark, [(n, "x")]), epoch=("s", n))
    store.append("t", frame(spark, [(0, "y")]), epoch=("another", 0))
    store.replace("t", store.read("t", schema).unionByName(frame(spark, [(9, "z")])), epoch=("s", 3))
    store.replace("t", frame(spark, []), epoch=("s", 3))
    assert rows(store.read("t", schema)) == [(0, "x"), (0, "y"), (1, "x"), (2, "x"), (9, "z")]


# ------------------------------------------------------------ ledger and ingestion


def test_ledger_against_sets(spark, store):
    schema = spark.createDataFrame([], "a string, b long, v string").schema
    ledger = KeyLedger(store, "t", ["a", "b"], schema, buckets=4, pages=2)
    seen: set = set()
    for n in range(6):
        keys = {(None if k % 11 == 0 else f"s{k % 7}", None if k % 13 == 0 else k) for k in range(n * 400, n * 400 + 600)}
        batch = spark.createDataFrame([(*k, "v") for k in keys] * 2, schema)
        new = ledger.unseen(batch)
        got = {tuple(r) for r in new.collect()}
        assert got == keys - seen
        ledger.add(new)
        seen |= keys
    assert ledger._filters()[1] > 2  # pages were added on the way
    assert {tuple(r) for r in store.read(ledger.names, ledger.schema).collect()} == seen


def test_new_keys_open_no_bucket(spark, store):
    schema = frame(spark, []).schema
    ledger = KeyLedger(store, "t", ["k"], schema, buckets=16)
    opened = []
    known = ledger._known
    ledger._known = lambda numbers: opened.append(len(numbers)) or known(numbers)
    for n in range(5):
        batch = spark.range(n * 500, n * 500 + 500).select(F.col("id").alias("k"), F.lit("v").alias("v"))
        fresh = ledger.unseen(batch)
        assert fresh.count() == 500
        ledger.add(fresh)
    assert opened == [0] * 5
    assert ledger.unseen(spark.createDataFrame([(3, "")], schema)).count() == 0 and opened[-1] == 1


class Lost(Exception):
    pass


@pytest.mark.parametrize("step", range(8))
def test_ingestion_survives_a_lost_writer(spark, tmp_path, store, step):
    """The writer is lost before its n-th publication; the repeated run ends as one run would."""
    schema = frame(spark, []).schema
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    for items in ([(1, "a"), (1, "a"), (2, "b")], [(2, "z"), (3, "c")], [(4, "d"), (1, "q")]):
        frame(spark, items).coalesce(1).write.mode("append").parquet(src)
    left = [step]
    publish = store._publish

    def losing(*args):
        left[0] -= 1
        if left[0] == -1:
            raise Lost
        return publish(*args)

    store._publish = losing
    for _ in range(3):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        try:
            J.run_available(stream.writeStream.foreachBatch(J.ingest_new(store, "t", ["k"], schema)), ck)
        except Exception as error:  # noqa: BLE001
            assert "Lost" in str(error)
    got = rows(store.read("t", schema))
    assert [k for k, _ in got] == [1, 2, 3, 4]
    assert rows(store.read("t__keys", frame(spark, []).drop("v").schema)) == [(1,), (2,), (3,), (4,)]
    J.ingest_new(store, "t", ["k"], schema)(frame(spark, [(4, "x"), (5, "e")]), 0)
    assert [k for k, _ in rows(store.read("t", schema))] == [1, 2, 3, 4, 5]


def test_a_batch_is_upserted_once(spark, tmp_path, store):
    schema = spark.createDataFrame([], "day int, k int, v int").schema
    write = J.upsert_batches(store, "t", ["day", "k"], schema, ["day"], [F.col("v")])
    first = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], schema)
    write(first, 0)
    write(spark.createDataFrame([(1, 1, 4)], schema), 1)
    write(first, 0)
    assert rows(store.read("t", schema)) == [(1, 1, 4), (2, 1, 6)]


def test_bucket_column_stays_inside(spark, store):
    schema = frame(spark, []).schema
    store.upsert_buckets("t", frame(spark, [(1, "a")]), ["k"], schema)
    assert BUCKET not in store.read("t", schema).columns
