"""JSON arrays read in byte ranges, cut at every place."""

import json
import random

import pytest

from slabspark.sources.json_array import array_objects

HARD = ['}', '{"a":1}', '\\', '"', '\\"}', '[{', ']}', '😀}{', 'ä"}', 'x\ny', '', '\\\\', ',']


def dump(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(HARD) for _ in range(rng.randrange(6)))
    thing = lambda d: rng.choice([text(), rng.randrange(99), None, True, [text(), {"k": text()}], {"k": text(), "}": {}} if d else {}])
    out = [{"id": i, text(): thing(1), "deep": {"a": [{"b": thing(0)}]}} for i in range(n)]
    for other in (5, "text}", None, [1, {"id": -1}], [[{"id": -2}], text()], [], True):
        out.insert(rng.randrange(len(out)), other)
    return out


def key(objects):
    return sorted(json.dumps(o, sort_keys=True) for o in objects)


def read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        return [json.loads(r["entry"]) for r in array_objects(spark, str(path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size,indent,ascii_only", [(64, None, True), (301, None, False), (97, 1, False), (1 << 20, None, True)])
def test_elements_of_every_layout(spark, tmp_path, size, indent, ascii_only):
    items = dump(size, 60)
    (tmp_path / "a.json").write_text(" \n" + json.dumps(items, indent=indent, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(dump(7, 9)))
    (tmp_path / "c.json").write_text(json.dumps({"data": items}))  # no array at its top
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text(json.dumps([{"id": 1, "long": "}" * 700}, [[0, {"id": -3}] * 80], {"id": 2}]))
    want = [o for o in items + dump(7, 9) if isinstance(o, dict)] + [{"id": 1, "long": "}" * 700}, {"id": 2}]
    assert key(read(spark, tmp_path, size)) == key(want)


def test_a_large_line_takes_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "name": "n" * 50} for i in range(20_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        objects = array_objects(spark, str(tmp_path))
        assert objects.count() == 20_000 and objects.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
