"""Fill-in-the-middle against a plain version and an exact round trip."""

import hashlib
import random

import pytest

from slabspark.llm import middle


def plain(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    letters = "abc <PSM>\n\tÄß漢字😀é"
    out = [None, "", " ", "<P>", "<", "x<M>y", "<P", "S>", "<S" * 40, "漢", "\u0000", "a" * 30000, "😀" * 9000, "".join(rng.choice(letters) for _ in range(150_000))]
    # marks that lie over any border of chunks
    out += ["y" * (middle.LONGEST - k) + "<M>" + "z" * 50 for k in range(-1, 5)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return out


def test_against_plain_version_and_back(spark):
    from pyspark.sql import functions as F

    rows = list(enumerate(texts()))
    rows += [(None, "no id here"), (None, None), (3, "the same id"), (3, "the same id"), (7, rows[13][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("raw", "h0", "n", "form", "output", "prefix_chars"):
        df = df.withColumn(name, F.lit("x"))
    out = middle.filled_in(df)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((plain(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert middle.filled_in(df).collect() == []


def test_chunks_follow_content():
    rng = random.Random(1)
    shared = bytes(rng.randrange(256) for _ in range(20_000))
    one, other = (bytes(rng.randrange(256) for _ in range(n)) + shared for n in (1000, 1717))
    a, b = middle.chunks(one), middle.chunks(other)
    assert b"".join(a) == one and b"".join(b) == other
    assert sum(map(len, set(a) & set(b))) > 0.9 * len(shared)
    assert 256 < len(one) / len(a) < 1024
    memory = middle.Summaries()
    middle.Counted(one, memory)
    made = memory.made
    middle.Counted(other, memory)
    assert memory.made - made < 10


@pytest.mark.parametrize("block", [100, 4096])
def test_blocks_change_nothing(block, monkeypatch):
    raw = random.Random(2).randbytes(50_000)
    want = middle.cut_places(raw)
    plain_cuts = []
    for end in range(middle.WINDOW, len(raw)):
        h = 0
        for byte in raw[end - middle.WINDOW : end]:
            h = (h * 2 + int(middle._GEAR[byte])) % 2**32
        if h >> 23 == 0:
            plain_cuts.append(end)
    assert want == plain_cuts
    monkeypatch.setattr(middle, "BLOCK", block)
    assert middle.cut_places(raw) == want


def test_memory_is_bounded():
    memory = middle.Summaries(most=20_000)
    rng = random.Random(3)
    for _ in range(1000):
        memory.of(rng.randbytes(500))
    assert sum(map(len, (*memory.young, *memory.old))) <= 40_000


def test_query_against_sql(spark):
    from tests.oracle import connect, rows_of_spark, rows_of_sql

    sf = "/root/testdata/sf0.01"
    assert rows_of_spark(middle.op12_fill_in_middle(spark, sf)) == rows_of_sql(connect(sf), middle.OP12_SQL)
