"""WARC archives and their index against a plain version."""

import gzip
import hashlib
import random
import zlib

import pytest

from slabspark.llm import warc

PAGES = "page_id long, url string, html string"


def page_rows():
    rng = random.Random(4)
    big, other = "<p>" + "copied " * 40, "<p>" + "漢字 " * 60
    rows = [(i, f"https://Host{i % 7}.Example.org/{i % 5}/x?q={i}", f"<html>{rng.random()}{'y' * rng.randrange(400)}</html>") for i in range(300)]
    rows += [(1000 + i, "http://www.example.org/same", big) for i in range(150)]  # one hot address, one hot payload
    rows += [(900, "http://a.b/c", other), (899, None, other), (899, None, other), (None, "http://n.o/", other), (None, None, None), (None, "x", "small")]
    rows += [(2000, "no scheme", ""), (2001, "http://a b.c/ d\r\nX: y\t/", None), (2002, "", "short"), (2003, "http://q/?a", "short"), (2004, "ftp://é.org/漢?x#f", "z" * 200_000), (2005, None, "\r\n\r\nWARC/1.1\r\n" * 30)]
    return rows


def plain(rows, least=100):
    first, out = {}, []
    for i, _, html in rows:
        if i is not None:
            h = html or ""
            first[h] = min(first.get(h, i), i)
    for i, _, html in rows:
        raw = (html or "").encode()
        f = first.get(html or "")
        revisit = len(raw) >= least and f is not None and i != f
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, PAGES)
    for name in ("key", "page", "file", "digest", "first", "payload", "size"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def ids(df):
    return sorted((tuple(r) for r in df.selectExpr("bigint(nullif(page, ''))", "payload_bytes", "payload_digest", "record_type", "bigint(refers)").collect()), key=repr)


@pytest.mark.parametrize("groups", [1000, 0])
def test_written_and_read_back(spark, tmp_path, groups):
    rows = page_rows()
    assert ids(warc.archived(frame(spark, rows).repartition(5), str(tmp_path), lines=4, broadcast_groups=groups)) == plain(rows)


def test_archives_are_plain_warc(spark, tmp_path):
    rows = page_rows()
    captures = warc.write_archives(warc.records(frame(spark, rows)), str(tmp_path), most=4000)
    files = sorted(tmp_path.glob("*.warc.gz"))
    assert len(files) > 3
    n = 0
    for file in files:
        raw = gzip.decompress(file.read_bytes())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert rest[size : size + 4] == b"\r\n\r\n"
            raw = rest[size + 4 :]
            n += 1
    assert n == len(rows) + len(files)
    assert captures.count() == len(rows)


def test_lookup_reads_single_addresses(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = page_rows()
    root = str(tmp_path)
    index = warc.write_index(warc.write_archives(warc.records(frame(spark, rows)), root), root, lines=3)
    urls = ["http://www.EXAMPLE.org/same", "https://host3.example.org/3/x?q=3", "http://not.there/", "ftp://é.org/漢?x"]
    wanted = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("key"), F.lit(None).cast("string").alias("page"))
    found = warc.lookup(index, wanted, root)
    got = warc.with_payloads(warc.read_records(found, root, payload=True)).collect()
    want = {i: h for i, u, h in rows if u and any(u.split("#")[0].lower() == x.lower() for x in urls)}
    assert {int(r["page"]): r["payload"].decode() for r in got} == want and len(got) == len(want)
    assert warc.lookup(index, wanted.limit(0), root).collect() == []


def test_keys(spark):
    from pyspark.sql import functions as F

    urls = {"http://WWW.Example.com/a/B?c=d#e": "com,example,www)/a/B?c=d", "https://x": "x)", None: "", "mailto:x": "", "http://a.b/ c\n": "b,a)/+c+"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in df.select("url", warc.url_key(F.col("url"))).collect()} == urls


def test_damage_is_an_error():
    raw = warc.record("1", "http://a/", "response", None, hashlib.sha256(b"abc").hexdigest(), 3, b"abc")
    assert warc.parsed(raw)[-1] == b"abc"
    for broken in (raw.replace(b"abc", b"abd"), raw[:-1]):
        with pytest.raises(ValueError):
            warc.parsed(broken)
    with pytest.raises(zlib.error):
        zlib.decompress(warc._gzip(raw)[:-9], 31)


def test_no_pages(spark, tmp_path):
    assert warc.archived(frame(spark, []), str(tmp_path)).collect() == []


def test_query_against_sql(spark, sf):
    from tests.oracle import connect, rows_of_spark, rows_of_sql

    assert rows_of_spark(warc.op11_warc(spark, sf)) == rows_of_sql(connect(sf), warc.OP11_SQL)
