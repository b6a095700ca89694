"""WARC archives with a two-level capture index.

Pages become gzip members of WARC files.  The index holds a line for each
capture, sorted by reversed host and path and cut into compressed blocks; a
sparse directory holds the first line of each block.  A lookup searches the
directory, reads the one block, searches that, and then reads the records'
bytes alone.  Files lie below one root that driver and executors share, and
are opened by its URI.

A task names its files by chance and reports them in rows that are written as
a table; files of lost or repeated tasks are in no row and are never read.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import fold, materialize, table
from slabspark.session import scratch_root

#: Equal payloads from this many bytes on are kept once.
LEAST = 100
#: Groups of equal payloads that are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 200_000
#: Bytes after which a task begins another archive, lines of a block, and capture date where the pages have none.
ARCHIVE, LINES, DATE = 1 << 30, 512, "1970-01-01T00:00:00Z"
#: Ranges of a file with gaps up to this size are read at once, up to so many bytes (one record at least); bytes of a task.
GAP, READ, TASK = 64 << 10, 8 << 20, 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page string, file string, offset bigint, length bigint"
_RECORD = "page string, url string, record_type string, refers string, payload_digest string, payload_bytes bigint"


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, path and query: ``com,example,www)/a?b``; empty for null or without ``://``.

    Blanks and control characters count as ``+``, fragments don't count.
    """
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = fold(F.regexp_extract(rest, "^[^/?#]*", 0))
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    key = F.concat(reversed_host, F.lit(")"), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))
    return F.coalesce(F.regexp_replace(key, r"[\x00-\x20\x7f]", "+"), F.lit(""))


# ------------------------------------------------------------ records


def record(page: str, url: str | None, kind: str, refers: str | None, digest: str, size: int, payload: bytes, date: str = DATE) -> bytes:
    """A WARC/1.1 record of a page; a revisit holds the response's head without its payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


def parsed(raw: bytes) -> tuple[str, str | None, str, str | None, str, int, bytes | None]:
    """(page, url, type, refers, digest, payload bytes, payload) of a record; the payload of a revisit is None.

    A record that is cut short or whose payload doesn't have its digest is an error.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(fields["content-length"])
    if not head.startswith(b"WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
    urn = lambda name: fields[name][len("<urn:page:") : -1] if name in fields else None
    length = int(_fields(http)["content-length"])
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    return urn("warc-record-id"), fields.get("warc-target-uri"), kind, urn("warc-refers-to"), digest, length, payload if kind == "response" else None


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _column(values, kind: str) -> pa.Array:
    return pa.array(values, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[part.split(" ") for part in schema.split(", ")])
    return pa.RecordBatch.from_arrays([_column(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], list(names))


# ------------------------------------------------------------ writing


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(key, page, url, record_type, refers, digest, size, payload) of every row, ready to be written.

    Of rows with equal payloads of ``least`` bytes or more, those with the
    smallest id are responses and the others revisit it; rows that repeat that
    id are responses as well, and so are all rows of a group without any id.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})
    groups = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1 and first is not null").select("digest", "first"), "equal-payloads")
    small = groups.count() <= broadcast_groups
    rows = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.url_encode(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(url_key(F.col("url")).alias("key"), name("id").alias("page"), "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, name("first")).alias("refers"), "digest", "size", "payload")


def write_archives(rows: DataFrame, root: str, most: int = ARCHIVE) -> DataFrame:
    """Write ``records`` as WARC files below ``root``; (key, page, file, offset, length) of each record.

    A file has a ``warcinfo`` record first and one gzip member for each record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                for row_at in range(0, batch.num_rows, 256):
                    done = []
                    for row in batch.slice(row_at, 256).to_pylist():
                        if stream is None or at >= most:
                            if stream is not None:
                                stream.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            stream = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                            info = b"format: WARC File Format 1.1\r\n"
                            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                            first = _gzip(head.encode() + info + b"\r\n\r\n")
                            stream.write(first)
                            at = len(first)
                        member = _gzip(record(row["page"], row["url"], row["record_type"], row["refers"], row["digest"], row["size"], row["payload"]))
                        stream.write(member)
                        done.append((row["key"], row["page"], name, at, len(member)))
                        at += len(member)
                    yield _batch(done, _CAPTURE)
        finally:
            if stream is not None:
                stream.close()

    return materialize(rows.mapInArrow(run, _CAPTURE), "captures")


_FILES = "file string, first_key string, first_page string, last_key string, last_page string, directory bigint, length bigint, lines bigint"


def write_index(captures: DataFrame, root: str, lines: int = LINES) -> DataFrame:
    """Write the index of ``captures`` below ``root``; one row for each of its files, with the place of the file's directory.

    Lines are sorted by key, page and place, so that a key with very many
    captures is spread over files too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.idx"
        stream, at, total = None, 0, 0
        block: list[str] = []
        directory: list[str] = []
        first = last = ("", "")

        def flush() -> None:
            nonlocal at, block
            packed = zlib.compress("".join(block).encode())
            key, page = block[0].split("\t", 2)[:2]
            directory.append(f"{key}\t{page}\t{at}\t{len(packed)}\n")
            stream.write(packed)
            at += len(packed)
            block = []

        try:
            for batch in batches:
                for key, page, file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                    if stream is None:
                        stream, first = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20), (key, page)
                    last, total = (key, page), total + 1
                    block.append(f"{key}\t{page}\t{file}\t{offset}\t{length}\n")
                    if len(block) == lines:
                        flush()
            if block:
                flush()
            if stream is not None:
                packed = zlib.compress("".join(directory).encode())
                stream.write(packed)
                yield _batch([(name, *first, *last, at, len(packed), total)], _FILES)
        finally:
            if stream is not None:
                stream.close()

    ordered = ("key", "page", "file", "offset")
    sorted_lines = captures.select(*_names(_CAPTURE)).repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    return materialize(sorted_lines.mapInArrow(run, _FILES), "capture-index")


def _names(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ")]


# ------------------------------------------------------------ reading


def _range(fs: FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def _lines(packed: bytes) -> list[list[str]]:
    return [line.split("\t") for line in zlib.decompress(packed).decode().split("\n")[:-1]]


def _place(key: str, page: str | None) -> tuple[bytes, bytes]:
    """Lines are in the order of their UTF-8 bytes, as Spark sorts them."""
    return key.encode("utf-8", "surrogatepass"), (page or "").encode("utf-8", "surrogatepass")


_WANTED = "key string, page string, file string, block bigint, length bigint"


def lookup(index: DataFrame, wanted: DataFrame, root: str) -> DataFrame:
    """(key, page, file, offset, length) of the captures that ``wanted`` (key, page) names, each once.

    A null page stands for all captures of the key.  Sorted keys are searched
    in the directories first, which gives blocks; blocks are dealt out by their
    place, read once by a task and searched.  The list of index files, one row
    for each task that wrote the index, is held by every task.
    """
    files = sorted((_place(r["first_key"], r["first_page"]), _place(r["last_key"], r["last_page"]), r["file"], r["directory"], r["length"]) for r in index.collect())  # one row a file
    lasts = [f[1] for f in files]

    def matches(found: tuple[bytes, bytes], key: bytes, page: bytes, whole: bool) -> bool:
        return found[0] == key and (whole or found[1] == page)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        held, starts, places = None, [], []
        for batch in batches:
            out = []
            for key, page in zip(*[c.to_pylist() for c in batch.columns]):
                at = _place(key, page)
                for first, _, name, offset, length in files[bisect.bisect_left(lasts, at) :]:
                    if first > at and not matches(first, *at, page is None):
                        break
                    if held != name:
                        places = _lines(_range(fs, f"{base}/{name}", offset, length))
                        held, starts = name, [_place(p[0], p[1]) for p in places]
                    for k in range(max(0, bisect.bisect_left(starts, at) - 1), len(starts)):
                        if starts[k] > at and not matches(starts[k], *at, page is None):
                            break
                        out.append((key, page, name, int(places[k][2]), int(places[k][3])))
                        if len(out) == 4096:
                            yield _batch(out, _WANTED)
                            out = []
            yield _batch(out, _WANTED)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        held, lines, keys = None, [], []
        for batch in batches:
            out = []
            for key, page, name, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if held != (name, offset):
                    lines = _lines(_range(fs, f"{base}/{name}", offset, length))
                    held, keys = (name, offset), [_place(x[0], x[1]) for x in lines]
                at = _place(key, page)
                k = bisect.bisect_left(keys, at)
                while k < len(keys) and matches(keys[k], *at, page is None):
                    out.append((*lines[k][:3], int(lines[k][3]), int(lines[k][4])))
                    k += 1
                if len(out) >= 4096:
                    yield _batch(out, _CAPTURE)
                    out = []
            yield _batch(out, _CAPTURE)

    wanted = wanted.select("key", "page").distinct().repartitionByRange("key", "page").sortWithinPartitions("key", "page")
    found = wanted.mapInArrow(blocks, _WANTED)
    found = found.repartitionByRange("file", "block", "key", "page").sortWithinPartitions("file", "block", "key", "page")
    return found.mapInArrow(search, _CAPTURE)


def read_records(captures: DataFrame, root: str, payload: bool = False, tasks: int | None = None) -> DataFrame:
    """(page, url, record_type, refers, payload_digest, payload_bytes) of captures, with ``payload`` also that (null for revisits).

    Captures are dealt out by their place, to ``tasks`` tasks (their rows are
    short and don't show how much there is to read); neighbours are read at
    once.  Payloads are held against their digests.
    """
    kind = _RECORD + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        name, stream = None, None
        try:
            for batch in batches:
                places = list(zip(*[c.to_pylist() for c in batch.columns]))
                start = 0
                while start < len(places):
                    file, offset, length = places[start]
                    end, stop = start + 1, offset + length
                    while end < len(places) and places[end][0] == file and places[end][1] - stop <= GAP and places[end][1] + places[end][2] - offset <= READ:
                        stop = places[end][1] + places[end][2]
                        end += 1
                    if name != file:
                        if stream is not None:
                            stream.close()
                        name, stream = file, fs.open_input_file(f"{base}/{file}")
                    raw = stream.read_at(stop - offset, offset)
                    out = []
                    for _, at, n in places[start:end]:
                        out.append(parsed(zlib.decompress(raw[at - offset : at - offset + n], 31))[: 7 if payload else 6])
                    yield _batch(out, kind)
                    start = end
        finally:
            if stream is not None:
                stream.close()

    placed = captures.select("file", "offset", "length").repartitionByRange(*([tasks] if tasks else []), "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, kind)


def with_payloads(read: DataFrame) -> DataFrame:
    """``read_records(payload=True)`` with the payloads of revisits, taken from the responses they name."""
    kept = read.filter("record_type = 'response'").select(F.col("page").alias("of"), F.col("payload_digest").alias("of_digest"), F.col("payload").alias("own"))
    kept = kept.dropDuplicates(["of", "of_digest"])
    met = read.join(kept, (F.col("refers") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    return met.select(*[c for c in read.columns if c != "payload"], F.coalesce("payload", "own").alias("payload"))


def archived(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, lines: int = LINES, payload: bool = False, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """Write ``pages`` to archives below ``root`` with their index, look every page up in it and read its record back.

    Null pages count as empty; a null URL has the empty key; repeated rows are
    records of their own; a null or empty id is read back as null.
    """
    spark = pages.sparkSession
    root = root or f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(records(pages, id_col, url_col, html_col, least, broadcast_groups), root)
    index = write_index(captures, root, lines)
    wanted = pages.select(url_key(F.col(url_col).cast("string")).alias("key"), F.url_encode(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("page"))
    size = captures.agg(F.sum("length")).first()[0] or 0
    return read_records(lookup(index, wanted, root), root, payload, 1 + size // TASK)


def op11_warc(spark, sf_dir) -> DataFrame:
    read = archived(table(spark, sf_dir, "pages"))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("bigint")
    return read.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))


OP11_SQL = f"""
WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
grouped AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM sized)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN size >= {LEAST} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= {LEAST} AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
"""
