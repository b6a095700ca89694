"""Fill-in-the-middle by content-defined chunks.

A rolling hash cuts texts into chunks at places that only the bytes before
them decide, so that passages which several texts share become equal chunks.
Each worker remembers a chunk's summary under the chunk itself: its code
points, its first and last bytes, and whether a mark occurs in it.  Summaries
of a text's chunks are combined into its length, its marks and the places of
its cuts; only the chunk a cut falls into is looked at again.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import mix, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Shares of 100: texts left plain, and texts of the rest whose suffix comes first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes that a rolling hash sees, bytes of a chunk on average, and at most.
WINDOW, AVERAGE, LONGEST = 32, 512, 4096
#: Bytes of chunks a worker remembers, twice this many at most; an entry counts as its bytes and ENTRY more.
REMEMBERED, ENTRY = 16 << 20, 300
#: Bytes that are hashed at once, and of texts that are turned into Python objects at once (one text at least).
BLOCK, PIECE = 1 << 20, 4 << 20
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_CONTINUED = bytes(range(0x80, 0xC0))


def cut_places(raw: bytes, window: int = WINDOW, average: int = AVERAGE) -> list[int]:
    """Ascending ends of chunks inside ``raw``: where the hash of the last ``window`` bytes has its low bits zero.

    ``window`` and ``average`` are powers of two.
    """
    found: list[np.ndarray] = []
    for start in range(0, max(0, len(raw) - window + 1), BLOCK):
        h = _GEAR[np.frombuffer(raw, np.uint8, min(BLOCK + window - 1, len(raw) - start), start)]
        width = 1
        while width < window:  # sums over twice as many bytes, older ones shifted on
            h = h[width:] + (h[:-width] << np.uint32(width))
            width *= 2
        # A byte leaves the hash after 32 shifts; its high bits know the whole window.
        found.append(np.flatnonzero(h >> np.uint32(32 - average.bit_length() + 1) == 0) + (start + window))
    return [int(p) for ps in found for p in ps if p < len(raw)]


def chunks(raw: bytes, longest: int = LONGEST) -> list[bytes]:
    """``raw`` in content-defined chunks; a stretch without a cut is divided every ``longest`` bytes."""
    out, at = [], 0
    for end in [*cut_places(raw), len(raw)]:
        while end - at > longest:
            out.append(raw[at : at + longest])
            at += longest
        if end > at:
            out.append(raw[at:end])
            at = end
    return out


class Summaries:
    """Summaries by content: (code points, first two bytes, last two bytes, whether a mark lies inside).

    A chunk is found by its own bytes, so that chunks of equal hash aren't taken for each other.
    """

    def __init__(self, most: int = REMEMBERED):
        self.most, self.size, self.made = most, 0, 0
        self.young: dict[bytes, tuple[int, bytes, bytes, bool]] = {}
        self.old: dict[bytes, tuple[int, bytes, bytes, bool]] = {}

    def of(self, chunk: bytes) -> tuple[int, bytes, bytes, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.made += 1
                points = len(chunk) if chunk.isascii() else len(chunk.translate(None, _CONTINUED))
                found = points, chunk[:2], chunk[-2:], any(m in chunk for m in MARKS)
            self.size += len(chunk) + ENTRY
            if self.size > self.most:
                self.old, self.young, self.size = self.young, {}, len(chunk) + ENTRY
            self.young[chunk] = found
        return found


class Counted:
    """A text as chunks with running counts."""

    def __init__(self, raw: bytes, memory: Summaries):
        self.raw, self.parts = raw, chunks(raw)
        found = [memory.of(c) for c in self.parts]
        self.points = list(accumulate((f[0] for f in found), initial=0))
        self.starts = list(accumulate((len(c) for c in self.parts), initial=0))
        self.n, self.marked, tail = self.points[-1], False, b""
        for _, first, last, inside in found:
            # A mark over a border lies in the two bytes before it and the two after it.
            self.marked = self.marked or inside or any(m in tail + first for m in MARKS)
            tail = (tail + last)[-2:]

    def place(self, point: int) -> int:
        """The byte where the code point of this number begins (the end, for the number of all)."""
        if point >= self.n:
            return len(self.raw)
        k = bisect.bisect_right(self.points, point) - 1
        chunk, rest = self.parts[k], point - self.points[k]
        if self.points[k + 1] - self.points[k] == len(chunk):
            return self.starts[k] + rest
        begins = np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80)
        return self.starts[k] + int(begins[rest])


def transform(raw: bytes, h: tuple[int, int, int, int], memory: Summaries) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and middle, output) of a text; ``h`` decides cuts and form."""
    text = Counted(raw, memory)
    if not text.n or text.marked or h[2] % 100 >= PLAIN_FROM:
        return text.n, "plain", None, None, raw
    a, b = sorted((h[0] % (text.n + 1), h[1] % (text.n + 1)))
    i, j = text.place(a), text.place(b)
    prefix, middle, suffix = raw[:i], raw[i:j], raw[j:]
    p, s, m = MARKS
    if h[3] % 100 < SPM_BELOW:
        return text.n, "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return text.n, "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def filled_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    Cuts and form follow from the SHA-256 of ``seed``:id, a null id counting as
    empty text.  A null text counts as empty; an empty text, one that holds a
    mark and a tenth of the others stay as they are (``plain``, lengths null).
    Rows that repeat an id are cut alike if their texts are.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k}") for k in range(4)]
    few = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"), *groups)
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Summaries()
        for batch in batches:
            sizes = (range(n) for n in pc.binary_length(batch.column("raw")).to_pylist())
            for start, end in slices(sizes, PIECE):
                piece = batch.slice(start, end - start)
                h = zip(*[piece.column(f"h{k}").to_pylist() for k in range(4)])
                made = [transform(raw, x, memory) for raw, x in zip(piece.column("raw").to_pylist(), h)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*made), kinds)]
                # The bytes are those of the text; they aren't checked or changed on the way.
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *arrays[:-1], arrays[-1].view(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return few.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    one, three = F.lit(1), F.lit(3)
    middle_at = F.instr(output, MIDDLE)

    def swapped(second: str) -> tuple[Column, Column, Column]:
        at = F.instr(output, second)
        return F.substring(output, three + one, at - three - one), F.substring(output, at + three, middle_at - at - three), F.substring(output, middle_at + three, F.length(output))

    prefix, suffix, middle = swapped(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = swapped(PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir) -> DataFrame:
    made = filled_in(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM hashed
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
