"""Exact repeats of long word windows, found by fixed-block anchors.

Every document is cut into blocks of ``BLOCK`` words that don't overlap: the
index.  Rolling windows of ``BLOCK`` words probe it.  A repeat of ``WINDOW`` words holds, at some place,
a block of the one document and a probe of the other even if only each
``STRIDE``-th rolling window is probed, because the two steps have no common
divisor and their product fits into the repeat; so no repeat is missed.
Anchors that occur in two documents are extended word by word: all windows of
``WINDOW`` words over them are compared by a 128-bit hash, and neighbouring
repeated windows together are the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slabspark.llm.common import materialize, mix, table, words

WINDOW = 50
BLOCK = 8
STRIDE = 5
#: Up to so many documents, and ranges in them, are broadcast; more meet the texts in a shuffle.
BROADCAST_DOCS, BROADCAST_SPANS = 500_000, 2_000_000
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(t) for t in tokens], np.uint64)


def rolling(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive entries."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    if which:
        hashes = mix(hashes + np.uint64(which))
    base = np.uint64(_BASE[which])
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * base + hashes[i : i + n]
    return mix(out)


def _first_of_batch(parts: list[tuple[np.ndarray, np.ndarray, int, int, np.ndarray]], all_but_least: bool) -> pa.RecordBatch:
    """Rows of one batch, each hash sent on once: by the batch's smallest id that holds it.

    The others know already that they share it with another document.  Their
    key is scattered, and ``sure`` says that no answer is needed.
    """
    h = np.concatenate([p[0] for p in parts])
    g = np.concatenate([p[1] for p in parts])
    n = [len(p[0]) for p in parts]
    doc = np.repeat(np.array([p[2] for p in parts], np.int64), n)
    copy = np.repeat(np.array([p[3] for p in parts], np.int64), n)
    pos = np.concatenate([p[4] for p in parts])
    order = np.lexsort((doc, g, h))
    new = np.ones(len(h), bool)
    hs, gs, ds = h[order], g[order], doc[order]
    new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
    group = np.cumsum(new) - 1
    least = ds[new][group]
    most = ds[np.append(np.flatnonzero(new)[1:] - 1, len(ds) - 1)][group] if len(ds) else ds
    sure = np.empty(len(h), bool)
    sure[order] = ds > least if all_but_least else most > least
    sent = np.empty(len(h), bool)
    sent[order] = ds == least
    h = np.where(sent, h, mix(h + np.arange(len(h), dtype=np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), g.view(np.int64), sent, sure, doc, copy, pos.astype(np.int32))], ["h", "g", "sent", "sure", "doc", "copy", "pos"])


_ROWS = "h long, g long, sent boolean, sure boolean, doc long, copy long, pos int"


def _pieces(batch: pa.RecordBatch, extra: str | None):
    for a in range(0, batch.num_rows, 256):
        piece = batch.slice(a, 256)
        more = piece.column(extra).to_pylist() if extra else [None] * piece.num_rows
        yield from zip(piece.column("doc").to_pylist(), piece.column("copy").to_pylist(), piece.column("text").to_pylist(), more)


def _anchors(window: int, block: int, stride: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, copy, text, _ in _pieces(batch, None):
                tokens = words(text, lower=False)
                if len(tokens) < window:
                    continue
                h = rolling(word_hashes(tokens), block)
                pos = np.arange(len(h))
                pos = pos[(pos % block == 0) | (pos % stride == 0)]
                parts.append((h[pos], np.zeros(len(pos), np.uint64), doc, copy, pos))
            if parts:
                yield _first_of_batch(parts, False)

    return run


def _covered(spans: list[int], n: int, before: int, after: int) -> np.ndarray:
    """Which of ``n`` places lie in a range (first, last, first, last, ...) made longer on both sides."""
    ends = np.array(spans, np.int64).reshape(-1, 2)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(ends[:, 0] - before, 0, n), 1)
    np.add.at(change, np.clip(ends[:, 1] + after + 1, 0, n), -1)
    return np.cumsum(change)[:-1] > 0


def _ranges(gap: int):
    """Sorted places, joined to ranges if no further apart than ``gap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column("places"):
                at = np.sort(places.values.to_numpy())
                cut = np.flatnonzero(np.diff(at) > gap)
                out.append(np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("copy"), pa.array(out, pa.list_(pa.int32()))], ["doc", "copy", "spans"])

    return run


def _windows(window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, copy, text, spans in _pieces(batch, "spans"):
                h = word_hashes(words(text, lower=False))
                near = _covered(spans, len(h), window - block, 0)
                pos = np.flatnonzero(near[: max(0, len(h) - window + 1)])
                parts.append((rolling(h, window)[pos], rolling(h, window, 1)[pos], doc, copy, pos))
            if parts:
                yield _first_of_batch(parts, True)

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, copy, text, spans in _pieces(batch, "spans"):
                tokens = words(text, lower=False)
                gone = _covered(spans, len(tokens), 0, window - 1)
                left = [t for t, g in zip(tokens, gone.tolist()) if not g]
                for column, value in zip(out, (doc, copy, len(tokens) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc", "copy", "n_removed", "kept"])

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], []]
        for _, _, text, _ in _pieces(batch, None):
            tokens = words(text, lower=False)
            out[0].append(len(tokens))
            out[1].append(hashlib.sha256(b" ".join(tokens)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("copy"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["doc", "copy", "n_words", "whole"])


def _with_spans(texts: DataFrame, places: DataFrame, gap: int) -> DataFrame:
    """Texts of the documents that have places (doc, copy, pos), with these as ranges in one array."""
    places = places.groupBy("doc", "copy").agg(F.collect_set("pos").alias("places"))
    spans = materialize(places.mapInArrow(_ranges(gap), "doc long, copy long, spans array<int>"), "spans")
    size = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    spans = F.broadcast(spans) if size[0] <= BROADCAST_DOCS and size[1] <= BROADCAST_SPANS else spans
    return texts.join(spans, ["doc", "copy"]).select("doc", "copy", "text", "spans")


def without_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, stride: int = STRIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    Removed is each word covered by a window of ``window`` words that also
    starts in a document with a smaller id.  Null texts have no words.  Rows
    of one id don't remove each other's words; a row without an id neither
    loses words nor takes any.
    """
    if np.gcd(block, stride) != 1 or block * stride > window - block + 1:
        raise ValueError("block and stride would miss repeats")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("copy"), F.col(text_col).cast("string").alias("text"))
    narrow = materialize(texts.mapInArrow(_whole, "doc long, copy long, n_words long, whole string"), "words")
    # Of equal texts only the one of the smallest id is looked at; the others lose everything.
    first = narrow.filter(F.col("n_words") >= window).groupBy("whole").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("whole", "first")
    again = narrow.join(first, "whole").filter("doc > first").select("doc", "copy").distinct()
    again = materialize(again, "equal-texts")
    few = F.broadcast(again) if again.count() <= BROADCAST_DOCS else again
    fresh = texts.filter("doc is not null").join(few, ["doc", "copy"], "left_anti")
    by = Window.partitionBy("h", "g")
    own = F.when(F.col("sent"), F.col("doc"))
    anchors = fresh.mapInArrow(_anchors(window, block, stride), _ROWS)
    anchors = anchors.withColumn("low", F.min(own).over(by)).withColumn("high", F.max(own).over(by)).filter("sure or low < high")
    found = _with_spans(fresh, anchors.select("doc", "copy", "pos"), window - block + 1).mapInArrow(_windows(window, block), _ROWS)
    repeats = found.withColumn("low", F.min(own).over(by)).filter("sure or doc > low")
    kept = _with_spans(fresh, repeats.select("doc", "copy", "pos"), 1).mapInArrow(_kept(window), "doc long, copy long, n_removed long, kept string").distinct()
    gone = again.select("doc", "copy", F.lit(None).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept"))
    out = narrow.join(kept.union(gone), ["doc", "copy"], "left")
    removed = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", "n_words")).cast("long")
    return out.select(F.col("doc").alias("doc_id"), "n_words", removed.alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def op6_substring_dedup(spark, sf_dir) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
