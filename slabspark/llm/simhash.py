"""Near duplicates by SimHash, compared bit-sliced.

Fingerprints of one block are stored as bit planes: one 64-bit word holds the
same bit of 64 fingerprints.  A fingerprint is compared with 64 others at once
by adding up differing planes in carry-save counters, and a word is abandoned
as soon as all of its lanes have passed the radius.

Only fingerprints that share a block key are compared.  ``band_keys`` gives keys
that miss no pair within a small radius; for wide fingerprints and a large
radius ``fingerprints`` adds keys of minimal shingles.  There the radius only
proposes: rows it brings together are tied by their shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import materialize, mix, slices, unused, words
from slabspark.llm.graph import components

SEED = 42
#: Rows of one block key that are compared in one piece; more are dealt out in pairs of pieces.
CROWD = 2048
#: Shingles of one block key that are compared in one piece (8 bytes each).
CROWD_SHINGLES = 2_000_000
#: A candidate pair may differ by so many standard deviations more than pairs at the similarity do on average: four for
#: chance, the rest because fingerprints of few shingles differ more (two texts that share 4 of 5 by 96 of 512 bits).
SPREAD = 7
#: Up to so many rows to drop are broadcast (16 bytes each, under 100 MB as a hash table); more meet the documents in a shuffle.
BROADCAST_ROWS = 1_000_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; of the whole sequence if it has fewer words."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    n = max(1, len(tokens) - size + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(size, len(tokens)) - 1 :].tolist())], np.uint64)


def _majorities(hashes: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    """(n, bits / 8) bytes: the fingerprint of each owner, highest bit first."""
    total = np.bincount(owner, minlength=n).astype(np.float32)
    out = np.empty((n, bits // 8), np.uint8)
    shifted = owner * 256
    for w in range(bits // 64):
        lane = hashes if w == 0 else mix(hashes + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        column = lane.astype(">u8").view(np.uint8).reshape(-1, 8)
        for b in range(8):
            counts = np.bincount(shifted + column[:, b], minlength=n * 256).reshape(n, 256)
            ones = counts.astype(np.float32) @ _BITS
            out[:, w * 8 + b] = np.packbits(ones * 2 > total[:, None], axis=1)[:, 0]
    return out


def _least_keys(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands): each a hash of ``rows`` minimal shingles; ``first`` is where each document's hashes begin."""
    keys = np.zeros((len(first), bands), np.uint64)
    for i in range(bands * rows):
        least = np.minimum.reduceat(mix(hashes ^ np.uint64((i + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)), first)
        keys[:, i // rows] = mix(keys[:, i // rows] * np.uint64(31) + least)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, size: int = 3, bits: int = 64, bands: int = 0, rows: int = 3, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """(id, copy, fp, keys, node, n) of every row: ``fp`` is ``bits`` / 8 bytes, highest bit first; ``keys`` holds ``bands`` block keys.

    Repeated shingles count each time, or once with ``sets``; ``node`` is then a
    hash of the set and ``n`` its size (else both are 0).

    ``copy`` is a hash of the text, which tells rows of one id apart.  Null, empty and blank texts have a fingerprint of zeros (and keys of zeros).
    Repeated rows are kept; other columns aren't looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 256):
                piece = batch.slice(c, 256)
                texts = piece.column("text").to_pylist()
                for a, b in slices(texts, 1_000_000):
                    part = [shingle_hashes(t, size) for t in texts[a:b]]
                    if sets:
                        part = [np.unique(h) for h in part]
                    n = np.array([len(h) for h in part])
                    hashes = np.concatenate(part)
                    fp = _majorities(hashes, np.repeat(np.arange(len(part)), n), len(part), bits)
                    keys = np.zeros((len(part), bands), np.int64)
                    if bands and len(hashes):
                        keys[n > 0] = _least_keys(hashes, (np.cumsum(n) - n)[n > 0], bands, rows)
                    rest = [pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))]
                    name = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in part], np.uint64).view(np.int64) if sets else np.zeros(len(part), np.int64)
                    rest += [pa.array(name), pa.array(n if sets else np.zeros(len(part), np.int64), pa.int64())]
                    own = piece.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([own.column("id"), own.column("copy"), *rest], ["id", "copy", "fp", "keys", "node", "n"])

    few = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, "id long, copy long, fp binary, keys array<long>, node long, n long")


def band_keys(fp: Column, radius: int) -> Column:
    """Keys of a 64-bit fingerprint: two within ``radius`` bits share at least one.

    The bits are cut into radius + 3 pieces, of which three at least are equal;
    each key is one choice of three pieces (position in the array says which).
    """
    cuts = [round(64 * i / (radius + 3)) for i in range(radius + 4)]
    number = F.conv(F.hex(fp), 16, -10).cast("long")
    masks = []
    for chosen in combinations(range(radius + 3), 3):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*[number.bitwiseAND(F.lit(m).cast("long")) for m in masks])


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(blocks, bits) words from (rows, bytes) fingerprints: bit j of word (b, k) is bit k of row 64 b + j."""
    rows, width = fps.shape
    blocks = -(-rows // 64)
    padded = np.zeros((blocks * 64, width), np.uint8)
    padded[:rows] = fps
    bits = np.unpackbits(padded, axis=1).reshape(blocks, 64, width * 8).transpose(0, 2, 1)
    return np.packbits(np.ascontiguousarray(bits), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def sliced_matches(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of tasks (a query row, a block, the lanes to look at): the tasks with lanes within the radius, and those lanes."""
    levels = max(1, radius.bit_length())
    task = np.arange(len(query))
    dead = ~lanes
    # Counters start so high that the carry out of the top one means "over the radius".
    start = (1 << levels) - 1 - radius
    counter = [np.full(len(query), ALL if start >> j & 1 else np.uint64(0)) for j in range(levels)]
    own = np.unpackbits(fps, axis=1)
    q = query
    width = planes.shape[1]
    for k in range(0, width, 2):
        x = planes[block, k] ^ np.where(own[q, k] == 1, ALL, np.uint64(0))
        y = planes[block, k + 1] ^ np.where(own[q, k + 1] == 1, ALL, np.uint64(0))
        # A full adder takes both planes and the lowest counter at once; only its carry moves on.
        half = x ^ y
        carry = (x & y) | (half & counter[0])
        counter[0] = half ^ counter[0]
        for j in range(1, levels):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        dead |= carry
        if k % 8 == 6 or k + 2 == width:
            alive = dead != ALL
            if not alive.all():
                task, dead, block, q = task[alive], dead[alive], block[alive], q[alive]
                counter = [c[alive] for c in counter]
                if not len(task):
                    break
    return task, ~dead


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of many pairs in place; every entry ends as its smallest reachable row."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]


def spanning_links(group: np.ndarray, fps: np.ndarray, radius: int, at_once: int = 32768) -> np.ndarray:
    """For rows sorted by ``group``: the smallest row each is tied to by steps within the radius in its group."""
    n = len(group)
    parent = np.arange(n)
    if n < 2:
        return parent
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([edge, [n]]))
    end = np.repeat(edge + size, size)
    row = np.flatnonzero(end > np.arange(n) + 1)
    first, last = (row + 1) // 64, (end[row] - 1) // 64
    many = last - first + 1
    planes = planes_of(fps)
    upto = np.cumsum(many)
    done = 0
    while done < len(row):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + at_once, "right")))
        m = many[done:stop]
        query = np.repeat(row[done:stop], m)
        block = np.repeat(first[done:stop], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        low = np.clip(query + 1 - block * 64, 0, 63).astype(np.uint64)
        high = np.clip(block * 64 + 64 - end[query], 0, 63).astype(np.uint64)
        task, lanes = sliced_matches(fps, planes, query, block, (ALL << low) & (ALL >> high), radius)
        if len(task):
            hit = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, lane = np.nonzero(hit)
            _merge(parent, query[task[t]], block[task[t]] * 64 + lane)
        done = stop
    return parent


def _by_group(columns: list[str], work):
    """Apply ``work`` to frames sorted by ``columns``, no group of which is cut."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for pdf in frames:
            pdf = pdf if carry is None else pd.concat([carry, pdf], ignore_index=True)
            same = (pdf[columns].to_numpy() == pdf[columns].iloc[-1].to_numpy()).all(axis=1) if len(pdf) else np.empty(0, bool)
            cut = len(pdf) - int(same.sum())
            yield work(pdf.iloc[:cut])
            carry = pdf.iloc[cut:]
        if carry is not None:
            yield work(carry)

    return run


GROUP = ["t", "key", "i", "j"]


def _tied(pdf: pd.DataFrame, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the groups of two and more, and the row each is tied to by steps within the radius in its group."""
    none = np.empty(0, np.int64)
    if len(pdf) < 2:
        return none, none
    parts = pdf[GROUP].to_numpy()
    new = np.concatenate([[True], (parts[1:] != parts[:-1]).any(axis=1)])
    group = np.cumsum(new)
    shared = np.bincount(group)[group] > 1
    if not shared.any():
        return none, none
    pdf, group = pdf[shared], group[shared]
    fps = np.frombuffer(b"".join(pdf["fp"]), np.uint8).reshape(len(pdf), -1)
    return pdf["node"].to_numpy(), spanning_links(group, fps, radius)


def _links(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    node, parent = _tied(pdf, radius)
    tied = np.flatnonzero(parent != np.arange(len(parent)))
    return pd.DataFrame({"u": node[tied], "v": node[parent[tied]]})


def _cells(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """(cell, node) of the nodes that are tied to others; a cell is named by its nodes, so that the same ones under other keys make no new cell."""
    node, parent = _tied(pdf, radius)
    member = np.bincount(parent, minlength=len(parent))[parent] > 1 if len(parent) else np.empty(0, bool)
    name = np.zeros(len(parent), np.uint64)
    np.add.at(name, parent, mix(node.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return pd.DataFrame({"cell": mix(name)[parent[member]].view(np.int64), "node": node[member]})


def similar_rows(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest row each row is tied to by steps between sets (no value twice) of this Jaccard similarity or more."""
    parent = np.arange(len(sets))
    size = np.array([len(x) for x in sets])
    seen, code = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    first = np.cumsum(size) - size
    held = np.zeros(len(seen), bool)
    for u in range(len(sets) - 1):
        after = parent[u + 1 :] != parent[u]
        after &= np.minimum(size[u], size[u + 1 :]) >= similarity * np.maximum(size[u], size[u + 1 :]) - 1e-9
        if not after.any():
            continue
        mine = code[first[u] : first[u] + size[u]]
        held[mine] = True
        upto = np.concatenate([[0], np.cumsum(held[code[first[u + 1] :]])])
        both = upto[first[u + 1 :] + size[u + 1 :] - first[u + 1]] - upto[first[u + 1 :] - first[u + 1]]
        held[mine] = False
        v = np.flatnonzero(after & (both >= similarity * (size[u] + size[u + 1 :] - both) - 1e-9)) + u + 1
        if len(v):
            _merge(parent, np.full(len(v), u), v)
    return parent


def _verified(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    cell, node, shingles = pdf["cell"].to_numpy(), pdf["node"].to_numpy(), pdf["shingles"].tolist()
    edge = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)] if len(cell) else []
    u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(edge, edge[1:]):
        parent = similar_rows([np.frombuffer(x, np.uint64) for x in shingles[a:b]], similarity)
        tied = np.flatnonzero(parent != np.arange(b - a))
        u.append(node[a:b][tied])
        v.append(node[a:b][parent[tied]])
    return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})


def _dealt(nodes: DataFrame, crowd: int, crowd_shingles: int) -> DataFrame:
    """Nodes under their keys, sorted.

    A key with more than ``crowd`` nodes (or more shingles than that, if nodes
    have their number ``n``) is dealt out: its nodes fall into pieces, and every
    pair of pieces meets in a task of its own, so that nothing is skipped and no
    task grows with the key.
    """
    rows = nodes.select("node", "fp", *[c for c in ("n",) if c in nodes.columns], F.posexplode("keys").alias("t", "key"))
    share = F.count("*") / crowd
    if "n" in nodes.columns:
        share = F.greatest(share, F.when(F.count("*") > 1, F.sum("n")).otherwise(F.lit(0)) / crowd_shingles)
    crowded = rows.groupBy("t", "key").agg(share.alias("share")).filter("share > 1")
    crowded = materialize(crowded.select("t", "key", F.ceil(F.col("share") * 2).cast("int").alias("pieces")), "crowded-keys")
    own = F.pmod(F.xxhash64("node"), F.col("pieces").cast("long")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.struct(F.least(own, p).alias("i"), F.greatest(own, p).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = rows.join(crowded, ["t", "key"], "left").select("node", "fp", "t", "key", F.explode(F.when(F.col("pieces").isNull(), alone).otherwise(meets)).alias("cell"))
    dealt = dealt.select("t", "key", "cell.i", "cell.j", "node", "fp")
    return dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "node")


def links(nodes: DataFrame, radius: int, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) that tie all nodes (node, fp, keys) within ``radius`` bits that share a key; a spanning set, not all pairs."""
    return _dealt(nodes, crowd, CROWD_SHINGLES).mapInPandas(_by_group(GROUP, lambda pdf: _links(pdf, radius)), "u long, v long").distinct()


def verified_links(nodes: DataFrame, docs: DataFrame, radius: int, similarity: float, size: int, crowd: int = CROWD, crowd_shingles: int = CROWD_SHINGLES) -> DataFrame:
    """Edges (u, v) that tie all nodes (node, fp, keys, n, text) whose shingle sets are ``similarity`` alike, that share a key and lie within ``radius`` bits.

    Nodes tied by steps within the radius under one key make a cell, in which
    all pairs are compared by their sets, save those already tied.  Sets are
    made again, from ``docs`` (copy, text), for nodes of cells alone.
    """
    cells = _dealt(nodes, crowd, crowd_shingles).mapInPandas(_by_group(GROUP, lambda pdf: _cells(pdf, radius)), "cell long, node long").distinct()
    cells = materialize(cells, "cells")
    wanted = materialize(nodes.join(cells.select("node").distinct(), "node", "left_semi").select("node", F.col("text").alias("copy")), "candidates")
    few = wanted.count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(wanted) if few else wanted, "copy").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                sets = [np.unique(shingle_hashes(t, size)).tobytes() for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    # A text that occurs in several rows is read in each and kept once.
    sets = materialize(found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    met = cells.join(sets, "node").repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", "shingles")
    return met.mapInPandas(_by_group(["cell"], lambda pdf: _verified(pdf, similarity)), "u long, v long").distinct()


def _classes(prints: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, copy, fp, component, root) of every row (id, copy, fp, node), nodes (node, least) being tied by edges (u, v); ``root`` names the class."""
    stars = components(edges)
    rooted = nodes.select("node", "least").join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    member = rooted.join(least, "root").select("node", "component", "root")
    return prints.select("id", "copy", "fp", "node").join(member, "node").select("id", "copy", "fp", "component", "root")


def classes(prints: DataFrame, radius: int, crowd: int = CROWD) -> DataFrame:
    """(id, copy, fp, component, root) of every row of a written table (id, copy, fp, keys); equal fingerprints are always tied.

    ``component`` is the smallest id of the class; null ids don't count, and a
    class that has none gets a null component.
    """
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"), F.min("keys").alias("keys")).withColumn("node", F.xxhash64("fp"))
    nodes = materialize(nodes, "fingerprints")
    return _classes(prints.withColumn("node", F.xxhash64("fp")), nodes, links(nodes, radius, crowd))


def simhash_classes(docs: DataFrame, size: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, fp, component, root) of every row by 64-bit fingerprints that differ in at most ``radius`` bits; misses no link."""
    prints = fingerprints(docs, size, 64, 0, id_col=id_col, text_col=text_col)
    return classes(materialize(prints.select("id", "copy", "fp", band_keys(F.col("fp"), radius).alias("keys")), "simhash"), radius)


def radius_for(similarity: float, bits: int, spread: float = SPREAD) -> int:
    """Differing bits that shingle sets of this Jaccard similarity hardly pass: ``spread`` deviations above the mean of equally large ones."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + spread * math.sqrt(bits * share * (1 - share)))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, size: int = 5, bits: int = 512, bands: int = 10, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, fp, component, root) of every row by wide fingerprints of ``size``-word shingles.

    Two rows are tied if the Jaccard similarity of their shingle sets is
    ``similarity`` or more.  The pairs looked at are those that share one of
    ``bands`` keys, each of ``rows`` minimal shingles (a pair of similarity 0.8
    misses all ten once in 1,300 times), and whose fingerprints lie within a
    radius that such a pair hardly passes.  Rows of equal sets are one node.
    """
    prints = materialize(fingerprints(docs, size, bits, bands, rows, id_col, text_col, sets=True), "simhash")
    # Fingerprint, keys and size follow from the set, so any row's will do.
    nodes = prints.groupBy("node").agg(F.min("id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("n").alias("n"), F.min("copy").alias("text"))
    nodes = materialize(nodes, "fingerprints")
    texts = docs.select(F.xxhash64(text_col).alias("copy"), F.col(text_col).cast("string").alias("text"))
    edges = verified_links(nodes, texts, radius_for(similarity, bits), similarity, size)
    return _classes(prints, nodes, edges)


def keep_one(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """``docs`` with one row of each class of near duplicates: the one of the smallest id; columns unchanged.

    Rows that repeat an id and its text count as one document, of which one row
    stays.  Rows without an id stay, or with ``unnamed`` go too: all of them in a
    class that has an id, else all but those of the text of the smallest hash.
    """
    found = materialize(near_duplicates(docs, similarity, id_col=id_col, text_col=text_col), "near-duplicates")
    rows = found.filter("id is not null").groupBy("id", "copy").agg(F.max(F.expr("id <> component")).alias("drop"), F.count("*").alias("n"))
    if unnamed:
        without = found.filter("id is null").groupBy("id", "copy", "root").agg(F.max("component").alias("component"), F.count("*").alias("n"))
        first = without.groupBy("root").agg(F.min("copy").alias("first"))
        without = without.join(first, "root").select("id", "copy", F.expr("component is not null or copy <> first").alias("drop"), "n")
        rows = rows.unionByName(without)
    own, copy = unused("dropped_id", docs), unused("dropped_copy", docs)
    rows = materialize(rows.filter("drop or n > 1").select(F.col("id").alias(own), F.col("copy").alias(copy), "drop"), "dropped-rows")
    dropped, again = rows.drop("drop"), rows.filter("not drop").drop("drop")
    if rows.count() <= BROADCAST_ROWS:
        dropped, again = F.broadcast(dropped), F.broadcast(again)
    same = lambda left: left[id_col].cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(left[text_col]) == F.col(copy))
    kept = docs.join(dropped, same(docs), "left_anti")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, same(docs), "left_semi").dropDuplicates([id_col, text_col]))


def op1_simhash(spark, sf_dir) -> DataFrame:
    found = simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
