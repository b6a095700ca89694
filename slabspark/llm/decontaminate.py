"""Benchmark decontamination by spaced seeds.

A mask picks some of the words of a window; its hash is the same for two windows
that differ only at the other places.  Windows of documents and benchmark items
that share a hash are hits; a hit counts if the texts agree around it, place by
place, but for a few substituted words.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import let, materialize, table, unused

#: An overlap is a stretch of SPAN places with at most MISSES different words (or the whole of a shorter item).
SPAN, MISSES = 13, 3
#: Masks by the width of an overlap (1: the word counts, 0: it may differ).  However the misses allowed in that width
#: lie, one of its masks fits between them; found by enumeration.
MASKS = {13: ("11101", "11011"), 12: ("11101",), 11: ("11101",), 10: ("11101", "1111"), 9: ("11101", "100111"), 8: ("11101",), 7: ("11011",), 6: ("1111", "11011"), 5: ("111", "1101"), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
#: A benchmark with up to this many seeds is broadcast (about 300 bytes each); a larger one is joined by shuffles.
BROADCAST_SEEDS = 100_000
#: Words of the chunks in which documents are searched; beside a large benchmark only chunks with a hit travel, and smaller ones.
SEARCHED, CHUNK = 256, 64
#: An item with fewer words says too little inside a longer text: the filter drops a document for it only if that is its whole text.
LEAST_WORDS = 3


def tokens(text: Column) -> Column:
    """Runs of letters and digits in small letters; none for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: t != "")


def masks_of(width: int, span: int = SPAN, misses: int = MISSES) -> tuple[str, ...]:
    """Masks of which one at least fits into every overlap of ``width`` places, wherever its misses are."""
    if (span, misses) == (SPAN, MISSES) and width in MASKS:
        return MASKS[width]
    # The equal words lie in one run more than there are misses; the longest run has this many.
    allowed = width * misses // span
    return ("1" * max(1, -(-(width - allowed) // (allowed + 1))),)


def seeds(hashes: Column, masks: Iterable[str]) -> Column:
    """Array of (seed, pos) for every mask and every window that fits; pos counts from 0."""
    n = F.size(hashes)
    none = F.array().cast("array<struct<seed:bigint,pos:int>>")

    def of(mask: str) -> Column:
        places = [i for i, c in enumerate(mask) if c == "1"]
        starts = F.sequence(F.lit(0), n - len(mask))
        made = F.transform(starts, lambda p: F.struct(F.xxhash64(F.lit(int(mask, 2)), *[F.get(hashes, p + i) for i in places]).alias("seed"), p.alias("pos")))
        return F.when(n >= len(mask), made).otherwise(none)

    return F.concat(none, *[of(m) for m in masks])


def _sequence(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    few = df.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    return few.select("id", F.transform("words", lambda t: F.xxhash64(t)).alias("seq"))


def _around(seq: Column, pos: Column, span: int, absent: int) -> Column:
    """The words at the places that a window of ``span`` words over the hit's first word can cover; ``absent`` beyond the ends."""
    reach = F.sequence(F.lit(1 - span), F.lit(span - 1))
    return F.transform(reach, lambda o: F.when(pos + o >= 0, F.coalesce(F.get(seq, pos + o), F.lit(absent))).otherwise(F.lit(absent)))


def _chunks(texts: DataFrame, span: int, absent: int, chunk: int) -> DataFrame:
    """(id, copy, n, number, words): every text in chunks of ``chunk`` words with ``span`` - 1 more on either side, ``absent`` beyond the ends."""
    fill = lambda n: F.array_repeat(F.lit(absent).cast("long"), n)
    width = chunk + 2 * (span - 1)

    def cut(line: Column) -> Column:
        n = F.size(line) - width
        starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")))
        return F.transform(starts, lambda c: F.struct(n.alias("n"), c.alias("number"), F.slice(line, c * chunk + 1, F.lit(width)).alias("words")))

    line = lambda seq: F.concat(fill(span - 1), seq, fill(chunk + span - 1))
    whole = texts.select("id", let(F.col("seq"), lambda seq: F.struct(F.xxhash64(seq).alias("copy"), let(line(seq), cut).alias("chunks"))).alias("t"))
    return whole.select("id", "t.copy", F.explode("t.chunks").alias("c")).select("id", "copy", "c.n", "c.number", "c.words")


def _searched(texts: DataFrame, masks: list[str], span: int, absent: int, chunk: int = SEARCHED) -> DataFrame:
    """(id, seed, words, at) of every place; ``words`` is the chunk it lies in, where its context begins after ``at`` words.

    Chunk, place and seed are generated row by row within one compiled loop, so
    that only places whose seed is found are ever written out.
    """
    chunks = _chunks(texts, span, absent, chunk).withColumn("left", F.col("n") - F.col("number") * chunk)
    places = chunks.select("id", "words", "left", F.explode(F.lit(list(range(chunk)))).alias("at")).where("at < left")

    def seed(mask: str) -> Column:
        picked = [F.get("words", F.col("at") + (span - 1 + i)) for i, c in enumerate(mask) if c == "1"]
        return F.when(F.col("left") - F.col("at") >= len(mask), F.xxhash64(F.lit(int(mask, 2)), *picked))

    return places.select("id", "words", "at", F.explode(F.array(*[seed(m) for m in masks])).alias("seed"))


def _contexts(texts: DataFrame, index: DataFrame, masks: list[str], span: int, absent: int) -> DataFrame:
    """(id, seed, doc) of every place whose seed is in ``index``; ``doc`` is what ``_around`` gives.

    Seeds travel alone.  The words around a hit come from the chunk it lies in,
    so a long text isn't repeated for each of its places.
    """
    reach = 2 * span - 1
    places = texts.select("id", let(F.col("seq"), lambda seq: F.struct(F.xxhash64(seq).alias("copy"), seeds(seq, masks).alias("s"))).alias("t"))
    places = places.select("id", "t.copy", F.explode("t.s").alias("s")).select("id", "copy", "s.seed", "s.pos")
    hits = places.join(index.select("seed").distinct(), "seed", "left_semi").distinct().withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("int"))
    chunks = _chunks(texts, span, absent, CHUNK).select(F.col("id").alias("of"), F.col("copy").alias("text"), "number", "words")
    met = hits.join(chunks, hits["id"].eqNullSafe(chunks["of"]) & (F.col("copy") == F.col("text")) & (F.col("chunk") == F.col("number")))
    return met.select("id", "seed", F.slice("words", F.col("pos") % CHUNK + 1, F.lit(reach)).alias("doc"))


def _most_equal(doc: Column, item: Column, width: Column) -> Column:
    """The most equal places of any window of ``width`` places."""
    line = F.array_join(F.zip_with(doc, item, lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    windows = F.transform(F.sequence(F.lit(1), F.size(doc) - width + 1), lambda i: F.length(F.replace(F.substring(line, i, width), F.lit("0"), F.lit(""))))
    return F.array_max(windows)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, misses: int = MISSES, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, equal_words): pairs with a verified overlap, once each.

    ``equal_words`` is the number of equal places in the best window of
    ``span`` words; an item with fewer words is compared whole, with misses in
    proportion (none below five words), wherever it stands in a document.  Null, empty and wordless texts overlap nothing.  Rows that
    repeat an id are judged together; null ids are one such id.
    """
    items = _sequence(benchmark, item_col, item_text_col)
    width = F.least(F.lit(span), F.size("seq"))
    widths = sorted(r["w"] for r in items.select(width.alias("w")).filter("w > 0").distinct().collect())  # ``span`` at most
    masks = {w: masks_of(w, span, misses) for w in widths}
    own = F.coalesce(*[F.when(width == w, seeds(F.col("seq"), m)) for w, m in masks.items()], F.array().cast("array<struct<seed:bigint,pos:int>>"))
    # Documents are sought with the masks of the widths that occur.
    sought_masks = sorted({m for ms in masks.values() for m in ms})
    places = items.select("id", "seq", F.explode(own).alias("s"))
    index = places.select(
        F.col("s.seed").alias("seed"), F.col("id").alias("item_id"),
        width.alias("width"), _around(F.col("seq"), F.col("s.pos"), span, 1).alias("item"),
    ).distinct()
    index = materialize(index, "benchmark-seeds")
    texts = _sequence(docs, id_col, text_col)
    if index.count() <= broadcast_seeds:
        hits = _searched(texts, sought_masks, span, 2).join(F.broadcast(index), "seed")
        hits = hits.select("id", "item_id", "width", "item", F.slice("words", F.col("at") + 1, F.lit(2 * span - 1)).alias("doc"))
    else:
        hits = _contexts(texts, index, sought_masks, span, 2).join(index, "seed")
    equal = _most_equal(F.col("doc"), F.col("item"), F.col("width"))
    found = hits.select(F.col("id").alias("doc_id"), "item_id", "width", equal.alias("equal_words"))
    found = found.filter(F.col("equal_words") >= F.col("width") - F.floor(F.col("width") * misses / span))
    return found.groupBy("doc_id", "item_id").agg(F.max("equal_words").alias("equal_words"))


def slight_items(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_id, words): the items that ``without_overlaps`` takes as whole texts only."""
    words = tokens(F.col(item_text_col))
    return benchmark.select(F.col(item_col).alias("item_id"), words.alias("words")).filter(F.size("words").between(1, least_words - 1))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = False, item_col: str = "item_id", item_text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without those that overlap a benchmark item; columns unchanged.

    An item of fewer than ``least_words`` words ("yes") drops a document only
    if it is all the words of that; ``slight_items`` lists these items.  Rows
    without an id stay, or with ``unnamed`` are judged each by its text.
    """
    name = docs[id_col].cast("string")
    if unnamed:
        name = F.when(name.isNull(), F.concat(F.lit("text "), F.xxhash64(docs[text_col]).cast("string"))).otherwise(F.concat(F.lit("id "), name))
    named = docs.select(name.alias("name"), docs[text_col].alias("text"))
    slight = slight_items(benchmark, item_col, item_text_col, least_words)
    leak = unused("leak", docs)
    found = overlaps(named, benchmark.filter(F.size(tokens(F.col(item_text_col))) >= least_words), "name", item_col=item_col, item_text_col=item_text_col).select(F.col("doc_id").alias(leak))
    if not slight.isEmpty():
        short = named.select(F.col("name").alias(leak), tokens(F.col("text")).alias("words")).filter(F.size("words").between(1, least_words - 1))
        found = found.unionByName(short.join(slight.select("words").distinct(), "words", "left_semi").select(leak))
    found = materialize(found.filter(F.col(leak).isNotNull()).distinct(), "leaks")
    return docs.join(found, name == found[leak], "left_anti")


def op3_decontamination(spark, sf_dir) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
