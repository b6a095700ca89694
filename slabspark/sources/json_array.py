"""One large JSON array read by many tasks.

The file is cut at every ``}``, so Spark's text scan can split it anywhere.
What a piece means depends on whether it begins inside a string and how deep;
a first pass tells, for each byte range, what becomes of either beginning.
Put together in order (one row a range) they give every range its true
beginning, and a second pass takes the elements out.  An element that runs
over ranges leaves a fragment in each, and these are joined at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slabspark.session import materialize

_OUTSIDE = re.compile(r'[\[\]{}"]')
_INSIDE = re.compile(r'["\\]')
_SUMMARY = "file string, block bigint, quoted int, first string, ends_quoted boolean, depth bigint"
_PART = "file string, block bigint, place int, entry string"


def _marks(text: str, quoted: bool) -> Iterator[tuple[int, str]]:
    """Places of brackets outside of strings, at last (length, '"' or '') for whether a string is open at the end."""
    at, n = 0, len(text)
    while at < n:
        found = (_INSIDE if quoted else _OUTSIDE).search(text, at)
        if found is None:
            break
        c, at = found.group(), found.end()
        if c == '"':
            quoted = not quoted
        elif c == "\\":
            at += 1
        else:
            yield found.start(), c
    yield n, '"' if quoted else ""


def _summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each range and either beginning: is a string open at its end, how much deeper is it, and what is its first bracket."""
    state: dict[tuple[str, int], list[list]] = {}
    for pdf in frames:
        for value, file, block in zip(pdf["value"], pdf["file"], pdf["block"]):
            for began in state.setdefault((file, block), [[False, 0, ""], [True, 0, ""]]):
                for _, c in _marks(value + "}", began[0]):
                    if c in ('"', ""):
                        began[0] = c == '"'
                    else:
                        began[1] += 1 if c in "[{" else -1
                        began[2] = began[2] or c
    rows = [(file, block, k, s[2], s[0], s[1]) for (file, block), both in state.items() for k, s in enumerate(both)]
    if rows:
        yield pd.DataFrame(rows, columns=["file", "block", "quoted", "first", "ends_quoted", "depth"]).astype({"file": object, "first": object})


def _elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Objects of the array; place 0: whole, 1: from an earlier range, 2: on into a later one, 3: both."""
    range_, quoted, depth, inside, ours, held = None, False, 0, False, False, []
    out: list[tuple] = []

    def left_over() -> None:
        if range_ is not None and inside:
            out.append((*range_, 2 if ours else 3, "".join(held)))

    for pdf in frames:
        for value, file, block, starts_quoted, starts_deep in zip(pdf["value"], pdf["file"], pdf["block"], pdf["quoted"], pdf["deep"]):
            if (file, block) != range_:
                left_over()
                range_, quoted, depth, held = (file, block), bool(starts_quoted), int(starts_deep), []
                inside, ours = depth >= 2, False  # the element may be an inner array; its fragments have no beginning
            text, start = value + "}", 0
            for at, c in _marks(text, quoted):
                if c in ('"', ""):
                    quoted = c == '"'
                elif c in "[{":
                    if c == "{" and depth == 1:
                        inside, ours, start, held = True, True, at, []
                    depth += 1
                else:
                    depth -= 1
                    if inside and depth == 1:
                        out.append((*range_, 0 if ours else 1, "".join([*held, text[start : at + 1]])))
                        inside, held, start = False, [], at + 1
            if inside:
                held.append(text[start:])
        if out:
            yield pd.DataFrame(out, columns=["file", "block", "place", "entry"]).astype({"file": object, "entry": object})
            out = []
    left_over()
    if out:
        yield pd.DataFrame(out, columns=["file", "block", "place", "entry"]).astype({"file": object, "entry": object})


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(entry): the text of every object that is an element of a file's top-level array; other entries are skipped.

    Files whose top level isn't an array give nothing.  Their layout doesn't
    matter: line breaks, strings with brackets and escapes may be anywhere.
    """
    pieces = spark.read.option("lineSep", "}").text(path, recursiveFileLookup=True).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    told = materialize(pieces.mapInPandas(_summary, _SUMMARY), "json-ranges")
    # A range may come from several tasks only if Spark has cut it anew, which the block number shows.
    pair = lambda q, name: F.max(F.when(F.col("quoted") == q, F.struct("ends_quoted", "depth", "first"))).alias(name)
    ranges = told.groupBy("file", "block").agg(pair(0, "plain"), pair(1, "string"))
    order = Window.partitionBy("file").orderBy("block")  # one row a range
    steps = F.collect_list(F.struct("plain", "string")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("first"))

    def step(now, s):
        taken = F.when(now["quoted"], s["string"]).otherwise(s["plain"])
        first = F.when(now["first"] != "", now["first"]).otherwise(taken["first"])
        return F.struct(taken["ends_quoted"].alias("quoted"), (now["depth"] + taken["depth"]).alias("depth"), first.alias("first"))

    begun = ranges.select("file", "block", "plain", F.aggregate(steps, start, step).alias("s"))
    top = F.when(F.col("s.first") != "", F.col("s.first")).otherwise(F.col("plain.first"))
    begun = materialize(begun.select("file", "block", F.col("s.quoted").alias("quoted"), F.col("s.depth").alias("deep"), (top == "[").alias("array")), "json-beginnings")
    # One row for each range of some 100 MB; a shuffle would lose the order of pieces.
    known = pieces.join(F.broadcast(begun), ["file", "block"], "left")
    moved = F.raise_error(F.lit("the scan's ranges changed between two passes: set spark.sql.files.minPartitionNum"))
    known = known.where(F.when(F.col("array").isNull(), moved.cast("boolean")).otherwise(F.col("array")))
    parts = materialize(known.select("value", "file", "block", "quoted", "deep").mapInPandas(_elements, _PART), "json-elements")
    whole = parts.where("place = 0").select("entry")
    # Fragments, two of a range at most: one that begins an object, any that go on, and the first that ends it.
    cut = parts.where("place <> 0").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", F.when(F.col("place") == 2, 1).otherwise(0).alias("late"), "place", "entry"))).alias("f"))
    joined = cut.select(F.explode(F.aggregate("f", F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open")), _join)["done"]).alias("entry"))
    return whole.unionByName(joined)


def _join(now, part):
    longer = F.concat(now["open"], part["entry"])
    return (F.when(part["place"] == 2, F.struct(now["done"].alias("done"), part["entry"].alias("open")))
            .when((part["place"] == 1) & now["open"].isNotNull(), F.struct(F.concat(now["done"], F.array(longer)).alias("done"), F.lit(None).cast("string").alias("open")))
            .when(part["place"] == 3, F.struct(now["done"].alias("done"), longer.alias("open")))
            .otherwise(F.struct(now["done"].alias("done"), F.lit(None).cast("string").alias("open"))))
