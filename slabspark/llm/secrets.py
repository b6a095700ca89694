"""Secrets in texts: fixed patterns, and strings whose characters look random.

Everything is column expressions.  The places of a pattern's matches follow
from two lists, the matches and the gaps between them: a match starts where
the lengths before it add up to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import unused

#: The patterns of the base kinds and the least lengths of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", "entropy")

#: Strings that are judged by their entropy.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Character class -> (pattern of the whole candidate, window, least entropy in bits per character).
CLASSES = {"hex": (r"^[0-9A-Fa-f-]+$", 20, 3.0), "mixed": (r"^(?=.*[0-9])(?=.*[A-Za-z])", 20, 3.7)}
#: Candidates that hold one of these are never reported: placeholders, counting sequences, UUIDs.
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|x{5}|0{6}|12345|abcde|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
MASK = "[SECRET]"

_SCALE = 1 << 32
_BLOCK = 256


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def running(lengths: Column) -> Column:
    """Sums of all earlier entries, one for each entry; added up by blocks, so that long arrays stay cheap."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda x, y: x + y))
    before = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda x, y: x + y))
    each = F.transform(lengths, lambda _, i: F.get(before, F.floor(i / _BLOCK).cast("int")) + F.aggregate(F.slice(lengths, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK), F.lit(0), lambda x, y: x + y))
    return F.when(F.size(lengths) > 0, each).otherwise(_empty("int"))


def window_entropy(text: Column, width: int, least: float) -> Column:
    """Whether some window of ``width`` characters has an entropy of ``least`` bits per character or more.

    Sum of c log2 c over the window's characters, c being their counts, is
    carried from window to window: a leaving and an entering character change
    one term each.  Terms are whole numbers, so nothing drifts.
    """
    term = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0).cast("long") for c in range(width + 1)])
    most = round(width * (math.log2(width) - least) * _SCALE)

    def count(window: Column, c: Column) -> Column:
        return F.length(window) - F.length(F.replace(window, c, F.lit("")))

    def step(acc: Column, c: Column) -> Column:
        window = acc["window"]
        full = F.length(window) >= width
        out = F.when(full, F.substring(window, 1, 1)).otherwise(F.lit(""))
        k = F.when(full, count(window, out)).otherwise(F.lit(0))
        less = acc["total"] - F.when(full, F.get(term, k) - F.get(term, k - 1)).otherwise(F.lit(0).cast("long"))
        rest = F.when(full, F.substring(window, 2, width - 1)).otherwise(window)
        n = count(rest, c)
        total = less + F.get(term, n + 1) - F.get(term, n)
        now = F.concat(rest, c)
        return F.struct(now.alias("window"), total.alias("total"), F.least(acc["best"], F.when(F.length(now) == width, total).otherwise(acc["best"])).alias("best"))

    start = F.struct(F.lit("").alias("window"), F.lit(0).cast("long").alias("total"), F.lit((1 << 62)).cast("long").alias("best"))
    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["best"] <= most)


def looks_random(candidate: Column) -> Column:
    """Whether a candidate string passes its character class's entropy and no allow-list entry."""
    verdict = F.lit(False)
    for pattern, width, least in reversed(CLASSES.values()):
        verdict = F.when(candidate.rlike(pattern), window_entropy(candidate, width, least)).otherwise(verdict)
    return F.when(candidate.rlike(ALLOWED), F.lit(False)).otherwise(verdict)


def _kinds(text: Column) -> list[tuple[str, str, Column, object]]:
    """(kind, pattern, quick test of the whole text, test of one match)."""
    small = F.lower(text)
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | small.contains(word)
    yes = lambda m: F.lit(True)
    return [
        ("assign", ASSIGN, named & text.rlike(ASSIGN), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE),
        ("access", ACCESS, text.contains("AKIA"), yes),
        ("hex", HEX, text.rlike(HEX), yes),
        ("entropy", CANDIDATE, text.rlike(CANDIDATE), looks_random),
    ]


def _found(text: Column, pattern: str, quick: Column) -> tuple[Column, Column]:
    """The matches of a pattern and the gaps before, between and after them."""
    hits = F.when(quick, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_empty("string"))
    gaps = F.when(quick, F.split(text, pattern, -1)).otherwise(F.array(text))
    return hits, gaps


def scanned(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with a column of all spans: array of (start, order, kind, end), sorted; code points, end exclusive.

    Null texts count as empty.  A string found by a base pattern isn't reported
    again for its entropy.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    df = docs.withColumn("__text", docs[text_col].cast("string"))
    for order, (kind, pattern, quick, good) in enumerate(_kinds(text)):
        hits, gaps = _found(text, pattern, quick)
        df = df.withColumn("__hits", hits).withColumn("__gaps", gaps)
        lengths = F.transform("__hits", lambda m, i: F.length(F.get("__gaps", i)) + F.length(m))
        df = df.withColumn("__before", running(lengths))
        spans = F.transform("__hits", lambda m, i: F.struct(
            (F.get("__before", i) + F.length(F.get("__gaps", i))).alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"),
            (F.get("__before", i) + F.length(F.get("__gaps", i)) + F.length(m)).alias("end"), m.alias("match")))
        chosen = F.filter(spans, lambda s: good(s["match"]))
        df = df.withColumn(f"__{kind}", F.when(F.size("__hits") > 0, F.transform(chosen, lambda s: s.dropFields("match"))).otherwise(_empty("struct<start:int,order:int,kind:string,end:int>")))
    base = F.concat("__assign", "__access", "__hex")
    fresh = F.filter("__entropy", lambda e: ~F.exists(base, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    df = df.withColumn(out, F.array_sort(F.concat(base, fresh)))
    return df.drop("__text", "__hits", "__gaps", "__before", *[f"__{k}" for k in KINDS])


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    df = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with masked texts; ``size_col``, where there is one, follows the texts that change.  No row goes."""
    own = unused("masked", docs)
    df = docs.select(*[docs[c] for c in docs.columns], docs[text_col].alias(own))
    for step, _ in enumerate(KINDS):
        df = df.withColumn(own, _masked_step(F.col(own), step))
    changed = ~F.col(own).eqNullSafe(F.col(text_col))
    out = [
        F.col(own).alias(c) if c == text_col
        else F.when(changed, F.length(own)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == size_col
        else F.col(c) for c in docs.columns
    ]
    return df.select(*out)


def _masked_step(text: Column, step: int) -> Column:
    _, pattern, quick, good = _kinds(text)[step]
    hits, gaps = _found(text, pattern, quick)
    told = F.transform(hits, lambda m: F.when(good(m), F.lit(MASK)).otherwise(m))
    joined = F.array_join(F.zip_with(gaps, F.concat(told, F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    return F.when(quick, joined).otherwise(text)


def op5_secrets(spark, sf_dir) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
