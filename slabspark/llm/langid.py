"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is the product of its
letters' vectors, shifted by their place; a text is the sum of its trigrams; a
language is the sum of its texts.  A text takes the language whose sum has the
largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import mix, slices

DIMENSIONS = 1024
#: About so many documents of each language are learned from, chosen by a hash of their ids.
TRAIN_DOCS = 5000
#: Lowest cosine of a text that the pipeline keeps, about three deviations of what chance alone gives (1 / sqrt(DIMENSIONS)
#: = 0.031): a text in no learned language passes once in some hundred times.  Texts of up to SHORT characters have too
#: few trigrams to tell and stay.
MIN_SCORE, SHORT = 0.1, 16
UNKNOWN = "und"
_PIECE = 100_000
#: Texts whose vectors are held at once, and trigrams of which that is so.
ROWS, GRAMS = 512, 1024
_letter: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the letter trigrams of the small-letter text; what is no letter counts as one space, also around it."""
    if not text:
        return np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[code]
    if not letter.any():
        return np.empty(0, np.int64)
    code = np.concatenate([[32], np.where(letter, code, 32), [32]])
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    return code[:-2] << 42 | code[1:-1] << 21 | code[2:]


def letter_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """(letters, dims) of +1 and -1, the same for a letter wherever it is computed."""
    word = np.arange(dims // 64, dtype=np.uint64)
    seed = mix(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + word)
    bits = np.unpackbits(mix(seed).view(np.uint8).reshape(len(codes), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :dims]


def _ngram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    low = (1 << 21) - 1
    parts = [grams >> 42, grams >> 21 & low, grams & low]
    alphabet, where = np.unique(np.concatenate(parts), return_inverse=True)
    vectors = letter_vectors(alphabet, dims)
    a, b, c = where.reshape(3, -1)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def text_vectors(texts: list[str | None], dims: int = DIMENSIONS) -> np.ndarray:
    """(texts, dims): the sum of each text's trigram vectors; long texts are added up piece by piece."""
    out = np.zeros((len(texts), dims))
    for a, b in slices(texts, _PIECE):
        codes = [trigrams(t) for t in texts[a:b]]
        owner = np.repeat(np.arange(b - a), [len(c) for c in codes])
        grams = np.concatenate(codes)
        for i in range(0, len(grams), _PIECE):
            seen, where = np.unique(grams[i : i + _PIECE], return_inverse=True)
            first = owner[i]
            own = owner[i : i + _PIECE] - first
            n = int(own[-1]) + 1
            for g in range(0, len(seen), GRAMS):
                here = (where >= g) & (where < g + GRAMS)
                width = min(GRAMS, len(seen) - g)
                for d in range(0, n, 128):
                    rows = here & (own >= d) & (own < d + 128)
                    m = min(128, n - d)
                    counts = np.bincount((own[rows] - d) * width + where[rows] - g, minlength=m * width).reshape(m, width)
                    out[a + first + d : a + first + d + m] += counts.astype(np.float32) @ _ngram_vectors(seen[g : g + width], dims).astype(np.float32)
    return out


def profiles(labelled: DataFrame, dims: int = DIMENSIONS, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language to profile, learned from rows with a label.

    The sample is bounded: about ``train_docs`` rows of each language, those
    whose id has the smallest hash; a language with fewer rows gives all.
    """
    few = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text")).filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in few.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, train_docs / n))) for k, n in sizes.items()])
    chosen = few.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for a in range(0, len(frame), ROWS):
                pdf = frame.iloc[a : a + ROWS]
                vectors = text_vectors(pdf["text"].tolist(), dims)
                for lang, rows in pdf.groupby("lang", sort=False).indices.items():
                    total[lang] = total.get(lang, 0) + vectors[rows].sum(axis=0)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "i": np.arange(dims), "v": v})

    sums = chosen.select("lang", "text").mapInPandas(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():  # languages x dimensions
        found.setdefault(r["lang"], np.zeros(dims))[r["i"]] = r["v"]
    return {k: v for k, v in sorted(found.items()) if v.any()}


def predicted(model: dict[str, np.ndarray], dims: int = DIMENSIONS) -> object:
    """An Arrow UDF text -> (lang_pred, score); only ``ROWS`` texts of a batch are Python strings at once."""
    names = list(model)
    unit = np.array([model[k] / np.linalg.norm(model[k]) for k in names]).reshape(len(names), dims)

    def judge(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        vectors = text_vectors(texts, dims)
        norm = np.linalg.norm(vectors, axis=1)
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if names and texts:
            cosine = vectors @ unit.T / np.maximum(norm, 1e-12)[:, None]
            best = cosine.argmax(axis=1)
            known = np.array([bool(t) and len(trigrams(t)) > 0 if n == 0 else True for t, n in zip(texts, norm)], bool)
            lang[known] = np.array(names, object)[best[known]]
            score[known] = np.clip(cosine.max(axis=1)[known], 0, 1)
        return lang, score

    @F.arrow_udf("lang_pred string, score double")
    def run(text: pa.Array) -> pa.Array:
        parts = [judge(text.slice(a, ROWS).to_pylist()) for a in range(0, max(1, len(text)), ROWS)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[0] for p in parts]), pa.string()), pa.array(np.concatenate([p[1] for p in parts]), pa.float64())], ["lang_pred", "score"])

    return run


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.when(F.col(id_col).isNotNull(), F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n)))


def language_ids(docs: DataFrame, folds: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from labelled rows of the other folds.

    A null or letterless text is ``und`` with score 0, and so is every text if
    nothing could be learned.  Rows without an id are in no fold: they are
    predicted, but not learned from.
    """
    model = profiles(docs.filter(remainder(id_col, folds) != held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    guess = predicted(model)
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(remainder(id_col, folds) == held, F.lit(False)).alias("held_out"), guess(F.col(text_col)).alias("g"))
    return out.select("doc_id", "held_out", "g.lang_pred", "g.score")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows whose text is null, has no letter or resembles no language; columns unchanged.

    Texts of up to ``short`` characters stay if they have a letter.
    """
    model = profiles(docs.filter(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, lang_col=lang_col)
    guess = predicted(model)
    judged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), guess(docs[text_col]).alias("g"), (F.length(docs[text_col]) <= short).alias("few"))
    return judged.filter((F.col("g.lang_pred") != UNKNOWN) & (F.col("few") | (F.col("g.score") >= min_score))).select("row.*")


def op2_language(spark, sf_dir) -> DataFrame:
    return language_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
