"""Likelihood of texts under word counts backed by a subword lattice.

The pieces of a public vocabulary, weighted by the scores it comes with, spell
a word in many ways; the forward recursion adds up the weights of all of them.
Pieces that begin a word carry a mark and don't reach into the next, so a text's
marginal is the product of its words'.  Counts of the training words are
interpolated with that: the rarer a word, the more its spelling counts.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import materialize, table, words
from slabspark.llm.langid import remainder

#: Most frequent words that travel to every task (16 bytes each); the counts of rarer ones are joined.
COMMON_WORDS = 400_000
#: Weight of the end of a text among what the spelling model expects, and of characters outside the vocabulary.
END_WEIGHT, UNKNOWN_WEIGHT = 1e-3, 1e-4
#: Spellings a worker remembers, twice this many at most, and the bytes of the longest word among them.
REMEMBERED, LONGEST = 350_000, 64
#: Sums of weights up to this are made again from logarithms.
SMALL = 1e-290
#: Where brute force puts a floor under a probability; scores have none.
TINY = 1e-300
#: No word is empty, so this stands for the end of a text.
END = b""


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Natural-log marginals of words over all segmentations."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        score = np.array([model.get_score(i) for i in ids])
        # Scores of unigram files are log-probabilities; merge files number their pieces down from 0, most frequent first.
        weight = np.exp(score) if score.min() > -100 else 1 / (2.7 + score.max() - score)
        weight = np.log(weight / weight.sum() * (1 - UNKNOWN_WEIGHT))
        self.pieces = {model.id_to_piece(i): float(w) for i, w in zip(ids, weight)}
        self.covered = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, w in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), math.exp(w), w))
        self.automaton.make_automaton()
        self.byte = math.log(UNKNOWN_WEIGHT / 256)
        self.young: dict[bytes, tuple[int, float, float]] = {}
        self.old: dict[bytes, tuple[int, float, float]] = {}

    def marginal(self, word: str) -> float:
        """ln of the summed weights of all ways to spell ``word``; bytes stand in for characters that no piece covers."""
        text = "▁" + word
        if len(text) <= LONGEST and self.covered.issuperset(text):
            into = [0.0] * len(text)
            into.append(1.0)  # the last place stands for that before the first character
            for end, (size, weight, _) in self.automaton.iter(text):
                into[end] += into[end - size] * weight
            if into[-2] > SMALL:
                return math.log(into[-2])
        return self._log_marginal(text)

    def _log_marginal(self, text: str) -> float:
        """The same from logarithms, for what is too small for a float."""
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, (size, _, weight) in self.automaton.iter(text):
            ends[end].append((end - size, weight))
        exp, log, log1p = math.exp, math.log, math.log1p
        into = [0.0] * (len(text) + 1)
        for at, here in enumerate(ends):
            terms = [into[start] + weight for start, weight in here]
            if text[at] not in self.covered:
                terms.append(into[at - 1] + self.byte * len(text[at].encode("utf-8", "surrogatepass")))
            if len(terms) == 1:
                into[at] = terms[0]
            elif len(terms) == 2:
                a, b = terms
                into[at] = a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))
            else:
                top = max(terms)
                into[at] = top + log(sum([exp(t - top) for t in terms]))
        return into[-2]

    def entry(self, word: bytes) -> tuple[int, float, float]:
        """The hash of a word (or of the end of a text), its probability under the spelling model and the log10 of that.

        The probability of a long word is too small for a float and 0; its logarithm is not.
        """
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                ln = self.marginal(word.decode("utf-8", "surrogatepass")) + math.log1p(-END_WEIGHT) if word != END else math.log(END_WEIGHT)
                found = _hash(word), math.exp(ln), ln / math.log(10)
            if len(word) <= LONGEST:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[word] = found
        return found


@functools.cache
def _lattice(path: str) -> Lattice:
    return Lattice(path)


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, c): how often each word, known by a 64-bit hash, and the end of a text occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for a in range(0, batch.num_rows, 256):
                for text in batch.slice(a, 256).column(0).to_pylist():
                    count.update(words(text))
            count[END] += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in count], pa.int64()), pa.array(list(count.values()), pa.int64())], ["h", "c"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of all words above a count that at most ``most`` words pass."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    sizes = sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True)  # a few hundred rows
    total, least = 0, None
    for s, n in sizes:
        total += n
        if total > most:
            break
        least = s
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    chosen = counts.filter(step >= least).toPandas()
    chosen = chosen.sort_values("h")
    return chosen["h"].to_numpy(np.int64), chosen["c"].to_numpy(np.int64)


def scored(docs: DataFrame, folds: int = 7, held: int = 2, path: str | None = None, common_words: int = COMMON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A word's probability is (c + k s) / (N + k): c and N count training
    tokens, s is its summed spelling weight, and k makes the share left to
    unseen words that of the words seen once.  Without a count it is added up
    from logarithms, so that no word is too long for it.  Null and empty texts are a lone
    end.  Rows without an id are in no fold: they are scored, but not learned
    from.  Without any training row, s alone is used.
    """
    path = path or vocabulary_path()
    train = docs.filter(remainder(id_col, folds) != held)
    counts = materialize(token_counts(train, text_col), "token-counts")
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first()
    unseen = min(max(once, 1) / n, 0.5) if n else 1.0
    k = n * unseen / (1 - unseen) if n else 1.0
    # What every task needs is bounded by ``common_words``.
    common = docs.sparkSession.sparkContext.broadcast(_common(counts, common_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(path)
        hashes, known = common.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                out: list[list] = [[] for _ in range(7)]
                for text in piece.column("text").to_pylist():
                    count = Counter(words(text))
                    count[END] += 1
                    young = lattice.young
                    entries = [young.get(w) or lattice.entry(w) for w in count]
                    h = np.array([e[0] for e in entries], np.int64)
                    tf = np.fromiter(count.values(), np.int64, len(count))
                    spelled = np.array([e[1] for e in entries])
                    at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                    hit = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                    c = known[at[hit]] if len(hashes) else np.empty(0)
                    rest = ~hit
                    log_spelled = np.array([e[2] for e, other in zip(entries, rest.tolist()) if other], np.float64)
                    row = (int(tf.sum()), int(tf[hit].sum()), float((tf[hit] * np.log10(c + 1)).sum()), float((tf[hit] * np.log10((c + k * spelled[hit]) / (n + k))).sum()), h[rest], tf[rest], log_spelled)
                    for column, value in zip(out, row):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
                arrays = [piece.column("doc_id"), piece.column("held_out"), *(pa.array(x, t) for x, t in zip(out, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "h", "tf", "spelled"])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(remainder(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h array<long>, tf array<long>, spelled array<double>"
    # A row's number is only used from the written table, where it stays what it is.
    rows = materialize(few.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "scored-texts")
    rare = rows.select("row", F.explode(F.arrays_zip("h", "tf", "spelled")).alias("w")).select("row", "w.h", "w.tf", "w.spelled")
    c = F.coalesce("c", F.lit(0))
    # Beside a count a spelling too small for a float adds nothing to it.
    seen = F.when(c > 0, F.log10(c + F.lit(k) * F.pow(F.lit(10.0), F.col("spelled")))).otherwise(F.col("spelled") + math.log10(k))
    rare = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("known2"), F.sum(F.col("tf") * F.log10(c + 1.0)).alias("base2"),
        F.sum(F.col("tf") * (seen - math.log10(n + k))).alias("score2"))
    out = rows.drop("h", "tf", "spelled").join(rare, "row", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    base = F.col("base") + zero("base2") - F.col("n_tokens") * math.log10(n + v + 1)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known2")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + zero("score2")).alias("score"))


def op8_lm_score(spark, sf_dir) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
