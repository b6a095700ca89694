"""Byte-pair encoding by tokens that fit beside each other, and decoding.

Tokens whose neighbours all fit, that is, encode as themselves in pairs, are
the only such way to cut a word, and so its encoding.  A word is read from the
left: at each place the longest token of an automaton over the vocabulary comes
first, then the shorter ones it begins with; a place that no token can leave is
not entered again.  Whether two tokens fit follows from undoing their merges
along the seam.  Texts are decoded from their ids.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Words whose encoding a worker remembers, twice this many at most, the length of the longest among them, and pairs of
#: tokens of which it remembers whether they fit (about 140 bytes a word, 70 a pair; workers outlive their stage).
REMEMBERED, LONGEST, PAIRS = 40_000, 64, 100_000
#: A pair of tokens is one number: this many times that of the first and that of the second.
SEAM = 1 << 32
#: Characters of a text that are taken at once, to the next white space.
STRETCH = 1 << 16
#: Characters whose normalization and splitting are plain; a text with others goes through the library's splitter.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įĲ-ňŊ-ž]")
#: The rest of what white space ends.
_REST = re.compile(r"\S*")


def _kind(kind: str) -> str:
    return "".join([re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind])


#: Words of a plain text in small letters; what an apostrophe follows or begins stays whole, for ``_words``.
_CUT = re.compile("[{0}]+(?:'\\S*)?|[{1}]|'\\S*|[^\\s{0}{1}]+".format(_kind("L"), _kind("N")))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder of a tokenizers BPE file with word ends; its texts are split by ``pattern`` words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.alphabet = "".join(self.letters)
        # A token is written with one letter for each symbol; the last letter of a word, with its end mark, is a letter of its own.
        self.marked = {c: chr(0xE000 + i) for i, c in enumerate(self.letters)}
        self.plain = {v: k + self.end for k, v in self.marked.items()}
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self._symbols(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks.setdefault((a, b), rank)
        self.single = len({a + b for a, b in self.ranks}) == len(self.ranks)  # each token is the end of one merge
        whole = {t for t in map(self._symbols, self.ids) if len(self._merged(t)) == 1}  # no encoding can hold others
        ends = {a + b: rank for (a, b), rank in self.ranks.items()}
        # Tokens are numbered by the merge they are the end of, after those without any.
        self.tokens = sorted(whole, key=lambda t: (ends.get(t, -1), t))
        number = {t: i for i, t in enumerate(self.tokens)}
        self.left, self.right, self.joined = list(range(len(number))), list(range(len(number))), {}
        for a, b in self.ranks:
            if a in number and b in number and a + b in number:
                self.joined[number[a] * SEAM + number[b]] = i = number[a + b]
                self.left[i], self.right[i] = number[a], number[b]
        self.sizes = [len(t) for t in self.tokens]
        self.longest = max(self.sizes, default=0)
        # The longest token that a token begins with, -1 for none.
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        shown = [self._name(t) for t in self.tokens]
        self.shown = [str(self.ids[name]) for name in shown]
        self.names = {**dict(zip(self.shown, shown)), **{str(i): name for name, i in self.special.items()}}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.fits: dict[int, bool] = {}

    def _symbols(self, name: str) -> str:
        if self.end and name.endswith(self.end) and len(name) > len(self.end):
            name = name[: -len(self.end)]
            return name[:-1] + self.marked[name[-1]] if name[-1] in self.marked else name
        return name

    def _name(self, token: str) -> str:
        return token[:-1] + self.plain.get(token[-1], token[-1])

    def _merged(self, text: str) -> list[str]:
        """Plain merging of a few symbols: what defines whether tokens fit."""
        parts, get, never = list(text), self.ranks.get, 1 << 60
        ranks = [get(pair, never) for pair in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) < never:
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), never)
        return parts

    def _fit(self, a: int, b: int) -> bool:
        """Whether no merge spans the seam of two tokens before both are whole."""
        if not self.single:
            return self._merged(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]
        joined, left, right, limit = self.joined.get, self.left, self.right, len(self.tokens)
        while True:
            over = joined(a * SEAM + b)
            if over is not None and over < limit:
                return False
            # The later merge of the two is undone; of equal ones that on the right, which comes second.
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def word(self, symbols: str) -> list[int]:
        """The numbers of the tokens of one word, given by its symbols."""
        matches, sizes, fits, n = self.automaton.iter_long, self.sizes, self.fits, len(symbols)
        out: list[int] = []
        closed: set[int] = set()  # places that no token can leave
        at, before, straight = 0, -1, matches(symbols)
        token = next(straight)[1]
        while True:
            end = at + sizes[token]
            if end in closed:
                fit = False
            elif before < 0:
                fit = True
            else:
                fit = fits.get(before * SEAM + token)
                if fit is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    fit = fits[before * SEAM + token] = self._fit(before, token)
            if fit:
                out.append(token)
                if end == n:
                    return out
                at, before = end, token
                token = next(straight or matches(symbols[at : at + self.longest]))[1]
                continue
            straight = None
            token = self.shorter[token]
            while token < 0:
                closed.add(at)
                token = out.pop()
                at -= sizes[token]
                before = out[-1] if out else -1
                token = self.shorter[token]

    def _piece(self, letters: str) -> str:
        """Ids of the tokens of a word, as text."""
        shown = self.shown
        return " ".join([shown[t] for t in self.word(letters[:-1] + self.marked[letters[-1]])])

    def _chunk(self, chunk: str) -> str:
        """Ids, as text, of a match of ``_CUT``, or of the letters after a space."""
        if chunk[0] == " ":
            return self._piece(chunk[1:])
        return " ".join([self._piece(codecs.charmap_decode(word.encode(), "strict", self.alphabet)[0]) for word in (_words()(chunk) if "'" in chunk else [chunk])])

    def _remembered(self, chunk: str) -> str:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or self._chunk(chunk)
            if len(chunk) <= LONGEST:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[chunk] = found
        return found

    def _segment(self, text: str) -> Iterator[str]:
        """Ids, as text, of each stretch."""
        if _PLAIN.search(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            for a in range(0, len(pieces), STRETCH):
                yield " ".join([self._remembered(" " + letters) for letters, _ in pieces[a : a + STRETCH]])
            return
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
        at = 0
        while at < len(text):
            end = _REST.match(text, at + STRETCH).end() if at + STRETCH < len(text) else len(text)
            chunks = _CUT.findall(text, at, end)
            found = list(map(self.young.get, chunks))
            if None in found:
                found = [self._remembered(chunk) if known is None else known for chunk, known in zip(chunks, found)]
            if found:
                yield " ".join(found)
            at = end

    def encode(self, text: str | None) -> tuple[str, str]:
        """The ids, and the tokens they decode to, each joined by one space."""
        ids: list[str] = []
        names: list[str] = []
        text = text or ""
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            for some in [str(self.special[part])] if part in self.special else self._segment(part):
                ids.append(some)
                names.append(" ".join(map(self.names.__getitem__, some.split(" "))))
        return " ".join(ids), " ".join(names)


@functools.cache
def _words():
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


@functools.cache
def _coder(path: str) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(path)


def decode(ids: list[int], path: str) -> str:
    """The tokens of these ids, joined by one space, as the file has no decoder; unknown ids are left out."""
    coder = _coder(path)
    names = {**{i: n for n, i in coder.ids.items()}, **{i: n for n, i in coder.special.items()}}
    return " ".join([names[i] for i in ids if i in names])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, with ``full`` also ``ids`` and ``decoded``.

    Null texts count as empty and have no token.  The file must be at ``path``
    on every worker.
    """
    path = path or vocabulary_path()
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                out: list[list] = [[] for _ in range(5 if full else 3)]
                for text in piece.column("text").to_pylist():
                    ids, names = coder.encode(text)
                    for column, value in zip(out, (ids.count(" ") + 1 if ids else 0, digest(ids), digest(names))):
                        column.append(value)
                    if full:
                        out[3].append([int(x) for x in ids.split()])
                        out[4].append(names)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays) + 1])

    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(run, kind)


def op10_bpe(spark, sf_dir) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
