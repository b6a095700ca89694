"""How much work the encoder does."""

import random

from slabspark.llm import bpe


def test_a_word_is_cut_once_with_all_its_marks(monkeypatch):
    coder = bpe.WordBpe(bpe.vocabulary_path())
    cut, plain = [], coder.word
    monkeypatch.setattr(coder, "word", lambda symbols: cut.append(symbols) or plain(symbols))
    text = "zzquath zzquath. zzquath, ZZquath! zzquath's zzquath."
    ids, names = coder.encode(text)
    assert [int(i) for i in ids.split()] == coder.library.encode(text, add_special_tokens=False).ids
    assert names == coder.library.decode(coder.library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
    assert sum(symbols.startswith("zzquat") for symbols in cut) == 2  # alone, and in "zzquath's"


def same(coder, text):
    want = coder.library.encode(text, add_special_tokens=False).ids
    return coder.encode(text) == (" ".join(map(str, want)), coder.library.decode(want, skip_special_tokens=False))


def test_a_word_is_cut_once_whatever_stands_beside_it(monkeypatch):
    coder = bpe.WordBpe(bpe.vocabulary_path())
    cut, plain = [], coder.word
    monkeypatch.setattr(coder, "word", lambda symbols: cut.append(symbols) or plain(symbols))
    assert same(coder, 'zzquath (zzquath) zzquath... [Zzquath], "zzquath" zzquath-zzquath 7zzquath7 zzquath&&&')
    assert sum(symbols.startswith("zzquat") for symbols in cut) == 1
    assert same(coder, "日本zzquon 日本zzquon 日本 zzquon’s “zzquon”")  # cut by the library's splitter
    assert sum(symbols.startswith("zzquo") for symbols in cut) == 1


def test_tokens_fit_if_merging_leaves_them():
    coder = bpe.WordBpe(bpe.vocabulary_path())
    rng = random.Random(4)
    inner = [i for i, t in enumerate(coder.tokens) if t[-1] not in coder.plain]
    beside = {}
    for i, t in enumerate(coder.tokens):
        beside.setdefault(t[0], []).append(i)
    found = set()
    for _ in range(4000):
        a = rng.choice(inner)
        b = rng.choice(beside[rng.choice("aeiounrst")]) if rng.random() < 0.8 else rng.randrange(len(coder.tokens))
        fit = coder._merged(coder.tokens[a] + coder.tokens[b]) == [coder.tokens[a], coder.tokens[b]]
        assert coder._fit(a, b) == fit
        found.add(fit)
    assert found == {True, False}


def test_texts_are_taken_in_stretches(monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    coder = bpe.WordBpe(bpe.vocabulary_path())
    texts = ["one two  three's o'clock \n\t 'tis it'll \"'s\" .'s ''''  '", "x" * 100, " " * 30, "ab'" * 40, "日本 one two three 日本", "a<|endoftext|>b <|startoftext|>"]
    assert all(same(coder, text) for text in texts)
