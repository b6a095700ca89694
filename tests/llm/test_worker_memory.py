"""What a Python worker holds at once, and keeps after its stage."""

import itertools
import random
import tracemalloc

from slabspark.llm import bpe, langid


def test_vectors_of_few_trigrams_are_held_at_once():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèàç ") for _ in range(60_000))
    assert len(set(langid.trigrams(text).tolist())) > 16 * langid.GRAMS
    langid.text_vectors(["warm up"])
    tracemalloc.start()
    langid.text_vectors([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14_000_000


def test_a_worker_forgets_words_and_pairs():
    coder = bpe.WordBpe(bpe.vocabulary_path())
    words = [a + b + c + d for a, b, c, d in itertools.product("abcdefghijklmnopqrst", repeat=4)]
    for a in range(0, len(words), 1000):
        text = " ".join(words[a : a + 1000])
        ids, _ = coder.encode(text)
    assert len(coder.young) + len(coder.old) <= 80_000
    assert len(coder.fits) <= 100_000
    assert [int(i) for i in ids.split()] == coder.library.encode(text, add_special_tokens=False).ids
