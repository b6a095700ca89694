"""How the spelling lattice adds up its weights."""

import math
import random

import pytest

from slabspark.llm import lm


def test_ordinary_words_take_no_logarithm_at_each_place(monkeypatch):
    lattice = lm.Lattice(lm.vocabulary_path())
    rng = random.Random(6)
    words = ["", "the", "straße", *("".join(rng.choice("etaoinshrdlué.,") for _ in range(rng.randrange(1, 40))) for _ in range(300))]
    taken, log = [], math.log
    monkeypatch.setattr(lm.math, "log", lambda x: taken.append(x) or log(x))
    sums = [lattice.marginal(word) for word in words]
    assert len(taken) == len(words)
    assert sums == pytest.approx([lattice._log_marginal("▁" + word) for word in words], rel=1e-13)


def test_small_and_uncovered_words_are_added_up_from_logarithms():
    lattice = lm.Lattice(lm.vocabulary_path())
    rng = random.Random(7)
    pool = [c for c in sorted(lattice.covered) if ord(c) > 0x3000]
    dense = ["".join(rng.choice(pool) for _ in range(n)) for n in (20, 40, 55, 63, 64, 65, 200)]
    assert lattice.marginal(dense[3]) < math.log(lm.SMALL) < lattice.marginal(dense[0])
    for word in (*dense, "𓀀", "a𓀀b", "𓀀" * 300, "x" * 5000):
        assert lattice.marginal(word) == pytest.approx(lattice._log_marginal("▁" + word), rel=1e-13)
