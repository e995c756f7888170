"""Lattices decoded against all of their paths, and scores with and without the shortcut for words that can't hit."""

import itertools
import random

import numpy as np
import pytest

from spanscan.llm import toxicity

COUNTS = toxicity._symbol_counts(("the cat sat on the mat and the dog was good to all of them in the hall seen too " * 50).encode())
WORDS = ("idiot", "moron", "clown", "stupid", "ass", "tool")
MODEL = toxicity.Model(toxicity.char_model(COUNTS, WORDS), {**{w.encode(): 0.9 for w in WORDS}, b"^idio": 0.5})


def value(chosen, model) -> float:
    """The score of one path: costs taken off, and the log probabilities of its letters and of the break after them."""
    a = b = 0
    total = 0.0
    for c, cost in chosen:
        total -= cost
        if c:
            s = ord(c) - 96 if "a" <= c <= "z" else 27
            total, a, b = total + model[a, b, s], b, s
    return total + model[a, b, 0]


@pytest.mark.parametrize("repeats", [True, False])
def test_decoding_finds_the_best_of_all_paths(repeats):
    rng = random.Random(11)
    for _ in range(300):
        word = "".join(rng.choice("aioost1|0$-.7té%") for _ in range(rng.randrange(0, 9)))
        best: dict[str, float] = {}
        for chosen in itertools.product(*toxicity.lattice(word, repeats)):
            text = "".join(c for c, _ in chosen)
            best[text] = max(best.get(text, -np.inf), value(chosen, MODEL.chars))
        assert best[toxicity.decode(word, MODEL.chars, repeats)] == pytest.approx(max(best.values()), abs=1e-9), word


def test_words_that_are_not_decoded_change_no_score(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("idotsamrn") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 7))) if rng.random() < 0.6 else rng.choice(["idioot", "moronn", "ttool", "asss", "all", "idiooots", "cloown"]) for _ in range(12)) for _ in range(300)]
    with_it = [MODEL.score(t) for t in texts]
    monkeypatch.setattr(toxicity.Model, "may_hit", lambda self, word: True)
    assert [MODEL.score(t) for t in texts] == with_it and max(with_it) > 0.5 > min(with_it)
