"""Disguises with signs last or alone, doubled letters and uneven spacing; lexicon entries rarer than 20,000 other features."""

import random

import pytest
from test_free import docs

from spanscan.llm import toxicity

COUNTS = toxicity._symbol_counts(("the cat sat on the mat and the dog was good to all of them in the hall seen too " * 50).encode())
MODEL = toxicity.Model(toxicity.char_model(COUNTS, ("idiot", "moron", "clown", "stupid", "worthless", "ass", "idiót")), {w: 0.9 for w in (b"idiot", b"moron", b"stupid", b"worthless", b"ass", "idiót".encode())})


@pytest.mark.parametrize("text", ["you 1d107", "idio7", "idi07 here", "worthle55", "a$$", "@$$", "@55", "moronn", "stuupid", "an i  d \n i\to t", "i d i ó t", "such an id iot", "a s s"])
def test_found(text):
    assert MODEL.score(text) > 0.5


@pytest.mark.parametrize("text", ["all good", "seen in 2024 too!", "a (b) c", "$$ 100 %", "the hall", "to on", "", " ", "1", "!" * 5_000, "éé"])
def test_left_alone(text):
    assert MODEL.score(text) < 0.05


def test_rare_marks_are_candidates(spark):
    rng = random.Random(5)
    common = [f"{rng.randrange(10**9):09d}".translate(str.maketrans("0123456789", "bcdfghjkmp")) for _ in range(5_000)]
    rows = [(i, " ".join(common) + (" zqxwv" if i < 4 else "")) for i in range(8)] + [(i, " ".join(common)) for i in range(8, 16)]
    # unlike tails, so that the toxic rows aren't near copies
    rows = [(i, t + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(4_000))) for i, t in rows]
    labels = spark.createDataFrame([(i, int(i < 8)) for i, _ in rows], "doc_id long, toxic int")
    assert b"zqxwv" in toxicity.fit(docs(spark, rows), labels).words
