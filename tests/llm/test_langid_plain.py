"""Trigram counts, bit classifiers and loss-weighted decoding of languages, worked out again by plain loops."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanscan.llm import langid

ROWS = [
    ("en", "The cat sat on the mat. the THE"), ("en", "a dog and the house"), ("de", "der Hund und die Katze"), ("de", "das Haus über dem Fluss"), ("fr", "le chat et la maison"),
    ("fr", "l'été est là"), ("es", "el perro y la casa"), ("es", "niño, mañana"), ("en", ""), (None, "not learned"), ("de", None), ("en", "a dog and the house"),
]


def plain_trigrams(text):
    lowered = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in b" " + text.encode() + b" "]
    out = Counter()
    for x, y, z in zip(lowered, lowered[1:], lowered[2:]):
        if y != 32:
            h = (x * 0x9E3779B1 & 0xFFFFFFFF) ^ (y * 0x85EBCA77 & 0xFFFFFFFF) ^ (z * 0xC2B2AE3D & 0xFFFFFFFF)
            out[(h >> 11) % langid.BUCKETS] += 1
    return out


def plain_losses(text):
    """The loss of each language's codeword, from counts of the rows above."""
    counts = {}
    for lang, t in ROWS:
        if lang is not None and t is not None:
            counts.setdefault(lang, Counter()).update(plain_trigrams(t))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    share = lambda x, g: (counts[x][g] + 0.5) / total[x]
    code = {x: [1 if (s >> i) & 1 else -1 for s in range(1, 1 << (len(langs) - 1))] for i, x in enumerate(langs)}
    bits = range(len(code[langs[0]]))
    side = lambda b, s: [x for x in langs if code[x][b] == s]
    mean = lambda b, s, g: sum(share(x, g) for x in side(b, s)) / len(side(b, s))
    weight = [[math.log(mean(b, 1, g)) - math.log(mean(b, -1, g)) for g in range(langid.BUCKETS)] for b in bits]
    worth = [max(1e-3, min(code[x][b] * sum(share(x, g) * weight[b][g] for g in range(langid.BUCKETS)) for x in langs)) for b in bits]
    worth = [w / sum(worth) for w in worth]

    def losses(t):
        grams = plain_trigrams(t)
        n = max(1, sum(grams.values()))
        margin = [sum(k * weight[b][g] for g, k in grams.items()) / n * min(n, langid.ENOUGH) for b in bits]
        return {x: sum(worth[b] * math.log1p(math.exp(-code[x][b] * margin[b])) for b in bits) * len(worth) for x in langs}

    return losses(text)


def test_languages_by_plain_loops(spark):
    model = langid.fit(spark.createDataFrame(ROWS, "lang string, text string").repartition(3))
    assert model.langs == ("de", "en", "es", "fr")
    texts = ["the cat and the dog", "die Katze", "niño", "l'été", "der the el le", "x", "Ünter THE", None, "", "12 34 !"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", langid.predict("t", model).alias("p")).select("t", "p.*").collect()
    for r in got:
        if r["t"] is None or not any(c.isalpha() for c in r["t"]):
            assert (r["lang_pred"], r["score"]) == (langid.UNKNOWN, 0.0)
            continue
        loss = plain_losses(r["t"])
        order = sorted(loss.values())
        assert loss[r["lang_pred"]] == pytest.approx(order[0], abs=1e-9)
        assert r["score"] == pytest.approx(1 / sum(math.exp(order[0] - x) for x in order), abs=1e-9) and r["ambiguous"] == (order[1] - order[0] < langid.CLOSE)


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(ROWS * 5, "lang string, text string")
    a, b = langid.fit(df.coalesce(1)), langid.fit(df.repartition(7, F.rand(1)))
    assert a.langs == b.langs and (a.weights == b.weights).all() and (a.worth == b.worth).all()
