"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier on letter trigrams predicts each of its bits. The classifiers are
log ratios of trigram shares, from counts over all labelled rows (summed by Spark; the model is a table of languages
by buckets, whatever the corpus). Decoding weighs each bit's loss by how well that bit tells the languages apart,
takes the codeword of least loss, and flags a text as ambiguous where the next one is close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, UNKNOWN = 8192, "und"
#: Trigrams beyond so many add no certainty; a loss closer than this to the least is ambiguous.
ENOUGH, CLOSE = 40, 0.7
_SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_letter = regex.compile(r"\p{L}").search


def trigrams(text: str) -> np.ndarray:
    """Counts by bucket of the three-byte strings of the text's words, A-Z in lower case."""
    b = np.frombuffer(b" " + text.encode().translate(_SEPARATE) + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * 0x9E3779B1 ^ b[1:-1] * 0x85EBCA77 ^ b[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
    return np.bincount((h >> 11)[b[1:-1] != 32] % BUCKETS, minlength=BUCKETS)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: every split of the languages for up to 5, else of many seeded matrices the one whose nearest rows are farthest apart."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 5:
        splits = range(1, 1 << (n - 1))
        return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(n)], float)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7), None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, bits))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        apart = ((m.shape[1] - m @ m.T) / 2 + np.eye(n) * bits).min()
        if best is None or apart > best[0]:
            best = apart, m
    return best[1]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray  #: languages by bits
    weights: np.ndarray  #: buckets by bits
    worth: np.ndarray  #: of each bit, adding up to 1

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Rows of counts by languages: the weighted logistic loss of each codeword."""
        n = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        margin = counts @ self.weights / n * np.minimum(n, ENOUGH)
        return np.einsum("b,rlb->rl", self.worth, np.logaddexp(0, -self.code[None] * margin[:, None, :])) * len(self.worth)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a label. No such rows: a model without languages, which calls every text unknown.

    Null texts and null labels aren't learned from; repeated rows count as they come; texts are read whole. Only the two
    columns are read, so others may have any names. The model is as large as there are distinct labels, so labels have
    to be names of languages, not free text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, of in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[of] = sums.get(of, 0) + trigrams(t.as_py())
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "counts"])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    summed = labelled.mapInArrow(count, "lang string, counts array<long>").select("lang", F.posexplode("counts").alias("bucket", "n")).filter("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()  # BUCKETS rows for each language at most
    langs = tuple(sorted(rows["lang"].unique()))
    counts = np.zeros((len(langs), BUCKETS))
    counts[[langs.index(x) for x in rows["lang"]], rows["bucket"].to_numpy(int)] = rows["n"].to_numpy(float)
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if langs else counts
    code = codewords(len(langs))
    if code.shape[1] == 0:
        return Model(langs, code, np.zeros((BUCKETS, 0)), np.zeros(0))
    one, other = ((code == s).astype(float) for s in (1, -1))
    weights = np.log((share.T @ one) / one.sum(axis=0)) - np.log((share.T @ other) / other.sum(axis=0))
    worth = ((share @ weights) * code).min(axis=0).clip(1e-3)
    return Model(langs, code, weights, worth / worth.sum())


def predict(text: str | Column, model: Model) -> Column:
    """A struct for a column of texts: lang_pred, score (0 to 1), ambiguous. Null and letterless texts are unknown, with score 0."""

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def of(texts: pa.Array) -> pa.Array:
        langs, scores, unsure = [], [], []
        for at in range(0, len(texts), 256):
            part = [t.as_py() for t in texts[at : at + 256]]
            known = [t is not None and bool(model.langs) and _letter(t) is not None for t in part]
            counts = np.array([trigrams(t) if k else np.zeros(BUCKETS, int) for t, k in zip(part, known, strict=True)], float)
            loss = model.losses(counts) if len(model.langs) > 1 else np.zeros((len(part), max(1, len(model.langs))))
            order = np.sort(loss, axis=1)
            odds = np.exp(order[:, :1] - loss).sum(axis=1)
            for i, k in enumerate(known):
                langs.append(model.langs[int(loss[i].argmin())] if k else UNKNOWN)
                scores.append(float(1 / odds[i]) if k else 0.0)
                unsure.append(bool(k and order.shape[1] > 1 and order[i, 1] - order[i, 0] < CLOSE))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], ["lang_pred", "score", "ambiguous"])

    return of(text)
