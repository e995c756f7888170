"""Toxicity of texts behind a noisy channel.

Words may come disguised: digits and signs for letters, letters drawn out, separators or spaces between them. Each
suspect word is a lattice of characters; a Viterbi search under a character language model of the corpus finds the
likeliest plain word. Plain and restored words are then scored with a lexicon of words and word beginnings learned
from labelled rows. Words without a sign, a separator between letters or a doubled letter have a lattice of one path
and are taken as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import settled

#: The letters that a sign may stand for, and the separators that may stand between letters.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e"}
BETWEEN = ".-_*~'`,:;/\\^#=​‌‍­"
#: Costs in nats of a sign for a letter, a separator left out, a repeated letter left out, and a sign left out.
SIGN, SEPARATOR, REPEAT, LOST = 1.0, 0.3, 1.2, 6.0
#: Labelled rows that the lexicon is fitted on at most, by the order of a hash of their id.
SAMPLE = 20_000
#: Toxic rows that a feature of the lexicon is in at least: so many, and this share of them.
LEAST, LEAST_SHARE = 4, 0.005
#: Features that a task counts before it gives the counts away.
KEPT_FEATURES = 200_000
#: Toxic rows for each clean one that a feature of the lexicon has, at least.
MARKS = 8
#: Symbols of the character model: 0 between words, 1-26 letters, 27 all else. Word beginnings of these lengths in bytes are features.
SYMBOLS, STEMS = 28, (4, 5, 6, 7, 8)
_SYMBOL = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256))
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_ASCII_SIGNS, _MARKS = (frozenset(ord(c) for c in of if ord(c) < 128) for of in (SIGNS, BETWEEN))
#: Kinds of byte: a letter, s sign for a letter, 1 separator, blank white space, o other.
_KINDS = bytes(ord("a") if chr(b).isalpha() and b < 128 or b >= 128 else 32 if b in _SPACE else ord("s") if b in _ASCII_SIGNS else ord("1") if b in _MARKS else ord("o") for b in range(256))
#: A sign anywhere, with the rest of its word; separators with letters on both sides, or at a word's start before two letters.
_MARKED = re.compile(rb"s[^ ]*|1(?:(?<=a1)1*a|(?<= 1)1*aa)")
#: Marks and doubled letters outside ASCII: rare, so texts that hold one are searched with the slower pattern.
_WIDE_MARKS = re.compile("[" + re.escape("".join(c for c in (*SIGNS, *BETWEEN) if ord(c) >= 128)) + r"]|([^\W\d_\x00-\x7f])\1")


def char_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each symbol comes after two others, in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            for lo in range(0, len(texts), 64):
                total += _symbol_counts(b"  ".join(t.encode() for t in texts[lo : lo + 64] if t))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(SYMBOLS**3)
    for at, n in docs.select(text).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # SYMBOLS ** 3 at most
        counts[at] = n
    return counts


def char_model(counts: np.ndarray, lexicon: tuple[str, ...] = ()) -> np.ndarray:
    """Log probabilities of a symbol after two others; each word of a lexicon counts as a ten-thousandth of the corpus."""
    for w in lexicon:
        counts = counts + _symbol_counts(w.encode()) * (1 + counts.sum() * 1e-4)
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = counts.sum(axis=0)
    back = (two + 0.5) / (two + 0.5).sum(axis=-1, keepdims=True)
    return np.log((counts + 5 * back[None]) / (counts.sum(axis=-1, keepdims=True) + 5))


def _symbol_counts(raw: bytes) -> np.ndarray:
    """Counts of three symbols in a row, but for those that end in two breaks between words."""
    s = np.frombuffer((b"  " + raw + b" ").translate(_SYMBOL), np.uint8).astype(np.uint16)
    n = np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    n.reshape(SYMBOLS, -1)[:, 0] = 0
    return n


def lattice(word: str, repeats: bool = True) -> list[list[tuple[str, float]]]:
    """For each character what it may have been, with its cost: a letter, or nothing. Without `repeats`, doubled characters stay."""
    out: list[list[tuple[str, float]]] = []
    w = word.lower()
    for i, c in enumerate(w):
        if c in SIGNS:
            out.append([*((x, SIGN) for x in SIGNS[c]), ("", LOST)])
        elif c.isalpha():
            out.append([(c, 0.0)])
        else:
            out.append([("", SEPARATOR if c in BETWEEN else LOST)])
        if repeats and i and c == w[i - 1] and out[-1][0][0]:
            out[-1].append(("", REPEAT))
    return out


def decode(word: str, model: np.ndarray, repeats: bool = True) -> str:
    """The likeliest plain word: Viterbi over the lattice, the state being the last two symbols."""
    symbol = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(word, repeats):
        now: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for c, cost in options:
                if c:
                    s = symbol(c)
                    state, value, way = (b, s), score - cost + model[a, b, s], (path, c)
                else:
                    state, value, way = (a, b), score - cost, path
                if state not in now or value > now[state][0]:
                    now[state] = value, way
        best = now
    _, path = max(((score + model[a, b, 0], path) for (a, b), (score, path) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def readings(word: str, model: np.ndarray) -> tuple[bytes, ...]:
    """The likeliest plain word, and where characters are doubled, the likeliest that keeps them so."""
    best, low = decode(word, model), word.lower()
    if not any(a == b for a, b in zip(low, low[1:], strict=False)):
        return (best.encode(),)
    return best.encode(), (low if low.isalpha() else decode(word, model, False)).encode()


@dataclass(frozen=True)
class Model:
    chars: np.ndarray
    words: dict[bytes, float]  #: the chance that a text with this feature is toxic
    base: float = 0.01

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        read = lru_cache(maxsize=REMEMBERED)(lambda w: readings(w, self.chars))
        put("restored", lambda w: read(w) if len(w) <= SHORT else readings(w, self.chars))
        put("whole", frozenset(w for w in self.words if w[0] != MANY[0] and w[0] != START[0]))
        put("starts", frozenset(w.lstrip(MANY + START)[: STEMS[0]] for w in self.words if w[0] in MANY + START))
        put("single", (frozenset(map(_collapsed, self.whole)), frozenset(map(_collapsed, self.starts))))

    def __reduce__(self):
        return Model, (self.chars, self.words, self.base)

    def may_hit(self, word: str) -> bool:
        """Whether a reading of a word may be in the lexicon. Readings of a word of ASCII letters alone differ in how often letters are repeated, so with repeats taken out, all are the same."""
        low = word.lower()
        if not (low.isascii() and low.isalpha()):
            return True
        c, (whole, starts) = _collapsed(low.encode()), self.single
        return c in whole or any(c[:k] in starts for k in range(1, STEMS[0] + 1))

    def score(self, text: str | None) -> float:
        """Each feature of the lexicon that the text has is a cause of its own: noisy or."""
        words, read = words_of(text or "", self.restored, self.whole, self.may_hit)
        found = self.words.keys() & words.union(*(new for _, new in read))
        stems = [w for w in words if w[: STEMS[0]] in self.starts]
        also = [(w, some) for w, new in read if (some := {x for x in new if x[: STEMS[0]] in self.starts})]
        clean = 1 - self.base
        for w in sorted(found | (self.words.keys() & beginnings(stems, also)) if stems or also else found):
            clean *= 1 - self.words[w]
        return 1 - clean


#: Words whose readings a worker remembers, and their length at most; longer ones are decoded each time.
REMEMBERED, SHORT = 30_000, 48
#: What features that aren't whole words start with: a beginning, and one that several distinct words of the text have.
START, MANY = b"^", b"+"


def suspects(text: str, split: list[str]) -> tuple[list[str], list[str]]:
    """Words with a sign, a separator between letters or a doubled letter, and runs of single characters, drawn together. split: the text's words."""
    raw = b" " + text.encode() + b" "
    kinds, low = raw.translate(_KINDS), np.frombuffer(raw.translate(_LETTERS), np.uint8)
    at = [m.start() for m in _MARKED.finditer(kinds)]
    at += np.flatnonzero((low[1:] == low[:-1]) & (low[1:] > 32) & (low[1:] < 128)).tolist()
    words = {(kinds.rfind(b" ", 0, i + 1) + 1, kinds.find(b" ", i + 1)) for i in at}
    found = {raw[lo:hi] for lo, hi in words}
    out = [w.decode() for w in sorted(found)]
    if not text.isascii() and _WIDE_MARKS.search(text.lower()):
        out += [w for w in split if not w.isascii() and _WIDE_MARKS.search(w.lower()) and w.encode() not in found]
    spaced, run, last = [], [], -2
    for i in [i for i, w in enumerate(split) if len(w) == 1]:
        if i != last + 1:
            spaced.append("".join(run))
            run = []
        run.append(split[i])
        last = i
    spaced.append("".join(run))
    return out, [w for w in spaced if len(w) > 1]


def _collapsed(word: bytes) -> bytes:
    return re.sub(rb"(.)\1+", rb"\1", word, flags=re.DOTALL)


def words_of(text: str, restore, whole: frozenset[bytes] = frozenset(), may_hit=None) -> tuple[set[bytes], list[tuple[bytes, set[bytes]]]]:
    """The distinct words of a text, A-Z in lower case, and for each suspect word what it reads as besides. In runs of single characters, words of the lexicon are looked for anywhere, and among any two words in a row drawn together."""
    plain = text.encode().translate(_LETTERS).split()
    words = set(plain)
    if whole:
        words |= {w for w in map(bytes.__add__, plain, plain[1:]) if len(w) > 3} & whole
    disguised, spaced = suspects(text, text.split())
    if may_hit:  # words none of whose readings can count aren't decoded
        disguised = list(filter(may_hit, disguised))
    read, seen = [], set(words)
    for i, w in enumerate(disguised + spaced):
        readings = set(restore(w))
        if i >= len(disguised):
            readings.update(x for x in whole if len(x) > 3 and any(x in r for r in readings))
        if new := readings - seen:
            seen |= new
            read.append((w.encode().translate(_LETTERS), new))
    return words, read


def beginnings(words, read=()) -> set[bytes]:
    """Of distinct words: their beginnings, and again those that two or more of them have. The readings of one word count once, and not where it begins so itself."""
    n = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    for word, new in read:
        n.update({w[:k] for w in new for k in STEMS if len(w) > k} - {word[:k] for k in STEMS if len(word) > k})
    return {START + w for w in n} | {MANY + w for w, m in n.items() if m > 1}


def features(text: str, restore) -> set[bytes]:
    words, read = words_of(text, restore)
    return words.union(*(new for _, new in read)) | beginnings(words, read)


def _sampled(labels: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """Up to `most` labelled ids. An id with several labels is toxic if one of them says so."""
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_label_key")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    return one.orderBy(F.xxhash64("_label_key"), "_label_key").limit(most)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model: the character model from all of `docs`, the lexicon from those with a label (`sample` of them at most).

    Of near copies among the toxic rows one counts, so that what a much copied text happens to say doesn't count as a
    mark. The lexicon has the features that many toxic rows have for each clean one, all of them.

    Null texts and rows with a null key or label aren't learned from. Ids may be of any type that both tables share.
    An id with several labels is toxic if one of them is 1; repeated rows of docs count as they come. With no labels or
    no documents the lexicon is empty and every text scores the base rate. Other columns may have any names.
    """
    chosen = settled(_sampled(labels, key, label, sample))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_label_key")).filter("_text is not null")
    counts = char_counts(docs, text)
    chars = char_model(counts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n, keep = Model(chars, {}), Counter(), 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch.column(0):
                n.update(features(t.as_py(), model.restored) - {b""})
                keep += 1
                if len(n) > KEPT_FEATURES:
                    yield give()
                    n.clear()
        n[b""] = keep
        yield give()

    counted = lambda df: settled(df.mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    seen, other = counted(_one_of_each(rows.filter("_toxic = 1")).select("_text")), counted(rows.filter("_toxic <> 1").select("_text"))
    texts = lambda df: sum(r["n"] for r in df.filter(F.col("word") == F.lit(b"")).collect())
    n_toxic, n_clean = texts(seen), texts(other)
    least = max(LEAST, int(n_toxic * LEAST_SHARE))
    rate = n_toxic / max(1, n_toxic + n_clean)
    doubt = min(1.0, n_toxic / 150)  # rows that might be clean and have the feature, though none was seen
    bad = seen.filter((F.col("n") >= least) & (F.col("word") != F.lit(b""))).join(other.withColumnRenamed("n", "good"), "word", "left")
    against = F.coalesce("good", F.lit(0)) + F.lit(doubt)
    marks = bad.filter(F.col("n") >= MARKS * against).withColumn("chance", F.col("n") / (F.col("n") + against))
    lexicon = {bytes(r["word"]): r["chance"] for r in marks.select("word", "chance").collect()}  # features of the bounded sample's toxic rows
    whole = tuple(w.decode("utf-8", "ignore") for w in lexicon if w[:1] not in (START, MANY))
    return Model(char_model(counts, whole), lexicon, min(0.2, max(0.005, rate / 10)))


def _one_of_each(rows: DataFrame) -> DataFrame:
    """The rows of the bounded sample without near copies: a fingerprint for each labelled id, `sample` of them at most, is compared on the driver."""
    each = settled(rows.groupBy("_label_key").agg(F.min("_text").alias("_text")).select("_label_key", "_text", simhash.fingerprint("_text").alias("_fp")))
    first = settled(each.groupBy("_fp").agg(F.min("_label_key").alias("_first")))
    fps = np.array(sorted(r["_fp"] % (1 << 64) for r in first.select("_fp").collect()), np.uint64)
    copies = {x - (1 << 64) if x >> 63 else x for x, _ in simhash._linked(fps, 3)}
    kept = first.filter(~F.col("_fp").isin(list(copies))) if copies else first
    return each.join(F.broadcast(kept.select("_first")), F.col("_label_key") == F.col("_first"), "left_semi")


def score(text: str | Column, model: Model) -> Column:
    """The chance, 0 to 1, that a text is toxic. Null counts as empty, and empty texts have the least. Texts are read whole; equal texts score alike."""

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return of(text)
