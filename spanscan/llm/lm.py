"""Language-model scores from a Brown class-based bigram model.

P(text) is the product over its tokens of P(class | class before) * P(word | class). The classes of the whole
vocabulary are found in two steps. Exchange clustering assigns the most frequent words: in turn, each moves to the
class where the likelihood of the corpus's bigrams is highest. Every further word that occurs twice or more then goes
to the class where the likelihood of its own bigrams with those words is highest, from counts that Spark aggregates
word by word. Both numbers, of clustered words and of classes, grow with the vocabulary. Words that occur once, and
those that the training split doesn't have, share classes by their shape, so that unseen words are scored like those
seen once. All counts are of the whole training split.

The HEAD most frequent words, with their classes, go to every executor; what a text has of other words is looked up by
a join. That is a matter of where a word is looked up, not of its class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

HEAD, ROUNDS = 200_000, 4
#: Weights of the smoothing: of a class's own share in transitions, and of an unseen word in emissions.
BACK_OFF, UNSEEN = 10.0, 0.5
#: The end of a text is counted under a text that no word can be.
END = b" "
#: Lengths in bytes up to which shapes go; each is split by whether the last byte is a letter, digit or not ASCII.
LENGTHS = (3, 6, 9, 13)
SHAPES = 2 * (len(LENGTHS) + 1)
#: Entries that a task counts before it gives the counts away.
KEPT_WORDS, KEPT_PAIRS = 200_000, 1_000_000


def clustered(distinct: int) -> int:
    """How many words are clustered by exchange: twice the square root of the vocabulary, so that their bigrams grow with it and not with its square."""
    return int(np.ceil(2 * np.sqrt(distinct)))


def classes_for(distinct: int) -> int:
    """How many classes they go to: the cube root of the vocabulary."""
    return int(np.ceil(np.cbrt(distinct)))


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, and the end."""
    return [*(text or "").encode().lower().split(), END]


def shape(word: bytes) -> int:
    return 2 * sum(len(word) > n for n in LENGTHS) + (word[-1] >= 128 or word[-1:].isalnum())


def shape_of(word: Column) -> Column:
    """As `shape`, for a binary column."""
    size, last = F.octet_length(word), F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int")
    plain = (last >= 128) | last.between(48, 57) | last.between(65, 90) | last.between(97, 122)
    return 2 * sum(((size > n).cast("int") for n in LENGTHS), F.lit(0)) + plain.cast("int")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), n, of all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > KEPT_WORDS:
                    yield give()
                    seen.clear()
        yield give()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def neighbours(docs: DataFrame, seeds: list[bytes], text: str = "text") -> DataFrame:
    """word, beside (twice the number of each seed word beside it, and one more where the seed comes after), n (how often): bigrams with a seed on one side at least, as lists; a word comes once from each task or more often. An end stands before each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of, words = len(seeds), {w: i for i, w in enumerate(seeds)}, list(seeds)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held, size = [], 0

        def add() -> None:
            ids = np.concatenate(held)
            left, right = ids[:-1], ids[1:]
            use = ((left < first) | (right < first)) & (left >= 0) & (right >= 0)
            seen.append(np.unique(left[use] << 32 | right[use], return_counts=True))
            held.clear()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*seen, strict=True)) if seen else (np.empty(0, np.int64),) * 2
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.empty(0, np.int64)
            return pairs[starts], np.add.reduceat(n[order], starts) if len(pairs) else n

        def give() -> pa.RecordBatch:
            packed, n = merged()
            left, right = packed >> 32, packed & 0xFFFFFFFF
            out, into = right < first, right >= first  # of two seeds, the one before counts as the word
            at, code, m = np.concatenate((left[out], right[into])), np.concatenate((right[out] * 2 + 1, left[into] * 2)), np.concatenate((n[out], n[into]))
            order = np.argsort(at, kind="stable")
            which, starts = np.unique(at[order], return_index=True)
            ends = pa.array(np.append(starts, len(at)), pa.int32())
            cols = [pa.array(words, pa.binary()).take(pa.array(which)), *(pa.ListArray.from_arrays(ends, pa.array(c[order], pa.int32())) for c in (code, m))]
            seen.clear()
            for x in words[first:]:
                del of[x]
            del words[first:]
            return pa.RecordBatch.from_arrays(cols, ["word", "beside", "n"])

        for batch in batches:
            for t in batch.column(0):
                w = tokens(t.as_py())
                for x in w:
                    if x not in of:
                        of[x] = len(of)
                        words.append(x)
                held.append(np.array([-1, of[END], *map(of.__getitem__, w)], np.int64))  # -1 parts texts
                size += len(w)
                if size > 1 << 18:
                    add()
                    size = 0
                    if sum(len(p) for p, _ in seen) > 2 * KEPT_PAIRS:
                        seen[:] = [merged()]
                        if len(seen[0][0]) > KEPT_PAIRS:
                            yield give()
        if held:
            add()
        yield give()

    return docs.select(text).mapInArrow(count, "word binary, beside array<int>, n array<int>")


def exchange(before: np.ndarray, after: np.ndarray, count: np.ndarray, n: int, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each of n words, from the bigrams of these (before, after, count). Words start in turn by frequency and then move, one at a time, to where the likelihood is highest."""
    k = max(1, min(classes, n))
    of = np.arange(n) % k
    between = np.zeros((k, k))
    np.add.at(between, (of[before], of[after]), count)
    f = lambda x: x * np.log(np.maximum(x, 1))

    def beside(of_word: np.ndarray, other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(of_word, kind="stable")
        cuts = np.searchsorted(of_word[order], np.arange(1, n))
        return list(zip(np.split(other[order], cuts), np.split(count[order].astype(float), cuts), strict=True))

    after_of, before_of = beside(before, after), beside(after, before)
    for _ in range(rounds if k > 1 else 0):
        moved = 0
        for w in range(n):
            (right, right_n), (left, left_n) = after_of[w], before_of[w]
            out, into = np.bincount(of[right], right_n, k), np.bincount(of[left], left_n, k)
            own, was = right_n[right == w].sum(), of[w]
            out[was] -= own
            into[was] -= own
            between[was] -= out
            between[:, was] -= into
            between[was, was] -= own
            rows, cols, diagonal = between.sum(axis=1), between.sum(axis=0), between.diagonal()
            o, i = np.flatnonzero(out), np.flatnonzero(into)  # other cells don't change, wherever the word goes
            a, b = f(between[:, o] + out[o]) - f(between[:, o]), f(between[i] + into[i, None]) - f(between[i])
            gain = a.sum(axis=1) + b.sum(axis=0) + f(diagonal + out + into + own) - f(diagonal + out) - f(diagonal + into) + f(diagonal)
            gain -= f(rows + out.sum() + own) - f(rows) + f(cols + into.sum() + own) - f(cols)
            to = int(gain.argmax())
            if gain[to] <= gain[was] + 1e-6:
                to = int(was)
            moved += to != was
            of[w] = to
            between[to] += out
            between[:, to] += into
            between[to, to] += own
        if not moved:
            break
    return of


def transitions(between: np.ndarray) -> np.ndarray:
    """log10 P(class | class before): counts, backing off to the class's share."""
    share = (between.sum(axis=0) + 1) / (between.sum() + len(between))
    return np.log10((between + BACK_OFF * share) / (between.sum(axis=1, keepdims=True) + BACK_OFF))


def likeliest(between: np.ndarray) -> np.ndarray:
    """For a class after a word, and then for each before one: the log probabilities of it under each class that the word may go to."""
    before = (between + 1e-3) / (between.sum(axis=0) + len(between) * 1e-3)
    return np.concatenate((transitions(between).T, np.log10(before)))


def nearest(between: np.ndarray, of: np.ndarray):
    """A function of lists of neighbours as `neighbours` gives them: the class under which they are likeliest."""
    k, worth = len(between), likeliest(between)

    @F.arrow_udf("int")
    def best(besides: pa.Array, counts: pa.Array) -> pa.Array:
        code, n, sizes = besides.flatten().to_numpy(), counts.flatten().to_numpy(), besides.value_lengths().to_numpy(zero_copy_only=False)
        column, ends, out = of[code >> 1] + k * (1 - (code & 1)), np.concatenate(([0], np.cumsum(sizes))), []
        for at in range(0, len(sizes), 1024):
            m = min(1024, len(sizes) - at)
            part = slice(ends[at], ends[at + m])
            row = np.repeat(np.arange(m), sizes[at : at + m])
            out.append((np.bincount(row * 2 * k + column[part], n[part], m * 2 * k).reshape(m, 2 * k) @ worth).argmax(axis=1))
        return pa.array(np.concatenate(out or [np.empty(0, int)]).astype(np.int32))

    return best


def _least_count(counts: DataFrame, most: int) -> int:
    """The count from which there are `most` words or fewer, to within a sixteenth of an octave."""
    step = F.floor(F.log2("n") * 16)
    least, held = None, 0
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():  # 1,024 at most
        if held + r["words"] > most:
            return least if held else (1 << 62)
        held, least = held + r["words"], r["least"]
    return least or 1


@dataclass(frozen=True)
class Model:
    """What the training split says, and its words with their counts and classes."""

    total: int  #: tokens
    distinct: int
    classes: int  #: of clustered and assigned words; those of shapes come after
    words: DataFrame | None  #: word, n, class
    class_total: np.ndarray  #: tokens in each class
    class_distinct: np.ndarray

    def emitted(self, n, of):
        """log10 P(word | class) of words counted n times: counts with UNSEEN added, one unseen word in each class."""
        return np.log10((n + UNSEEN) / (self.class_total[of] + UNSEEN * (self.class_distinct[of] + 1)))


def fit(docs: DataFrame, text: str = "text", words: int | None = None, classes: int | None = None) -> Model:
    """A model of all rows of docs. words, classes: clustered words and their classes, where these aren't to follow from the vocabulary."""
    counts = written(word_counts(docs, text), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = clustered(distinct) if words is None else words
    top = counts.filter(F.col("n") >= _least_count(counts, most)).orderBy(F.desc("n"), "word").collect() if distinct else []
    seeds = [bytes(r["word"]) for r in top]
    if END not in seeds:
        seeds.append(END)
    beside = written(neighbours(docs, seeds, text), "neighbours")
    spark = docs.sparkSession
    named = F.broadcast(spark.createDataFrame(pa.table({"word": pa.array(seeds, pa.binary()), "seed": pa.array(range(len(seeds)), pa.int32())})))
    pairs = beside.join(named, "word").select("seed", F.explode(F.arrays_zip("beside", "n")).alias("b")).groupBy("seed", "b.beside").agg(F.sum("b.n").alias("n")).toArrow()  # bigrams of two clustered words
    before, after, n = pairs["seed"].to_numpy().astype(np.int64), pairs["beside"].to_numpy().astype(np.int64) >> 1, pairs["n"].to_numpy()
    of = exchange(before, after, n, len(seeds), classes_for(distinct) if classes is None else classes)
    k = int(of.max()) + 1
    between = np.zeros((k, k))
    np.add.at(between, (of[before], of[after]), n)
    again = counts.filter("n > 1").select("word")
    lists = beside.join(named, "word", "left_anti").join(again, "word", "left_semi").groupBy("word").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("beside", "n")])
    placed = lists.select("word", nearest(between, of)("beside", "n").alias("class"))
    chosen = spark.createDataFrame(pa.table({"word": pa.array(seeds, pa.binary()), "class": pa.array(of.astype(np.int32))}))
    every = counts.join(placed.unionByName(chosen), "word", "left").select("word", "n", F.coalesce("class", F.lit(k) + shape_of(F.col("word"))).alias("class"))
    every = written(every, "classes")
    class_total, class_distinct = np.zeros(k + SHAPES), np.zeros(k + SHAPES)
    for r in every.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():  # classes
        class_total[r["class"]], class_distinct[r["class"]] = r["n"], r["m"]
    return Model(total, distinct, k, every, class_total, class_distinct)


LOCAL = "n_tokens long, n_known long, base_score double, emitted double, classes binary, rare array<struct<word:binary,slot:int,n:long>>"


def _local(texts: pa.Array, m: Model, head: dict[bytes, int], counts: np.ndarray, of: np.ndarray) -> pa.Array:
    """What can be said with the frequent words alone; the classes of all tokens (-1 less a slot: not known yet), and the other words by slot."""
    base = np.log10((counts + 1) / (m.total + m.distinct + 1))
    emission = m.emitted(counts, of)
    rows = []
    for t in texts:
        w = tokens(t.as_py())
        slots: dict[bytes, int] = {}
        ids = np.fromiter((head[x] if x in head else -1 - slots.setdefault(x, len(slots)) for x in w), np.int64, len(w))
        known = ids[ids >= 0]
        classes = np.where(ids >= 0, of[ids.clip(0)], ids) if len(of) else ids
        many = np.bincount(-1 - ids[ids < 0], minlength=len(slots)).tolist()
        rows.append((len(w), len(known), float(base[known].sum()), float(emission[known].sum()), classes.astype(np.int32).tobytes(), [{"word": x, "slot": i, "n": n} for (x, i), n in zip(slots.items(), many, strict=True)]))
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("slot", pa.int32()), ("n", pa.int64())]))]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["n_tokens", "n_known", "base_score", "emitted", "classes", "rare"])


def _settled_classes(classes: pa.Array, slots: pa.Array) -> Iterator[np.ndarray]:
    """The classes of each row's tokens, those of the slots filled in."""
    for c, s in zip(classes, slots, strict=True):
        c = np.frombuffer(c.as_py(), np.int32)
        if s.is_valid:
            of = np.empty(len(s), np.int32)
            of[s.values.field("slot").to_numpy(zero_copy_only=False)] = s.values.field("class").to_numpy(zero_copy_only=False)
            c = np.where(c < 0, of[(-1 - c).clip(0)], c)
        yield c


SCORES = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def score(docs: DataFrame, training: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), head: int = HEAD, words: int | None = None, classes: int | None = None) -> DataFrame:
    """A row for each row of docs: `keep`, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    training: a condition on docs; rows where it holds are learned from. Null and empty texts are an end alone.
    Repeated rows are scored alike. With nothing to learn from, no word is known and scores are those of an untrained
    model; an empty table gives no rows. Very long texts are scored whole. A kept column that is named like one of the
    scores comes back with `_kept` after its name.
    """
    m = fit(docs.filter(F.coalesce(training, F.lit(False))).select(F.col(text).alias("text")), words=words, classes=classes)
    top = m.words.filter(F.col("n") >= _least_count(m.words, head)).toArrow() if m.distinct else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "class": pa.array([], pa.int32())})
    frequent, counts, of = {w: i for i, w in enumerate(top["word"].to_pylist())}, top["n"].to_numpy(), top["class"].to_numpy()
    alone = replace(m, words=None)  # what tasks need of the model
    local = F.arrow_udf(lambda texts: _local(texts, alone, frequent, counts, of), LOCAL)
    kept = F.struct(*[F.col(c).alias(c if c.lower() not in SCORES else f"{c}_kept") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = written(docs.select(kept.alias("kept"), F.coalesce(training, F.lit(False)).alias("learned"), F.monotonically_increasing_id().alias("row"), local(text).alias("s")).select("kept", "learned", "row", "s.*"), "lm-rows")
    size, k = m.classes + SHAPES, m.classes
    seen = rows.select("row", F.explode("rare").alias("w")).select("row", "w.*").join(m.words.withColumnRenamed("n", "c"), "word", "left")
    seen = seen.select("row", "slot", "n", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(k) + shape_of(F.col("word"))).alias("class"))
    totals, kinds = F.array(*[F.lit(float(x)) for x in m.class_total]), F.array(*[F.lit(float(x)) for x in m.class_distinct])
    emitted = F.log10((F.col("c") + UNSEEN) / (F.get(totals, F.col("class")) + UNSEEN * (F.get(kinds, F.col("class")) + 1)))
    base = F.log10((F.col("c") + 1) / F.lit(float(m.total + m.distinct + 1)))
    rare = seen.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("r_known"), F.sum(F.col("n") * base).alias("r_base"), F.sum(F.col("n") * emitted).alias("r_emitted"), F.collect_list(F.struct("slot", "class")).alias("slots"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    whole = written(rows.drop("rare").join(rare, "row", "left").select("kept", "learned", "n_tokens", "classes", "slots", plus("n_known", "r_known"), plus("base_score", "r_base"), plus("emitted", "r_emitted")), "lm-classes")
    start = end_class(m)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for c in _settled_classes(batch.column(0), batch.column(1)):
                np.add.at(total, np.concatenate(([start], c[:-1])).astype(np.int64) * size + c, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    between = np.zeros(size * size)
    for r in whole.filter("learned").select("classes", "slots").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # classes squared
        between[r["at"]] = r["n"]
    to = transitions(between.reshape(size, size))

    @F.arrow_udf("double")
    def moved(classes: pa.Array, slots: pa.Array) -> pa.Array:
        return pa.array([float(to[np.concatenate(([start], c[:-1])), c].sum()) for c in _settled_classes(classes, slots)], pa.float64())

    out = whole.select("kept.*", "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", (F.col("emitted") + moved("classes", "slots")).alias("score"))
    out = out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return out if keep else out.drop("none")


def end_class(m: Model) -> int:
    """The class of the end, from which every text starts."""
    found = m.words.filter(F.col("word") == F.lit(bytearray(END))).select("class").first()
    return found["class"] if found else m.classes + shape(END)
