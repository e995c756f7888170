"""Ranked search over a tiered index: high-impact postings first, lower ones only for what isn't proven yet.

The index is in segments of about SEGMENT words. In a segment, each term has a list of documents and impacts (how much
an occurrence of weight one adds to the score) for each tier. What a posting can add is its impact times the term's
weight: the first tier has the postings that add a large part of what the rarest term can add, the next the smaller
ones, and the last the rest. Terms that aren't among the HEAD most frequent ones are in the first tier whole.

A query looks at the first tier alone. What its terms' lower postings can still add is bounded for each term by the
highest impact there; the sum of these residual bounds is what a document that wasn't met can have at most, and a
document that was met lacks the bounds of its other terms only. An item whose k-th best sum is over the bound of all
that weren't met is proven: its candidates are the documents whose bound reaches the k-th best sum, and only these are
looked up in lower tiers, for their exact scores. All other items fall through to the next tier, and what is left after
the last has exact scores from the whole index. So the result is exact whatever the tiers are.

Items are a stated query set. They are taken in blocks of about BLOCK words, one at a time, so that neither the driver
nor a task holds more than a block's terms. A segment gives the best k for each item at most.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .decontam import words

#: Words of the corpus in a segment (and one document more at most), documents in it, and words of the items in a block.
SEGMENT, DOCUMENTS, BLOCK = 1 << 20, 1 << 13, 1 << 18
#: The most frequent terms, whose postings are dealt to tiers; what a tier's postings add at least, as parts of the most that any can.
HEAD, TIERS = 1 << 16, (1 / 8, 1 / 24, 0.0)
#: Items whose sums a task holds at once.
AT_ONCE = 256


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence of weight one adds: a millionth at a time, rounded down."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(n: int, df: int) -> int:
    """Of a term that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def stretch(n_words: np.ndarray, n: int, total: int) -> np.ndarray:
    """How much a document's length damps its impacts: 100 at the mean length."""
    return 75 + (25 * n_words.astype(np.int64) * n) // max(1, total)


@dataclass(frozen=True)
class Index:
    """documents: segment, nth (in order of the keys), key. postings: segment, tier, term, n, top (the highest impact), docs and impacts (little-endian 32-bit integers). terms: term, df."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int  #: documents with a term
    tiers: int


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df: how many documents hold each term; under no term (null) the documents with terms and all their terms, as df and total."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        n = total = 0

        def give(last: bool = False) -> pa.RecordBatch:
            terms, counts = [*df, *[None] * last], [*df.values(), *[n] * last]
            df.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(counts, pa.int64()), pa.array([0] * (len(terms) - last) + [total] * last, pa.int64())], ["term", "df", "total"])

        for batch in batches:
            for t in batch.column(0):
                if w := words(t.as_py()):
                    df.update(set(w))
                    n, total = n + 1, total + len(w)
                if len(df) > 200_000:
                    yield give()
        yield give(True)

    return docs.select(text).mapInArrow(count, "term binary, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _least_df(terms: DataFrame, most: int) -> int:
    """The df from which there are `most` terms or fewer."""
    step = F.floor(F.log2("df") * 16)
    least, held = 1 << 62, 0
    for r in terms.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("df").alias("least")).orderBy(F.desc("step")).collect():  # 1,024 at most
        if held + r["n"] > most:
            break
        held, least = held + r["n"], r["least"]
    return least


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", tiers: tuple[float, ...] = TIERS, head: int = HEAD) -> Index:
    """The index of all documents and all their terms, whole texts. A segment's rows are in order of the tiers, so that readers of some skip the pages of the others. Null texts have no terms; keys may be null, repeated and of any type that has an order.

    tiers: what a posting adds at least to be in each tier, as parts of what the rarest term can add; the last is 0.
    """
    counted = written(statistics(docs, text), "terms")
    all_ = counted.filter("term is null").first()
    n, total = (all_["df"], all_["total"]) if all_ else (0, 0)
    terms = counted.filter("term is not null").select("term", "df")
    few = terms.filter(F.col("df") >= _least_df(terms, head)).toArrow() if n else pa.table({"term": pa.array([], pa.binary()), "df": pa.array([], pa.int64())})
    frequent = {t: weight(n, d) for t, d in zip(few["term"].to_pylist(), few["df"].to_pylist(), strict=True)}  # HEAD at most
    most = weight(n, 1) * 1_000_000 if n else 0
    least = np.array([int(most * t) for t in tiers], np.int64)
    segment_words, segment_docs = SEGMENT, DOCUMENTS
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["segment", "tier", "nth", "key", "term", "n", "top", "docs", "impacts"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, segment, size, keys, held = None, None, 0, [], []
        ids: dict[bytes, int] = {}

        def give() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i]) if keys[i] is not None else (False,))
            none = lambda of, m: pa.nulls(m, of)
            m = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment] * m, pa.int64()), pa.array([-1] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([keys[i] for i in order], kind), none(pa.binary(), m), none(pa.int32(), m), none(pa.int32(), m), none(pa.binary(), m), none(pa.binary(), m)], names
            )
            lengths = np.array([len(held[i]) for i in order], np.int64)
            packed = np.concatenate([held[i] for i in order]).astype(np.int64) << 32
            held.clear()
            packed, tf = np.unique(packed | np.repeat(np.arange(m), lengths), return_counts=True)
            of, doc = packed >> 32, packed & 0xFFFFFFFF
            adds = impact(tf, stretch(lengths, n, total)[doc])
            every = list(ids)
            w = np.array([frequent.get(t, -1) for t in every], np.int64)[of]
            tier = (np.where(w < 0, most, adds * w)[:, None] < least).sum(axis=1)
            by = np.lexsort((doc, of, tier))
            of, doc, adds, tier = of[by], doc[by].astype(np.int32), adds[by].astype(np.int32), tier[by]
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(of) != 0) | (np.diff(tier) != 0)))) if len(of) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(of))
            for lo in range(0, len(starts), 1 << 14):
                a, b = starts[lo : lo + (1 << 14)], ends[lo : lo + (1 << 14)]
                k = len(a)
                tops = np.maximum.reduceat(adds[: b[-1]], a).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment] * k, pa.int64()), pa.array(tier[a].astype(np.int32)), none(pa.int32(), k), none(kind, k), pa.array([every[i] for i in of[a]], pa.binary()), pa.array((b - a).astype(np.int32)), pa.array(tops), _lists(doc, a, b), _lists(adds, a, b)], names
                )

        for batch in batches:
            kind = batch.column(1).type
            for row, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                segment = row if segment is None else segment
                w = words(t.as_py())
                held.append(np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int32, len(w)))
                keys.append(k)
                size += len(w)
                if size >= segment_words or len(keys) >= segment_docs:
                    yield from give()
                    segment, size, keys = None, 0, []
                    ids.clear()
        if keys:
            yield from give()

    table = written(rows.mapInArrow(index, f"segment long, tier int, nth int, key {rows.schema['key'].dataType.simpleString()}, term binary, n int, top int, docs binary, impacts binary"), "tiers")
    return Index(table.filter("tier = -1").select("segment", "nth", "key"), table.filter("tier >= 0").select("segment", "tier", *names[4:]), terms, n, len(least))


def _lists(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the stretches of 32-bit values, which lie side by side."""
    first = int(starts[0])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(((np.append(starts, ends[-1]) - first) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[first : ends[-1]]))])


class Block:
    """Items with their terms: terms (number by term), and for each item its terms' numbers and how often it has each."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = [i for i, _ in items]
        self.terms: dict[bytes, int] = {}
        self.of = [Counter(self.terms.setdefault(x, len(self.terms)) for x in w) for _, w in items]

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Weights by df; what each occurrence of a term is worth to the items that have it."""
        self.weight = np.array([weight(n, int(d)) if d else 0 for d in df], np.int64)
        by: list[list[tuple[int, int]]] = [[] for _ in self.terms]
        for i, c in enumerate(self.of):
            for t, k in c.items():
                if self.weight[t]:
                    by[t].append((i, k * int(self.weight[t])))
        self.by_term = [np.array(x, np.int64).reshape(-1, 2).T for x in by]

    def narrowed(self, left: np.ndarray) -> list[np.ndarray]:
        """by_term with the items that are left alone."""
        return [x[:, left[x[0]]] for x in self.by_term]


def _sums(lists: list[tuple[int, np.ndarray, np.ndarray]], by_term: list[np.ndarray], residual: np.ndarray, n_items: int, n_docs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For items, some at once: the first of them, the sums of their documents, and the residual bounds of the terms that these were met with."""
    for lo in range(0, n_items, AT_ONCE):
        sums, met = np.zeros((min(AT_ONCE, n_items - lo), n_docs), np.int64), np.zeros((min(AT_ONCE, n_items - lo), n_docs), np.int64)
        for t, docs, adds in lists:
            item, worth = by_term[t]
            a, b = np.searchsorted(item, (lo, lo + AT_ONCE))
            if a < b:
                at = np.ix_(item[a:b] - lo, docs)
                sums[at] += worth[a:b, None] * adds
                if residual[t]:
                    met[at] += (worth[a:b] * residual[t])[:, None]
        yield lo, sums, met


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores over 0 are, of equal ones the first."""
    at = np.flatnonzero(scores)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


_FOUND = pa.schema([("segment", pa.int64()), ("item", pa.int32()), ("nth", pa.int32()), ("score", pa.int64())])
FOUND = "segment long, item int, nth int, score long"


def _rows(segment: int, found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    items = np.repeat([i for i, _, _ in found], [len(d) for _, d, _ in found]) if found else np.empty(0)
    both = [np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (1, 2)]
    return pa.table([pa.array(np.full(len(items), segment, np.int64)), pa.array(items.astype(np.int32)), pa.array(both[0].astype(np.int32)), pa.array(both[1].astype(np.int64))], schema=_FOUND)


def _unpacked(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Term, documents and impacts of each list, in order of the terms."""
    each = ((t, np.frombuffer(d.as_py(), "<i4"), np.frombuffer(a.as_py(), "<i4").astype(np.int64)) for t, d, a in zip(table["id"].to_pylist(), table["docs"], table["impacts"], strict=True))
    return sorted(each, key=lambda x: x[0])


def _size(lists: list[tuple[int, np.ndarray, np.ndarray]]) -> int:
    return 1 + max((int(d[-1]) for _, d, _ in lists), default=-1)  # documents are in order in each list


def _tops(by_term: list[np.ndarray], n_items: int, k: int):
    """A function of a segment's lists: FOUND, the k highest sums of each item."""
    none = np.zeros(len(by_term), np.int64)

    def of(table: pa.Table) -> pa.Table:
        each, found = _unpacked(table), []
        for lo, sums, _ in _sums(each, by_term, none, n_items, _size(each)):
            for i, row in enumerate(sums):
                if len(best := _best(row, k)):
                    found.append((lo + i, best, row[best]))
        return _rows(table["segment"][0].as_py(), found)

    return of


def _search(index: Index, block: Block, k: int) -> list[DataFrame]:
    """item, segment, nth, score, tier (where it was proven): the best k of each segment and item at least, all with exact scores."""
    spark = index.postings.sparkSession
    every = list(block.terms)

    def named(rows: DataFrame, ids: Sequence[int] = range(len(every))) -> DataFrame:
        wanted = spark.createDataFrame(pa.table({"term": pa.array([every[i] for i in ids], pa.binary()), "id": pa.array(ids, pa.int32())}))
        return rows.join(F.broadcast(wanted), "term")  # BLOCK words at most

    df = np.zeros(len(block.terms), np.int64)
    for r in named(index.terms).select("id", "df").collect():  # a block's terms at most
        df[r["id"]] = r["df"]
    block.weigh(df, index.n)
    tops = np.zeros((index.tiers + 1, len(block.terms)), np.int64)
    for r in named(index.postings.select("tier", "term", "top")).groupBy("id", "tier").agg(F.max("top").alias("top")).collect():  # a block's terms, each tier
        tops[r["tier"], r["id"]] = r["top"]
    residuals = np.maximum.accumulate(tops[::-1], axis=0)[::-1][1:]  # after each tier
    postings = index.postings.select("segment", "tier", "term", "docs", "impacts")
    left, out, n_items = np.array([bool(c) for c in block.of], bool), [], len(block.items)
    for tier in range(index.tiers):
        residual = residuals[tier]
        unmet = np.array([sum(c * int(block.weight[t]) * int(residual[t]) for t, c in of.items()) for of in block.of], object)  # of a document that wasn't met
        by_term = block.narrowed(left)
        here = [t for t, x in enumerate(by_term) if x.shape[1]]
        if not here:
            break
        upto = named(postings.filter(F.col("tier") <= tier), here).drop("term")

        tops_here = written(upto.groupBy("segment").applyInArrow(_tops(by_term, n_items, k), FOUND), "tops")
        done = np.array([left[i] and unmet[i] == 0 for i in range(n_items)], bool)  # nothing is missing from any sum
        least = {r["item"]: r["score"] for r in _kth(tops_here, k).collect()}  # a row for each item of the block at most
        proven = np.array([bool(left[i] and not done[i] and least.get(i, 0) > unmet[i]) for i in range(n_items)], bool)
        if done.any():
            out.append(tops_here.filter(F.element_at(F.array(*[F.lit(bool(x)) for x in done]), F.col("item") + 1)).withColumn("tier", F.lit(tier)))
        if proven.any():
            lists = named(postings, [t for t, x in enumerate(block.narrowed(proven)) if x.shape[1]]).drop("term")
            out.append(_completed(lists, block, proven, least, unmet, residual, tier, k).withColumn("tier", F.lit(tier)))
        left &= ~(done | proven)
    return out


def _kth(tops: DataFrame, k: int) -> DataFrame:
    """item, score: the k-th best of each item that has so many."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), "segment", "nth")
    return tops.select("item", "score", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k).filter(F.col("rank") == k)


def _completed(lists: DataFrame, block: Block, proven: np.ndarray, least: dict[int, int], unmet: np.ndarray, residual: np.ndarray, tier: int, k: int) -> DataFrame:
    """FOUND of the proven items: the documents whose bound reaches the k-th best sum, with what lower tiers add to them."""
    by_term, n_items = block.narrowed(proven), len(block.items)
    bar = np.array([least.get(i, 0) - int(unmet[i]) for i in range(n_items)], np.int64)

    def candidates(table: pa.Table) -> pa.Table:
        each, found = _unpacked(table), []
        for lo, sums, met in _sums(each, by_term, residual, n_items, _size(each)):
            for i in np.flatnonzero(proven[lo : lo + len(sums)]):
                at = np.flatnonzero((sums[i] > 0) & (sums[i] - met[i] >= bar[lo + i]))
                if len(at):
                    found.append((int(lo + i), at, sums[i][at]))
        return _rows(table["segment"][0].as_py(), found)

    met = written(lists.filter(F.col("tier") <= tier).groupBy("segment").applyInArrow(candidates, FOUND), "candidates")
    lower = lists.filter(F.col("tier") > tier).join(met.select("segment").distinct(), "segment", "left_semi")

    def complete(some: pa.Table, table: pa.Table) -> pa.Table:
        if not some.num_rows:
            return _FOUND.empty_table()
        item, nth, score = (some[c].to_numpy().astype(np.int64) for c in ("item", "nth", "score"))
        order = np.argsort(item << 32 | nth)
        item, nth, score = item[order], nth[order], score[order]
        starts = np.searchsorted(item, np.arange(n_items + 1))
        for t, docs, adds in _unpacked(table) if table.num_rows else ():
            for i, worth in by_term[t].T:
                mine = nth[starts[i] : starts[i + 1]]
                if len(mine):
                    at = np.searchsorted(docs, mine).clip(max=len(docs) - 1)
                    score[starts[i] : starts[i + 1]] += np.where(docs[at] == mine, worth * adds[at], 0)
        best = [(i, nth[a:b][at], score[a:b][at]) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if a < b for at in [_best(score[a:b], k)]]
        return _rows(some["segment"][0].as_py(), best)

    return met.groupBy("segment").cogroup(lower.groupBy("segment")).applyInArrow(complete, FOUND)


def blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[tuple[list, list[tuple[int, list[bytes]]]]]:
    """Items in blocks of about `most` words: the keys, and number and words of each. Items without terms are left out."""
    keys, block, size = [], [], 0
    for r in items.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        if w := words(r[1]):
            block.append((len(keys), w))
            keys.append(r[0])
            size += len(w)
        if size >= most:
            yield keys, block
            keys, block, size = [], [], 0
    if block:
        yield keys, block


def search(index: Index, items: DataFrame, k: int = 20, item_key: str = "item_id", item_text: str = "text", most: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), key, score, tier (the one where the item was proven): the k best documents of each item, with scores over 0.

    Equal scores go by key, a null key first; documents that share a key go in an order of their places. Items that
    aren't proven in a tier fall through to the next. An item without terms has no rows; of items with the same id each
    has its own rows. An empty index or no items give no rows.
    """
    spark, of = index.postings.sparkSession, items.schema[item_key].dataType
    out = []
    for keys, block in blocks(items, item_key, item_text, most):
        found = _search(index, Block(block), k)
        names = spark.createDataFrame([*enumerate(keys)], f"item int, item_id {of.simpleString()}")
        if found:
            best = reduce(DataFrame.unionByName, found)
            best = best.join(index.documents, ["segment", "nth"])  # the best k of each segment, or fewer
            w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("key"), "segment", "nth")
            best = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            out.append(written(best.join(F.broadcast(names), "item").select("item_id", "rank", "key", "score", "tier"), "ranked"))
    if not out:
        key = index.documents.schema["key"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {of.simpleString()}, rank int, key {key}, score long, tier int")
    return reduce(DataFrame.unionByName, out)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """`search` in a new index of docs, the document's key under its own name. Null texts have no terms; repeated rows are ranked each; columns may have any names."""
    found = search(build_index(docs, key, text, **how), items, k, item_key, item_text)
    return found.select(F.col("item_id").alias(item_key), "rank", F.col("key").alias(key), "score", "tier")
