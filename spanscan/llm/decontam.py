"""Benchmark decontamination with a distributed positional inverted index.

The index is built once over the training documents and kept as a Parquet table. Documents are laid end to end in
segments of about SEGMENT words; a row is a term of a segment with the list of its positions there, so the list of a
frequent term is in as many pieces as there are segments, and no piece grows with the corpus. Any number of
benchmarks can be searched for in one index, without another look at the texts.

A benchmark's windows are searched for from their rarest terms on: the list of a window's rarest term, less that
term's offset in the window, gives the places where the window may start. These are intersected with the lists of
the next rarest terms, each less its own offset, until all terms are through. What is left are exact phrase matches;
with `slop`, a term may lie up to so many words off its place (proximity matches). Only lists of the benchmark's terms
are read, and they meet by segment.

The benchmark is a stated query set. It is taken in blocks of about BLOCK words, one at a time, so that neither the
driver nor a task holds more than a block's windows, whatever the benchmark's size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

#: Words of the benchmark in a block, and of the corpus in a segment (and one document more at most).
BLOCK, SEGMENT = 1 << 18, 1 << 20
WINDOW = 10
#: Places that are intersected at once, and terms given away at once.
CHUNK, TERMS = 1 << 20, 1 << 14
#: A-Z to lower case; ASCII other than letters and digits separates.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: The term whose positions are where the documents of a segment start, and where the last one ends. No word is empty.
STARTS = b""


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


@dataclass(frozen=True)
class Index:
    """documents: segment, nth, key, n_words. postings: segment, term, n_places, places (little-endian 32-bit integers)."""

    documents: DataFrame
    postings: DataFrame


def _lists(places: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the places up to each end."""
    starts = np.concatenate(([0], ends)).astype(np.int64) * 4
    first = int(starts[0])
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((starts - first).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(places[: ends[-1] if len(ends) else 0], np.int32))])


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, whole texts, with all their terms. Null texts have no words; keys may be of any type, null or repeated."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["segment", "nth", "key", "n_words", "term", "n_places", "places"]
    segment_words = SEGMENT

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, segment, size, keys, ids, sizes = None, None, 0, [], [], []
        terms: defaultdict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__

        def give() -> Iterator[pa.RecordBatch]:
            n = len(keys)
            none = lambda of, m: pa.nulls(m, of)
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(keys, kind), pa.array(sizes, pa.int64()), none(pa.binary(), n), none(pa.int32(), n), none(pa.binary(), n)], names
            )
            flat = np.concatenate(ids)
            order, count = np.argsort(flat, kind="stable").astype(np.int32), np.bincount(flat, minlength=len(terms))
            every, ends = list(terms), np.cumsum(count)
            starts = np.cumsum([0, *sizes]).astype(np.int32)
            parts = [([STARTS], [n + 1], pa.array([starts.tobytes()], pa.binary()))]
            for lo in range(0, len(every), TERMS):
                first, here = (ends[lo - 1] if lo else 0), ends[lo : lo + TERMS]
                parts.append((every[lo : lo + TERMS], count[lo : lo + TERMS], _lists(order[first : here[-1]], here - first)))
            for some, n_places, lists in parts:
                m = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([segment] * m, pa.int64()), none(pa.int32(), m), none(kind, m), none(pa.int64(), m), pa.array(some, pa.binary()), pa.array(n_places, pa.int32()), lists], names)

        for batch in batches:
            kind = batch.column(1).type
            for row, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                segment = row if segment is None else segment
                w = words(t.as_py())
                keys.append(k)
                sizes.append(len(w))
                ids.append(np.fromiter(map(terms.__getitem__, w), np.int32, len(w)))
                size += len(w)
                if size >= segment_words or len(keys) >= segment_words:
                    yield from give()
                    segment, size, keys, ids, sizes = None, 0, [], [], []
                    terms.clear()
        if keys:
            yield from give()

    table = written(rows.mapInArrow(index, f"segment long, nth int, key {rows.schema['key'].dataType.simpleString()}, n_words long, term binary, n_places int, places binary"), "postings")
    return Index(table.filter("nth is not null").select(*names[:4]), table.filter("term is not null").select("segment", *names[4:]))


class Query:
    """A block of items: their terms, and their distinct windows as arrays of term numbers (short ones end in -1)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.names = window, [i for i, _ in items]
        self.terms: dict[bytes, int] = {}
        rows, of = [], []
        for n, (_, w) in enumerate(items):
            ids = [self.terms.setdefault(x, len(self.terms)) for x in w]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.append(ids[at : at + window] + [-1] * (window - len(ids)))
                of.append(n)
        every = np.array(rows, np.int32).reshape(-1, window)
        self.windows, which = np.unique(every, axis=0, return_inverse=True)
        self.length = (self.windows >= 0).sum(axis=1)
        owned = np.unique(np.stack((which.reshape(-1), np.array(of, np.int64)), axis=1), axis=0)
        self.items, self.item_ends = owned[:, 1], np.searchsorted(owned[:, 0], np.arange(len(self.windows) + 1))

    def rarest_first(self, n: np.ndarray) -> None:
        """Order of intersecting, by how often each term is in the corpus; the windows of each term that comes first."""
        rare = np.where(self.windows >= 0, n[self.windows], np.iinfo(np.int64).max)
        self.order = np.argsort(rare, axis=1, kind="stable").astype(np.int16)
        first = self.windows[np.arange(len(self.windows)), self.order[:, 0]] if len(self.windows) else np.empty(0, np.int32)
        self.by_first = np.argsort(first, kind="stable")
        self.starts = np.searchsorted(first[self.by_first], np.arange(len(self.terms) + 1))

    def items_of(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows: the place of each in `w`, once for each of its items, and the item."""
        n = self.item_ends[w + 1] - self.item_ends[w]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(w)), n), self.items[np.repeat(self.item_ends[w], n) + nth]


def _intersected(q: Query, terms: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows, where they start, and their document, from the sorted position lists of a segment's terms (numbers, in order). starts: of the documents, and the end."""
    listed = np.concatenate(lists).astype(np.int64)
    of = np.repeat(terms, [len(x) for x in lists]).astype(np.int64)
    keys = of << 32 | listed
    many = q.starts[of + 1] - q.starts[of]  # windows that this posting may be the rarest term of
    listed, of, many = listed[many > 0], of[many > 0], many[many > 0]
    cuts = np.searchsorted(np.cumsum(many), np.arange(CHUNK, many.sum() + CHUNK, CHUNK))
    for lo, hi in zip([0, *cuts[:-1] + 1], cuts + 1, strict=True) if len(many) else ():
        m = many[lo:hi]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        w, at = q.by_first[np.repeat(q.starts[of[lo:hi]], m) + nth], np.repeat(listed[lo:hi], m)
        doc = np.searchsorted(starts, at, "right") - 1
        start = at - q.order[w, 0]
        if not slop:
            ok = (start >= starts[doc]) & (start + q.length[w] <= starts[doc + 1])
            w, start, doc = w[ok], start[ok], doc[ok]
        for k in range(1, q.window):
            if not len(w):
                break
            offset = q.order[w, k]
            term = q.windows[w, offset].astype(np.int64)
            near = term < 0
            for off in range(-slop, slop + 1):
                place = start + offset + off
                inside = (place >= starts[doc]) & (place < starts[doc + 1]) & (term >= 0)
                want = np.where(inside, term << 32 | place.clip(0), -1)
                near |= keys[np.searchsorted(keys, want).clip(max=len(keys) - 1)] == want
            w, start, doc = w[near], start[near], doc[near]
        if len(w):
            yield w, start, doc


FOUND = "segment long, nth int, first array<int>, last array<int>, items array<string>"
_FOUND = pa.schema([("segment", pa.int64()), ("nth", pa.int32()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _hits(q: Query, segment: int, terms: np.ndarray, lists: list[np.ndarray], starts: np.ndarray, slop: int) -> pa.Table:
    """FOUND of a segment: for each document with matches the stretches that they cover, last exclusive, and the items."""
    stretches, items = [], []
    for w, start, doc in _intersected(q, terms, lists, starts, slop):
        lo, hi = np.maximum(start - slop, starts[doc]), np.minimum(start + q.length[w] + slop, starts[doc + 1])
        stretches.append(np.unique(np.stack((lo, hi), axis=1), axis=0))
        which, item = q.items_of(w)
        items.append(np.unique(np.stack((doc[which], item), axis=1), axis=0))
    if not stretches:
        return _FOUND.empty_table()
    lo, hi = np.unique(np.concatenate(stretches), axis=0).T  # documents lie apart, so stretches of two never overlap
    fresh = np.concatenate(([True], lo[1:] >= np.maximum.accumulate(hi)[:-1]))
    lo, hi = lo[fresh], np.maximum.reduceat(hi, np.flatnonzero(fresh))
    doc = np.searchsorted(starts, lo, "right") - 1
    ids, at = np.unique(doc, return_index=True)
    lo, hi = np.split((lo - starts[doc]).astype(np.int32), at[1:]), np.split((hi - starts[doc]).astype(np.int32), at[1:])
    owned = np.unique(np.concatenate(items), axis=0)
    of = np.split(owned[:, 1], np.searchsorted(owned[:, 0], ids[1:]))
    return pa.table([[segment] * len(ids), ids.astype(np.int32), [x.tolist() for x in lo], [x.tolist() for x in hi], [[q.names[i] for i in x] for x in of]], schema=_FOUND)


def _search(index: Index, q: Query, slop: int) -> DataFrame:
    """FOUND, a row for each document with matches."""
    spark = index.postings.sparkSession
    wanted = spark.createDataFrame(pa.table({"term": pa.array([STARTS, *q.terms], pa.binary()), "id": pa.array(range(-1, len(q.terms)), pa.int32())}))
    lists = index.postings.join(F.broadcast(wanted), "term")  # BLOCK words at most
    n = np.zeros(len(q.terms), np.int64)
    for r in lists.filter("id >= 0").groupBy("id").agg(F.sum("n_places").alias("n")).collect():  # a block's terms at most
        n[r["id"]] = r["n"]
    q.rarest_first(n)

    def look(table: pa.Table) -> pa.Table:
        ids, lists = table["id"].to_numpy(), [np.frombuffer(x.as_py(), "<i4") for x in table["places"]]
        order = np.argsort(ids)
        if len(order) < 2 or ids[order[0]] >= 0:
            return _FOUND.empty_table()
        return _hits(q, table["segment"][0].as_py(), ids[order[1:]], [lists[i] for i in order[1:]], lists[order[0]].astype(np.int64), slop)

    return lists.select("segment", "id", "places").groupBy("segment").applyInArrow(look, FOUND)


def _covered(first: str, last: str):
    """Positions that lie in some stretch, from two arrays."""
    ends = F.array_sort(F.arrays_zip(F.col(first).alias("a"), F.col(last).alias("b")))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["to"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to"))
    return F.aggregate(ends, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda s: s["n"].cast("long"))


def blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark in blocks of about `most` words. Items without words are left out."""
    block, size = [], 0
    for r in items.select(F.col(key).cast("string"), F.col(text)).filter(F.col(text).isNotNull()).toLocalIterator():
        if w := words(r[1]):
            block.append((r[0] or "", w))
            size += len(w)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: Index, items: DataFrame, window: int = WINDOW, slop: int = 0, item_key: str = "item_id", item_text: str = "text", most: int = BLOCK) -> DataFrame:
    """A row for each document of an index: key, n_words, first and last (matched stretches), items (sorted as strings), n_hit.

    Items of fewer words than the window match as a whole; those without words never. A null item id reads as the
    empty text. Repeated items count as they come, each item id once. An empty benchmark gives every document no hits.
    """
    found = [written(_search(index, Query(block, window), slop), "found") for block in blocks(items, item_key, item_text, most)]
    if len(found) > 1:
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("first", "last", "items")]
        found = [reduce(DataFrame.unionByName, found).groupBy("segment", "nth").agg(*joined)]
    one = found[0] if found else index.documents.sparkSession.createDataFrame([], FOUND)
    none = lambda c, of: F.coalesce(c, F.array().cast(f"array<{of}>")).alias(c)
    rows = index.documents.join(one, ["segment", "nth"], "left").select("key", "n_words", none("first", "int"), none("last", "int"), F.array_sort(F.array_distinct(none("items", "string"))).alias("items"))
    return rows.withColumn("n_hit", _covered("first", "last"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most: int = BLOCK) -> DataFrame:
    """`search` in a new index of docs: a row for each row of docs, with its key under the key's name.

    Null texts have no words. Repeated rows are told apart. An empty table gives no rows. Only the key and the text are
    read, so other columns may have any names.
    """
    found = search(build_index(docs, key, text), items, window, slop, item_key, item_text, most)
    return found.select(F.col("key").alias(key), "n_words", "first", "last", "items", "n_hit")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that hold a window of the benchmark.

    Null and empty texts hold none and stay; repeated rows stay or go alike; an empty table gives no rows. Columns may
    have any names. The numbered rows are written once, so both sides of the join have the same numbers.
    """
    rows = numbered(docs)
    hit = matches(rows.select("place", F.col(f"row.`{text}`").alias("text")), items, window, key="place", item_key=item_key, item_text=item_text).filter("n_hit > 0").select("place")
    return rows.join(hit, "place", "left_anti").select("row.*")
