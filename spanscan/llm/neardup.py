"""Near copies by what they share: the Jaccard index of two texts' sets of five-word shingles, exactly computed.

Texts with the same set are copies. What has to be found for the others are the connected components of the pairs at the
index or over it, so not all pairs are compared:

1. `simhash`: each set has a fingerprint, and its vantage-point trees give the links of RADIUS or fewer bits. Each link
   is checked exactly.
2. SimHash can't find the rest: at 0.8 two fingerprints differ in 10 bits on average and in 17 at times, and with so wide an
   overlap a vantage-point tree over 64 bits has nearly all points on both sides of each split. So texts that agree in a
   band of min-hashes are candidates too: at an index of 0.8, one pair in 17,000 agrees in none of the bands, and fewer
   above. A text that no tree linked to a smaller one is compared with the first one of one of its bands.
3. In bands that still have several components, but few texts or few pairs of texts of two components, all such pairs are
   compared. In larger ones, the texts outside the largest component are compared with a few of those in it, each round
   with others, as long as many are found to link.
4. For the texts of larger bands that still have several components, a prefix filter gives all pairs that can be links, in
   any band or in none: put in the same order, the rare ones first, two sets that share 0.8 share one of the first fifth
   of their shingles, and with enough behind it. Texts that have a common passage and nothing else share none there.

So the pairs of a band grow with its texts, not with their square, whether its texts are all alike or all apart.
Comparisons are of arrays of 64-bit hashes, in the JVM; a text that is compared with many is dealt out by salts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import in_few, numbered, settled, written

WIDTH, LEAST = 5, 0.8
#: Bits in which fingerprints of a tree's links differ at most: six parts of 10 or 11 bits name the shards, so that up to 20 million sets, evenly spread, are in shards that fit a task of `simhash`. Links of more bits are left to the bands.
RADIUS = 5
#: Min-hashes in a band, and bands.
ROWS, BANDS = 6, 32
_RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, ROWS * BANDS, 1), np.uint64)
_TIMES, _PLUS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]
#: Texts of a band's largest component that others are compared with, in rounds, and the share of links from which there is another round; they save work, and decide nothing.
SOME, ROUNDS, ENOUGH = 4, 4, 0.05
#: Pairs of texts of two components, for each text of a band, up to which all of them are compared.
FEW = 4
#: A text that is compared with more than so many is copied, once for each so many.
HOT = 1_000
#: Shingles are counted in so many cells for their order: rare ones first. Any order gives all pairs.
CELLS = 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def hashed(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of the hashes of all runs of `width` words, A-Z in lower case; a text of fewer words is one run, and one of none has none. No object is made for each word, so very long texts take some times their own size."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first white space after a word parts it from the next
    raw, space = np.where(space, 32, raw).astype(np.uint8)[keep], space[keep]
    if len(space) and space[0]:
        raw, space = raw[1:], space[1:]
    if len(space) and not space[-1]:
        raw, space = np.append(raw, np.uint8(32)), np.append(space, True)
    ends = np.flatnonzero(space)
    if not len(ends):
        return np.empty(0, np.uint64)
    joined, of = raw.tobytes(), xxhash.xxh64_intdigest
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(ends) < width:
        return np.array([of(joined[:-1])], np.uint64)
    starts, ends, out = starts[: len(starts) - width + 1], ends[width - 1 :], []
    for at in range(0, len(starts), 1 << 16):
        some = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        out.append(np.unique(np.array([of(joined[a:b]) for a, b in some], np.uint64)))
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def bands(hashes: np.ndarray) -> list[int]:
    """A number for each band of min-hashes of a set's hashes."""
    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, at : at + 1024] * _TIMES + _PLUS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def sketch(text: str | Column, width: int = WIDTH) -> Column:
    """same (16 bytes that only texts with the same set share), fp (the set's fingerprint), bands."""

    @F.arrow_udf("same binary, fp long, bands array<long>")
    def of(texts: pa.Array) -> pa.Array:
        same, fps, found = [], [], []
        for t in texts:
            h = hashed(t.as_py(), width)
            same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
            fps.append(simhash.of_hashes(h))
            found.append(bands(h))
        arrays = [pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(arrays, ["same", "fp", "bands"])

    return of(text)


def shingle_hashes(text: str | Column, width: int = WIDTH) -> Column:
    """`hashed` of a text column, as signed longs."""

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        each = [hashed(t.as_py(), width).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, each)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each) if each else np.empty(0, np.int64)))

    return of(text)


def jaccard(a: str, b: str) -> Column:
    """The index of two arrays of distinct values, not both empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets (node, hashes) share enough."""
    pairs = settled(pairs)
    pairs = in_few(pairs, pairs.count())
    times = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts"))
    hot = settled(times.filter("salts > 1"))
    copies = sets.join(times.withColumnRenamed("a", "node"), "node").select(F.col("node").alias("a"), F.col("hashes").alias("of_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(hot, "a", "left").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    both = salted.join(sets, "node").withColumnRenamed("hashes", "of_b").join(copies, ["a", "salt"])
    return settled(both.filter(jaccard("of_a", "of_b") >= least).select("a", F.col("node").alias("b")))


def _joined(roots: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """roots (node, root) with the components that links (a, b) of nodes join; n nodes. Only roots go through the search for components."""
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    between = links.join(of("a"), "a").join(of("b"), "b").filter("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    to = simhash.components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return in_few(settled(in_few(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), n)), n)


def _apart(members: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """Of n members: band, node, root, main (the root of most of the band), far (whether the band has many pairs of two roots for each text) of the bands that have several components."""
    rooted = in_few(members.join(roots, "node"), n)
    sizes = rooted.groupBy("band", "root").agg(F.count("*").cast("double").alias("n"))
    sums = sizes.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count("*").alias("roots"))
    split = sums.filter("roots > 1").select("band", "main", ((F.col("n") * F.col("n") - F.col("squares")) / 2 > FEW * F.col("n")).alias("far"))
    return in_few(settled(in_few(rooted.join(split, "band"), n)), n)


def _some(far: DataFrame, round_no: int) -> DataFrame:
    """Pairs (a, b) of some texts of each band's largest component and all texts outside it."""
    some = F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(round_no * SOME + i))) for i in range(SOME)]))
    of_main = far.filter("root = main").groupBy("band").agg(some.alias("some")).select("band", F.explode("some").alias("a"))
    return far.filter("root <> main").select("band", F.col("node").alias("b")).join(of_main, "band").select("a", "b")


def _cells(sets: DataFrame) -> np.ndarray:
    """How many hashes of all sets fall in each cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    got = sets.select("hashes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS at most
    out = np.zeros(CELLS, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def _candidates(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that can be links, and all that are: sets (node, root, hashes) that share one of their first shingles, the rare ones being first, and have enough behind it."""
    cells = _cells(sets).astype(np.int32)

    @F.arrow_udf("array<long>")
    def first(hashes: pa.Array) -> pa.Array:
        out = []
        for h in hashes:
            x = h.values.to_numpy()
            out.append(x[np.lexsort((x, cells[x & (CELLS - 1)]))[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1]])
        return pa.array(out, pa.list_(pa.int64()))

    share = least / (1 + least)  # of both sizes together, that has to be in both sets
    lists = settled(sets.select("node", "root", F.size("hashes").alias("size"), F.posexplode(first("hashes")).alias("pos", "token")))
    many = F.col("size") - F.col("pos")  # what a set can share at most, where this is the first that it shares
    tokens = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("size").alias("smallest")).filter("lo < hi").select("token", "smallest")
    lists = settled(lists.join(tokens, "token").filter(many >= share * (F.col("size") + F.col("smallest")) - 1e-9).select("token", "node", "root", "size", many.alias("many")))
    several = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    lists = settled(lists.join(several, "token"))
    of = lambda side: lists.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "size", "many")])
    near = (F.col("root_a") != F.col("root_b")) & (F.col("node_a") < F.col("node_b")) & (F.least("many_a", "many_b") >= share * (F.col("size_a") + F.col("size_b")) - 1e-9)
    return of("a").join(of("b"), "token").filter(near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _by_fingerprint(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp), once each: the links of `simhash`'s trees, and nodes of one fingerprint with the first of them. Where one end is in many pairs, it is a."""
    firsts = settled(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    of = lambda side: firsts.select(F.col("fp").alias(side), F.col("first").alias(f"of_{side}"))
    trees = simhash.links(firsts, radius, within=True).join(of("a"), "a").join(of("b"), "b").select(F.col("of_b").alias("a"), F.col("of_a").alias("b"))
    alike = nodes.join(firsts, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = trees.unionByName(alike).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    return settled(pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")))


def groups(texts: DataFrame, nodes: DataFrame, least: float = LEAST, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """nodes (node, fp, bands) with the root of each one's component. texts: place, text; a node is the place of one of the texts with its set."""
    close = _by_fingerprint(nodes.select("node", "fp"), radius)
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = written(buckets.join(shared, "band"), "members")
    n_members, n_close = members.count(), close.count()
    end = lambda which, found: close.select(which("a", "b").alias("node"), which("a", "b").alias("first"), F.lit(found).alias("found"))
    ends = members.select("node", "first", F.lit(False).alias("found")).unionByName(end(F.least, False)).unionByName(end(F.greatest, True))
    met = F.when(F.max("found"), F.col("node")).otherwise(F.min("first")).alias("met")  # a node that a tree links to a smaller one meets none by its bands
    stars = settled(in_few(ends.groupBy("node").agg(met), n_members + 2 * n_close))
    n = stars.count()
    stars = in_few(stars, n)
    read = texts.join(stars.select(F.col("node").alias("place")), "place", "left_semi")
    sets = written(read.select(F.col("place").alias("node"), shingle_hashes("text", width).alias("hashes")), "shingles")
    first = close.unionByName(stars.filter("node <> met").select(F.col("met").alias("a"), F.col("node").alias("b")))
    roots = _joined(stars.select("node", F.col("node").alias("root")), _linked(first, sets, least), n)
    apart = _apart(members.select("band", "node"), roots, n_members)
    near = apart.filter(~F.col("far")).join(stars, "node").select("band", "node", "root", "met")
    of = lambda side: near.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "met")])
    new = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("met_b") != F.col("node_a"))
    pairs = of("a").join(of("b"), "band").filter(new).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))  # of bands with FEW for each text at most
    apart = apart.filter("far")
    pairs = pairs.unionByName(_some(apart, 0))
    for r in range(1, ROUNDS + 1):
        pairs = settled(pairs.distinct())
        found = _linked(pairs, sets, least)
        roots = _joined(roots, found, n)
        apart = _apart(apart.select("band", "node"), roots, n_members)  # bands of one component have nothing to tell any more
        if r == ROUNDS or found.count() < ENOUGH * pairs.count() or apart.isEmpty():
            break
        pairs = _some(apart, r)
    if not apart.isEmpty():
        left = written(sets.join(apart.select("node", "root").distinct(), "node"), "open-shingles")
        roots = _joined(roots, _linked(_candidates(left, least), left.select("node", "hashes"), least), n)
    return nodes.drop("fp", "bands").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame, least: float = LEAST, width: int = WIDTH, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: the one with the smallest key, of repeated rows the first.

    A null key is smaller than all others. Null, empty and wordless texts are one group. Texts of fewer words than the
    width are alike if equal but for case and white space. Ties and repeated rows go by place. An empty table gives no
    rows. Columns may have any names.
    """
    rows = numbered(docs)
    texts = rows.select("place", F.col(f"row.`{text}`").alias("text"))
    first = F.struct(F.col(f"row.`{key}`").alias("key"), "place")
    sketches = written(rows.select(first.alias("first"), sketch(F.col(f"row.`{text}`"), width).alias("s")).select("first", "s.*"), "sketches")
    sets = written(sketches.groupBy("same").agg(F.min("first").alias("first"), F.min("fp").alias("fp"), F.min("bands").alias("bands")).select(F.col("first.place").alias("node"), "first", "fp", "bands"), "sets")
    kept = groups(texts, sets, least, width, radius).groupBy("root").agg(F.min("first").alias("first")).select("first.place")
    return rows.join(kept, "place", "left_semi").select("row.*")
