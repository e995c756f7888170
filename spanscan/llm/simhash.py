"""SimHash near-duplicates, found with vantage-point trees.

Fingerprints of 64 bits link at `radius` or fewer differing bits. Two that do so agree wholly in one of radius + 1
parts: seen from any vantage point, they then lie at the same distance in that part, so the triangle bound at radius 0
leaves one branch, and the part's bits (its distances from 0 and from the unit words) name the shard. A shard that is
still large is split again and again by the median distance from a vantage point of its own, now over all 64 bits:
the inner side takes what lies within median + radius, the outer what lies beyond the median, so that both ends of
any link meet on some side (the overlap at the boundary). Where that hardly helps, as among points all about as far
from each other, the shard is split like the whole was: by parts of the bits that its points don't share yet, one of
which any link's two ends have in common, until it fits or no bits are left. Inside a shard a local tree goes on by the same rule, and
its leaves compare exactly. Shards give links to one representative each, never all pairs, and connected components
are found on those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_few, numbered, settled

BITS = 64
#: A shard of more fingerprints than this is split in Spark; a leaf of this many is compared pair by pair.
SHARD, LEAF = 20_000, 512
#: A split by distance that leaves the larger side over this share of the shard isn't used: the shard is split by parts.
WORTH = 0.7


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of 255 bits fit in a byte
            ones += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return ones


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of hashes that are already there: for each bit, whether over half of them have it; of none, zero."""
    return int.from_bytes(np.packbits(_ones(hashes) * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_bytes(text: bytes, width: int = 3) -> int:
    """The fingerprint of a text: for each bit, whether over half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, 42)
    last, hashed, n = ends[width - 1 :].tolist(), xxhash.xxh64_intdigest, len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([hashed(joined[s:e], 42) for s, e in zip(starts[at : min(n, at + (1 << 16))], last[at:], strict=False)], "<u8")
        ones += _ones(h)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | Column, width: int = 3) -> Column:
    """The 64 bits of a text column, as a signed long; no words and null: zero."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        found = [fingerprint_bytes((t.as_py() or "").encode(), width) for t in texts]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return fp(text)


def as_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _near(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _linked(points: np.ndarray, radius: int, within: bool = False) -> Iterator[tuple[int, int]]:
    """Links among distinct fingerprints whose components are those of all pairs within the radius; exact, by a local tree. The second end is the component's first point or, if `within`, the one that was met."""
    stack = [points]
    while stack:
        p = stack.pop()
        if len(p) > LEAF:
            d = _near(p, p[len(p) // 2])
            middle = np.median(d)
            inner, outer = p[d <= middle + radius], p[d > middle]
            if max(len(inner), len(outer)) <= WORTH * len(p):
                stack += [inner, outer]
                continue
        while len(p) > 1:  # grow a component from a point; what joined it isn't compared with again
            grown, p, i = [p[0]], p[1:], 0
            while i < len(grown) and len(p):
                close = _near(p, grown[i]) <= radius
                if close.any():
                    yield from ((int(x), int(grown[i if within else 0])) for x in p[close])
                    grown += list(p[close])
                    p = p[~close]
                i += 1


def _components(keys: np.ndarray, fps: np.ndarray, radius: int, within: bool = False) -> pd.DataFrame:
    """The links of the shards in arrays sorted by key."""
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    small = np.repeat(sizes <= 64, sizes)
    k, f = keys[small], fps[small]
    for step in range(1, min(64, int(sizes.max(initial=1)))):  # all small shards at once: each point with the next, the one after, ...
        hit = np.flatnonzero((k[step:] == k[:-step]) & (_near(f[step:], f[:-step]) <= radius))
        a.append(f[hit + step])
        b.append(f[hit])
    for at in np.flatnonzero(sizes > 64):
        if pairs := list(_linked(fps[cuts[at] : cuts[at + 1]], radius, within)):
            x = np.array(pairs, np.uint64)
            a.append(x[:, 0])
            b.append(x[:, 1])
    return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def _parts(mask: int, radius: int) -> list[int]:
    """The bits of a mask in radius + 1 parts, as masks; fewer where it has fewer bits."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    cuts = [round(i * len(bits) / (radius + 1)) for i in range(radius + 2)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _by_parts(shards: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """shards (shard, mask, fp) dealt out by what each fingerprint has in the parts of the bits of its shard's mask, which go from the mask."""
    one = lambda m, p: F.struct(F.concat("shard", F.lit(f"{p:x}="), F.col("fp").bitwiseAND(F.lit(_signed(p))).cast("string"), F.lit("/")).alias("shard"), F.lit(_signed(m & ~p)).alias("mask"))
    dealt = F.coalesce(*[F.when(F.col("mask") == _signed(m), F.array(*[one(m, p) for p in _parts(m, radius)])) for m in masks])
    return shards.select("fp", F.explode(dealt).alias("s")).select("s.shard", "s.mask", "fp")


def _split(shards: DataFrame, radius: int, most: int) -> DataFrame:
    """shards (shard, mask: the bits that its points may not share, fp), those of over `most` rows split until they fit or share all bits."""
    done, large = None, shards
    while True:
        sizes = large.groupBy("shard").agg(F.count("*").alias("n"), F.min("fp").alias("vantage"), F.min("mask").alias("m")).filter((F.col("n") > most) & (F.col("m") != 0))
        over = settled(sizes.drop("m"))
        if over.isEmpty():
            return large if done is None else done.unionByName(large)
        few = over.count() <= 10_000
        small = large.join(F.broadcast(over.select("shard")) if few else over.select("shard"), "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        seen = settled(large.join(F.broadcast(over) if few else over, "shard").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))))
        middle = seen.groupBy("shard").agg(F.percentile_approx("d", 0.5).alias("middle"))
        inner, outer = F.col("d") <= F.col("middle") + radius, F.col("d") > F.col("middle")
        placed = seen.join(F.broadcast(middle) if few else middle, "shard")
        larger = placed.groupBy("shard").agg(F.greatest(F.count_if(inner), F.count_if(outer)).alias("larger"), F.count("*").alias("n"))
        stuck = larger.select("shard", (F.col("larger") > WORTH * F.col("n")).alias("stuck"))
        placed = settled(placed.join(F.broadcast(stuck) if few else stuck, "shard").select("shard", "mask", "fp", "stuck", F.array_compact(F.array(F.when(inner, "i"), F.when(outer, "o"))).alias("sides")))
        large = placed.filter("not stuck").select(F.explode("sides").alias("side"), "shard", "mask", "fp").select(F.concat("shard", "side").alias("shard"), "mask", "fp")
        by_parts = placed.filter("stuck").select("shard", "mask", "fp")
        masks = [r["mask"] % (1 << BITS) for r in by_parts.select("mask").distinct().collect()]  # (radius + 1) ** depth at most
        if masks:
            large = large.unionByName(_by_parts(by_parts, masks, radius))
        large = settled(large)


def links(fps: DataFrame, radius: int = 3, within: bool = False) -> DataFrame:
    """a, b: links among the distinct values of `fp` that connect exactly what pairs within the radius connect. With `within`, each of them is such a pair; without, fewer steps lead from one end of a component to the other."""
    whole = fps.select(F.lit("").alias("shard"), F.lit(_signed((1 << BITS) - 1)).alias("mask"), "fp")
    shards = _split(settled(_by_parts(whole, [(1 << BITS) - 1], radius)), radius, SHARD).select("shard", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []

        def found(t: pa.Table) -> pa.RecordBatch:
            keys = t["shard"].combine_chunks().dictionary_encode().indices.to_numpy()
            return pa.RecordBatch.from_pandas(_components(keys, t["fp"].to_numpy().view(np.uint64), radius, within), preserve_index=False)

        for batch in batches:  # sorted by shard; the last shard of a batch may go on in the next
            rest.append(pa.Table.from_batches([batch]))
            last = rest[-1]["shard"][-1] if batch.num_rows else None
            if last is not None and rest[0]["shard"][0] != last:
                t = pa.concat_tables(rest)
                at = np.searchsorted(np.asarray(t["shard"].to_pylist(), object), last.as_py())
                yield found(t.slice(0, at))
                rest = [t.slice(at)]
        if rest and (t := pa.concat_tables(rest)).num_rows:
            yield found(t)

    dealt = shards.repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes in edges (a, b), by large-star and small-star rounds.

    A round is aggregates and joins alone: no node's neighbours are gathered in one place, and AQE splits a node of many.
    """
    edges = settled(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct())
    before, n = None, edges.count()
    while True:
        edges = in_few(edges, n)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = in_few(both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v"), 2 * n)
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = in_few(large.join(down, "v").select(F.col("m").alias("w"), "u", "v"), 2 * n)
        small = small.select(F.explode(F.array(F.struct(F.col("w").alias("u"), F.col("u").alias("v")), F.struct(F.col("w").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.u", "e.v").filter("u < v").distinct()
        edges = settled(in_few(small, 2 * n))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before, n = tuple(now), now[0]
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _named(of: DataFrame, radius: int) -> DataFrame:
    """fp, component_id of the distinct fingerprints of `of` (key, fp), kept."""
    distinct = settled(of.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = settled(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return settled(rooted.join(ids, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (long), component_id: the smallest key reachable over links of `radius` or fewer differing bits.

    Null and wordless texts have the fingerprint zero and link like any other. Repeated rows stay, with one component.
    A component all of whose keys are null has a null id. An empty table gives no rows. Only the key and the text are
    read, so other columns may have any names.
    """
    of = settled(docs.select(F.col(key).alias("key"), fingerprint(text, width).alias("fp")))
    return of.join(_named(of, radius), "fp").select(F.col("key").alias(key), "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 3, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest key, of repeated rows the first.

    A null key is smaller than all others. Null and wordless texts are one component. An empty table gives no rows.
    Columns may have any names. The numbered rows are written once, so both sides of the join have the same numbers.
    """
    rows = numbered(docs)
    of = settled(rows.select(F.struct(F.col(f"row.`{key}`").alias("key"), "place").alias("key"), fingerprint(F.col(f"row.`{text}`"), width).alias("fp")))
    kept = _named(of, radius).select("component_id.place").distinct()
    return rows.join(kept, "place", "left_semi").select("row.*")
