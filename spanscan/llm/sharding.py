"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a hash. It starts as one bucket; only buckets over the byte limit are
split on another bit, until every shard fits. Sizes are first summed in cells of `depth` bits (a few dozen a shard),
the tree of prefixes is summed from the cells, and the shards are the highest prefixes that fit. A cell that is still
too large goes on with more bits. The last 31 bits come from a row's place in the input, so that rows of one key,
which no hash of the key can part, still end in shards within the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

KEY_BITS, PLACE_BITS = 32, 31
BITS = KEY_BITS + PLACE_BITS
#: Cells for each shard of mean size, as a power of two, and bits added where cells are still too large.
FINER, MORE = 5, 8
#: A directory of up to this many entries is broadcast (under 4 MB); a larger one is joined by shuffle.
BROADCAST_ENTRIES = 1 << 15


def _prefix(bits: Column, depth: int) -> Column:
    """The leading `depth` of the 63 bits."""
    return F.shiftright(bits, BITS - depth)


def hash_bits(key: Column, place: Column) -> Column:
    """63 bits: 32 from the MD5 of the key's text (null: of the empty text), 31 from the row's place."""
    of_key = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.shiftleft(of_key, PLACE_BITS).bitwiseOR(F.xxhash64(place).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def _leaves(rows: DataFrame, known: int, depth: int, limit: int) -> DataFrame:
    """Prefixes of known..depth bits that fit the limit and whose parent doesn't, or that have `depth` bits.

    rows: bits, n_bytes. The prefixes of `known` bits are taken as too large, but for the root.
    """
    cells = rows.groupBy(_prefix(F.col("bits"), depth).alias("cell")).agg(F.sum("n_bytes").alias("size"), F.count("*").alias("n_rows"))
    nodes = (
        cells.select(F.explode(F.sequence(F.lit(known), F.lit(depth))).alias("depth"), "cell", "size", "n_rows")
        .groupBy("depth", F.call_function("shiftright", "cell", (F.lit(depth) - F.col("depth")).cast("int")).alias("prefix"))
        .agg(F.sum("size").alias("size"), F.sum("n_rows").alias("n_rows"))
    )
    nodes = settled(nodes)
    large = nodes.filter((F.col("size") > limit) & (F.col("n_rows") > 1)).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
    below = nodes.withColumn("above", F.call_function("shiftright", "prefix", F.lit(1)))
    leaves = below.join(large, ["depth", "above"], "left_semi")
    if not known:
        leaves = leaves.unionByName(below.filter("depth = 0"))
    return leaves.filter((F.col("size") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == depth)).select("depth", "prefix", "size", "n_rows")


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of `docs`: key, n_bytes, shard (its prefix, as bits), depth, shard_bytes, oversized.

    limit: the most bytes of UTF-8 text a shard may have. A single row beyond it is a shard of its own and flagged.
    Null and empty texts have no bytes; null keys hash as the empty text; repeated rows may part when their shard must
    be split; an empty table gives no rows.
    """
    rows = settled(
        docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("place"))
        .select("key", "n_bytes", hash_bits(F.col("key"), F.col("place")).alias("bits"))
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, (total // max(1, limit)).bit_length()) + FINER)
    found = settled(_leaves(rows, 0, depth, limit))
    done = found.filter((F.col("size") <= limit) | (F.col("n_rows") == 1))
    while depth < BITS:
        over = found.filter((F.col("size") > limit) & (F.col("n_rows") > 1)).filter(F.col("depth") == depth)
        if over.isEmpty():
            break
        rest = rows.join(over.select(F.col("prefix").alias("cell")), _prefix(F.col("bits"), depth) == F.col("cell"), "left_semi")
        known, depth = depth, min(BITS, depth + MORE)
        found = settled(_leaves(rest, known, depth, limit))
        done = done.unionByName(found.filter((F.col("size") <= limit) | (F.col("n_rows") == 1) | F.lit(depth == BITS)))
    return _assigned(rows, settled(done)).select(
        F.col("key").alias(key), "n_bytes", F.expr(f"if(depth = 0, '', substring(lpad(bin(shiftright(bits, {BITS} - depth)), depth, '0'), 1, depth))").alias("shard"),
        "depth", F.col("size").alias("shard_bytes"), (F.col("size") > limit).alias("oversized"),
    )


def _assigned(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows with the leaf that holds each.

    A leaf of d bits fills 2^(g - d) entries of a directory of g bits. Leaves are taken in bands of a few depths, with
    a directory each, so that a few deep leaves don't multiply the entries of all others.
    """
    depths = {r["depth"]: r["n"] for r in leaves.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # 64 at most
    out, left = None, sorted(depths)
    while left or out is None:
        band = [d for d in left if d <= left[0] + MORE] or [0]
        left = left[len(band) :]
        g = band[-1]
        first, last = F.expr(f"shiftleft(prefix, {g} - depth)"), F.expr(f"shiftleft(prefix + 1, {g} - depth) - 1")
        entries = leaves.filter(F.col("depth").isin(band)).select("depth", "size", F.explode(F.sequence(first, last)).alias("entry"))
        if sum(depths.get(d, 0) << (g - d) for d in band) <= BROADCAST_ENTRIES:
            entries = F.broadcast(entries)
        part = rows.join(entries, _prefix(F.col("bits"), g) == F.col("entry"))
        out = part if out is None else out.unionByName(part)
    return out
