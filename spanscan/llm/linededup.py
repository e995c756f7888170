"""Cross-site boilerplate lines, with DataFrame functions only.

The spread of a line is the number of distinct sites that hold it. A HyperLogLog sketch for each line hash, merged by
aggregation, estimates it; lines near the threshold are counted exactly. A line at or over the threshold is
boilerplate: it stays in the document with the smallest id that holds it, and goes from all others, so that no text
is lost altogether when whole documents are copied from site to site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, settled

#: So many boilerplate lines or fewer (16 bytes each) are broadcast; more are joined by shuffle, with the same result.
BROADCAST_LINES = 200_000
#: In such a shuffle the copies of one line are dealt over so many partitions: boilerplate lines are the most frequent of all.
SALTS = 32
#: Sketches of 2^10 registers err by 3 % (one sigma); estimates within a quarter of the threshold are counted exactly.
LG_K, NEAR = 10, 0.25


def lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """_id, _text_hash, key, site, pos, line (its hash): a row for each line that isn't blank."""
    every = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.when(F.trim(x) != "", F.xxhash64(x)))
    return docs.select(*row_key(key, text), F.col(key).alias("key"), F.col(site).cast("string").alias("site"), F.posexplode(every).alias("pos", "line")).filter("line is not null")


def _meet(each: DataFrame, few: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """each joined by line with `few` rows of distinct lines, of which there are n: broadcast, or else salted."""
    if n <= BROADCAST_LINES:
        return each.join(F.broadcast(few), "line", how)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return each.withColumn("salt", F.pmod(F.xxhash64("_id", "_text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"], how).drop("salt")


def boilerplate(docs: DataFrame, min_sites: int, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """line (hash), first (the smallest key that holds it), of the lines on min_sites sites or more. Null sites are none."""
    each = lines(docs, key, text, site)
    sketched = each.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("key").alias("first")).select("line", "first", F.hll_sketch_estimate("sketch").alias("spread"))
    wide = settled(sketched.filter(F.col("spread") >= int(min_sites * (1 - NEAR))))
    near = wide.filter(F.col("spread") <= min_sites * (1 + NEAR))
    exact = _meet(each.filter("site is not null"), near.select("line"), near.count(), "left_semi").select("line", "site").distinct().groupBy("line").count().filter(F.col("count") >= min_sites)
    return wide.filter(F.col("spread") > min_sites * (1 + NEAR)).select("line", "first").unionByName(near.join(exact, "line").select("line", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs, all rows and columns, `text` without the boilerplate lines that another document keeps, and n_removed.

    n_removed: the lines taken out. Blank lines stay. Null texts stay null, and documents whose lines all go have the empty text.
    Where the key is null, boilerplate goes (a null key never is the smallest), but a line that rows without a key
    alone hold stays in all of them, so that no text is lost. Repeated rows are treated alike. An empty table gives no
    rows. Columns may have any names but n_removed.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *row_key(key, text), F.col(text).alias("_text"))
    spread = settled(boilerplate(docs, min_sites, key, text, site))
    gone = _meet(lines(docs, key, text, site), spread, spread.count()).filter(~F.col("key").eqNullSafe(F.col("first"))).groupBy("_id", "_text_hash").agg(F.collect_set("pos").alias("_gone"))
    stay = lambda cut: F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("_gone")), lambda i: F.get(cut, i))
    left = F.transform(F.array(F.split("_text", "\n", -1)), stay)[0]  # the text is split once, not for each line
    out = base.join(gone, ["_id", "_text_hash"], "left").withColumn("_new", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n")))
    names = [F.col("_new").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*names, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
