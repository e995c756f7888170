"""Streamed responses put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how much of a stream's end is kept for matching across chunks.
TAIL = 4096


#: Numbers of a stream's chunks that are put together first.
STRETCH = 1024


def tails(chunks: DataFrame, stream: str, seq: str, chunk: str, tail: int = TAIL) -> DataFrame:
    """stream, n_chunks, tail: the last characters of a stream's chunks in order of their numbers.

    Stretches of chunks are cut to their own tails first; of these, only the last that make up `tail` characters are put
    together. So a stream of any length is never gathered in one place.
    """
    joined = lambda order, text: F.right(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), ""), F.lit(tail))
    cut = chunks.select(stream, seq, F.floor(F.col(seq) / STRETCH).alias("stretch"), F.right(chunk, F.lit(tail)).alias("text"))
    each = cut.groupBy(stream, "stretch").agg(F.count("*").alias("n"), F.coalesce(joined(seq, "text"), F.lit("")).alias("text"))
    later = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy(stream).orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = each.withColumn("later", later).withColumn("text", F.when(F.col("later") < tail, F.col("text")))
    return ends.groupBy(stream).agg(F.sum("n").alias("n_chunks"), joined("stretch", "text").alias("tail"))


def counts_by_window(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """by, start, n over a stream or a table: event counts in tumbling windows; rows later than `late` are left to the next batch job."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("start"), "n")
