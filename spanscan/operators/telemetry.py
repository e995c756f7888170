"""Metrics, audit and retention over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram in milliseconds; the last bucket has no bound.
BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def cumulative_histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, bound (null: none), n: how many values are at or below each bound."""
    wide = df.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{b}") for b in BOUNDS], F.count(value).alias("all"))
    buckets = F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"b{b}").alias("n")) for b in BOUNDS], F.struct(F.lit(None).cast("int").alias("bound"), F.col("all").alias("n")))
    return wide.select(by, F.inline(buckets))


def histogram_percentile(hist: DataFrame, by: str, p: float) -> DataFrame:
    """by, bound: the first bucket that holds the share p; null: beyond the last bound."""
    full = hist.groupBy(by).agg(F.max("n").alias("total"), F.array_sort(F.collect_list(F.struct(F.coalesce("bound", F.lit(2**31 - 1)).alias("bound"), "n"))).alias("b"))
    first = F.filter("b", lambda x: x["n"] >= F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p))))[0]["bound"]
    return full.select(by, F.nullif(first, F.lit(2**31 - 1)).alias("bound"))


def upsert_sums(old: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Old and new rows of counters added up by key."""
    return old.unionByName(delta).groupBy(key).agg(*[F.sum(c).alias(c) for c in old.columns if c != key])


def within_days(df: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def fixed_window_quota(df: DataFrame, by: str, ts: str, most: int, unit: str = "minute") -> DataFrame:
    """by, window, n, accepted, refused: of the writes in each window `most` are accepted. Counts alone: no window is gathered."""
    return df.groupBy(by, F.date_trunc(unit, F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("window")).agg(F.count("*").alias("n")).select(by, "window", "n", F.least("n", F.lit(most)).alias("accepted"), F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and the smallest `order` of each: replays dropped."""
    return df.groupBy(*keys).agg(F.min(order).alias(order), F.count("*").alias("n"))


def quality(df: DataFrame, by: str, gold: str, predicted: str) -> DataFrame:
    """by, n, tp, fp, fn, precision, recall, f1."""
    g, p = F.col(gold) == 1, F.col(predicted) == 1
    n = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    over = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return n.select("*", over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))
