"""Matches in the light of what stands around them: dampeners, benign cover, overlaps, bursts, label runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import SEVERITY, merged

#: How near a dampener acts, in characters; categories that make an action dangerous; the least mean probability of a run.
WITHIN = 200
DANGEROUS = ("data-exfiltration", "credential-leak", "sandbox-escape")
SURE = 0.55
#: Characters in a bin of the proximity join.
BIN = 1024


def _bins(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN)))


def dampened(matches: DataFrame, dampeners: DataFrame, key: str, within: int = WITHIN) -> DataFrame:
    """matches with `dampen`: the least of the dampeners within `within` characters, 1.0 where there is none.

    dampeners: key, start, end, dampen. Both sides are cut in bins of characters, so a pair is looked for inside a bin
    of a text, never over all of it.
    """
    spot = [key, "rule", "start", "end"]
    m = matches.select(*spot).distinct().withColumn("bin", _bins(F.col("start"), F.col("end")))
    d = dampeners.select(key, F.col("start").alias("d_start"), F.col("end").alias("d_end"), "dampen", _bins(F.col("start") - within, F.col("end") + within).alias("bin"))
    gap = F.greatest(F.lit(0), F.col("d_start") - F.col("end"), F.col("start") - F.col("d_end"))
    near = m.join(d, [key, "bin"]).filter(gap <= within).groupBy(*spot).agg(F.min("dampen").alias("dampen"))
    return matches.join(near, spot, "left").withColumn("dampen", F.coalesce("dampen", F.lit(1.0)))


def benign_multiplier(docs: DataFrame, dampeners: DataFrame, key: str, text: str = "text", within: int = WITHIN) -> DataFrame:
    """key, multiplier: 1 less the share of a text near dampeners times what the strongest of these takes off. A row for each row of docs."""
    size = docs.select(key, F.length(text).alias("length"))
    near = dampeners.join(size, key).select(key, F.greatest(F.lit(0), F.col("start") - within).alias("start"), F.least("length", F.col("end") + within).alias("end"))
    cover = merged(near, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    least = dampeners.groupBy(key).agg(F.min("dampen").alias("least"))
    off = F.col("covered") / F.col("length") * (F.lit(1.0) - F.col("least"))
    return size.join(cover, key, "left").join(least, key, "left").select(key, F.coalesce(F.lit(1.0) - off, F.lit(1.0)).alias("multiplier"))


def best_of_overlaps(matches: DataFrame, key: str) -> DataFrame:
    """key, rule, category, severity, start, end: of matches that overlap, one through another, the heaviest, then the longest, then by names."""
    w = Window.partitionBy(key).orderBy("start", "end", "rule")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    best = F.max(F.struct(weight[F.col("severity")].alias("w"), (F.col("end") - F.col("start")).alias("n"), "rule", "category", "severity", "start", "end")).alias("m")
    return matches.withColumn("before", before).withColumn("island", island).groupBy(key, "island").agg(best).select(key, "m.rule", "m.category", "m.severity", "m.start", "m.end")


def label_runs(tokens: DataFrame, key: str, pos: str, label: str, probability: str, outside: str = "O", least: float = SURE) -> DataFrame:
    """key, label, first, last, n, mean: unbroken runs of one label whose mean probability is `least` or more."""
    w = Window.partitionBy(key).orderBy(pos)
    other = tokens.withColumn("run", F.lag(label).over(w)).withColumn("run", F.when(F.col("run").eqNullSafe(F.col(label)), 0).otherwise(1))
    run = F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, 0))  # of the same order as the lag, so rows are sorted once
    runs = other.withColumn("run", run).filter(F.col(label) != outside).groupBy(key, label, "run").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n"), F.avg(probability).alias("mean"))
    return runs.filter(F.col("mean") >= least).drop("run")


def _wall_millis(ts: Column) -> Column:
    """Milliseconds from 1970 on of a time without a zone, by its own calendar and clock; no cast, which would go through the session's zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def trailing_counts(events: DataFrame, by: str, ts: str, seconds: int = 60) -> DataFrame:
    """events with `trailing`: how many of the same `by` came in the `seconds` up to and with each. Those without a time count as one moment of their own.

    Each event goes to its own stretch of time and, as context, to the next, so a key of very many events is counted
    in as many tasks as it has stretches. A time without a zone is taken as it stands: the session's zone has no say in it.
    """
    width = seconds * 1000
    zoneless = events.schema[ts].dataType.simpleString() == "timestamp_ntz"
    ms = F.unix_millis(F.col(ts).cast("timestamp")) if not zoneless else _wall_millis(F.col(ts))
    own_stretch = F.floor(F.col("ms") / width)
    of = F.when(F.col("ms").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(own_stretch, own_stretch + 1))
    own = events.withColumn("ms", ms).withColumn("stretch", F.explode(of))
    recent = Window.partitionBy(by, "stretch").orderBy("ms").rangeBetween(-(width - 1), 0)
    return own.withColumn("trailing", F.count("*").over(recent)).filter(F.col("stretch").eqNullSafe(own_stretch)).drop("ms", "stretch")


def even_places(n: Column, most: int) -> Column:
    """Up to `most` places from 0 to n - 1, evenly spread, first and last among them; all places where they are no more than `most`."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (n - 1) / (most - 1)).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(spread)


def with_calls(results: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Each result with the call of the same keys; keys that several calls share belong to none of them."""
    rest = [c for c in calls.columns if c not in keys]
    single = calls.groupBy(*keys).agg(F.count("*").alias("__n"), *[F.any_value(c).alias(c) for c in rest]).filter("__n = 1").drop("__n")
    return results.join(single, keys, "left")


def action_severity(actions: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """actions of a dangerous category with `severity`: critical where their request held untrusted content, else medium.

    actions: key, categories (array). requests: key, had_untrusted, a row for each key.
    """
    bad = actions.filter(F.arrays_overlap("categories", F.array(*map(F.lit, DANGEROUS))))
    return bad.join(requests.select(key, "had_untrusted"), key, "left").withColumn("severity", F.when(F.coalesce("had_untrusted", F.lit(False)), "critical").otherwise("medium")).drop("had_untrusted")


def latest_of_each(samples: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of each key, the one that is last by `order`."""
    rest = [c for c in samples.columns if c != key]
    return samples.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def newest(samples: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each `by` in an order, with their place: a top-k report, cut before the shuffle by the planner."""
    return samples.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)
