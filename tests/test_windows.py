"""Windows that start at the first event, held to a loop."""

import random

from pyspark.sql import functions as F

from spanscan.operators import audit


def by_loop(rows, width):
    out, open_since = {}, {}
    for k, ms in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1])):
        if k not in open_since or ms - open_since[k] >= width:
            open_since[k] = ms
        out[k, open_since[k]] = out.get((k, open_since[k]), 0) + 1
    return out


def run(spark, rows, seconds):
    df = spark.createDataFrame(rows, "k int, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    return audit.windows_from_first(df, "k", "ts", seconds).select("k", F.unix_millis(F.col("start").cast("timestamp")).alias("ms"), "n")


def test_windows_by_a_loop(spark, monkeypatch):
    rng = random.Random(3)
    for slices in (1, 2, 64):  # windows across the ends of slices, in each of them and beyond
        monkeypatch.setattr(audit, "SLICE", slices)
        rows = [(None, 5), (7, None), (8, -1), (8, -61_001), (9, 10)]
        for k in range(6):
            at = rng.randrange(10**6)
            for _ in range(400):
                at += rng.choice([0, 1, 999, 1000, 1001, 400 * k, 9_000 * k, 70_000])
                rows.append((k, at))
        rows += [(20, i * 130) for i in range(3000)] + [(21, 500)] * 40
        assert {(r["k"], r["ms"]): r["n"] for r in run(spark, rows, 1).collect()} == by_loop(rows, 1000)
    assert run(spark, [(1, None)], 1).collect() == []


def test_a_steady_key_is_many_tasks(spark):
    """A million events without a pause: a slice holds few of them, and what meets by key is a small part."""
    steady = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.timestamp_millis(F.col("id") * 37).alias("ts"))
    got = [(r["ms"], r["n"]) for r in audit.windows_from_first(steady, "k", "ts", 10).select(F.unix_millis(F.col("start").cast("timestamp")).alias("ms"), "n").orderBy("ms").collect()]
    step = -(-10_000 // 37)
    assert got == [(i * 37, min(step, 1_000_000 - i)) for i in range(0, 1_000_000, step)]
