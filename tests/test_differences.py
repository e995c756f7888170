"""Where Spark and the queries' SQL read the same thing in two ways."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanscan import plans
from spanscan.functions import text as T
from spanscan.functions import triggers, variants
from spanscan.operators import attachments, provenance


def both(spark, tmp_path, name, table, rows, schema):
    """The rows of a query and of its SQL over one small table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = plans.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(f'"{x}"' for x in got.columns)} FROM ({plans.SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_bursts_without_a_time_and_in_any_zone(spark, tmp_path, zone):
    at = dt.datetime(2024, 3, 10, 1, 59, 30)  # a clock that goes forward at 2:00 makes 1:59:50 and 3:00:10 neighbours
    rows = [(i, at + dt.timedelta(seconds=s), k) for i, (s, k) in enumerate([(0, "a"), (20, "a"), (50, "a"), (79.9995, "a"), (80, "a"), (3640, "a"), (3650, None), (3660, None)])] + [(100, None, "a"), (101, None, "a"), (102, None, None)]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got, want = both(spark, tmp_path, "event_bursts", "events", rows, "event_id long, ts timestamp_ntz, event_type string")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want and len(got) == len(rows)


def test_letters_after_letters_that_are_not_ascii(spark, tmp_path):
    texts = ["micición y y jañ ñja", "ñ a b c d", "ña b c d é", "a\vb\vc\vd", "é_a b c d", "x\fa b\tc", ""]
    got, want = both(spark, tmp_path, "split_letters", "conversations", [(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    assert got == want


def test_readings_without_a_step_for_each_character():
    rng = random.Random(7)
    some = ["a", "Z", "0", "3", "@", "$", " ", "\n", "\t", "\v", "\r\n", "é", "а", "р", "ａ", "ﬁ", "​", "‍", "­", "́", "한", "ο", "x y z w", "🇩🇪", "±", "½", "ſ"]
    for n in range(3000):
        text = "".join(rng.choice(some[: 8 if n % 3 == 0 else 20 if n % 3 == 1 else len(some)]) for _ in range(rng.randrange(14)))
        plain = variants.normalised(text)
        other = variants.unleeted(plain)
        got = variants._readings(text, True)
        for kind, want, there in (("normal", plain, plain.text != text), ("leet", other, other.text not in (plain.text, text))):
            assert (got[kind] is not None) == there, (text, kind)
            if there:
                assert (got[kind]["text"], list(got[kind]["starts"]), list(got[kind]["ends"])) == (want.text, want.starts, want.ends), (text, kind)


def test_texts_that_hold_what_a_detector_asks_for():
    import re

    for d in plans.DETECTORS:
        asked = triggers.asks(d.pattern)
        assert asked == tuple(sorted(set(asked)))
    assert triggers.asks(r"(?:[0-9]|x)y") == () and triggers.asks(r"[0-9]?@{2}") == ("@",) and triggers.asks("(?i)[a-z]{40}") == () and triggers.asks(r"a{20}[A-Za-z]{20}") == ("run",)
    sample = "sk-ant-" + "a" * 30 + " 4111 1111 1111 1111 a.b@c.example 10.0.0.1 fe80::1 " + "A1" * 20
    for d in plans.DETECTORS:
        if re.search(d.pattern, sample):
            assert all({"0": re.search("[0-9]", sample), "run": re.search(r"[A-Za-z0-9_/+-]{20}", sample)}.get(a, a in sample) for a in triggers.asks(d.pattern)), d.type


def test_long_texts_are_read_once(spark):
    """What a query's plan computes for each row: windows only where they are wanted, no sorting of characters."""
    text = "".join(chr(97 + i % 7) for i in range(200_000)) + "é"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(F.round(T.entropy(F.col("t")), 9), F.round(T.entropy_of_long(F.col("t")), 9)).collect()]
    assert all(a == b for a, b in got)
    cut = df.select(provenance.windows_at(F.col("t"), F.array(F.lit(0), F.lit(150)), 1500, 500).alias("w"), F.get(provenance.windows(F.col("t"), 1500, 500), F.lit(150)).alias("v"), provenance.n_windows(F.col("t"), 1500, 500).alias("n")).first()
    assert [w["ix"] for w in cut["w"]] == [0, 150] and cut["w"][1]["text"] == cut["v"] == text[150_000:151_500] and cut["n"] == 200


def test_places_of_parts_are_those_of_the_parts():
    sizes = [10, attachments.BYTES_AT_ONCE + 1, 10, *[0] * 600]
    assert list(attachments._few(pa.array([b"x" * n for n in sizes], pa.binary()))) == [(0, 1), (1, 2), (2, 258), (258, 514), (514, 603)] and list(attachments._few(pa.array([], pa.binary()))) == [(0, 0)]
    body = b'--b\r\nContent-Disposition: form-data; name="n"; filename="f"\r\nContent-Type: a/b\r\n\r\none\r\n--b\n\nno headers\n--b\nX: y\n\n\r\n--b--\r\n'
    got = attachments._each(pa.array([body, None, b""], pa.binary()), pa.array(["b", "b", "b"]), attachments.PLACE, lambda b, lo, hi: {"n_bytes": hi - lo}).to_pylist()
    whole = attachments._each(pa.array([body, None, b""], pa.binary()), pa.array(["b", "b", "b"]), attachments.PART, lambda b, lo, hi: {"body": bytes(b[lo:hi])}).to_pylist()
    assert got[1:] == whole[1:] == [None, []] and [p["n_bytes"] for p in got[0]] == [len(p["body"]) for p in whole[0]]
    assert [p["body"] for p in whole[0]][0] == b"one" and all(body[p["first_byte"] : p["first_byte"] + len(p["body"])] == p["body"] for p in whole[0]) and whole[0][0]["filename"] == "f"


def test_plans_that_sort_and_scan_once(spark):
    plan = lambda name: plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan("flag_runs").count("Sort [") == 1
    assert "FileScan" not in plan("dampened_matches")  # the texts were scanned once, before the join
