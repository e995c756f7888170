"""Each query that SQL can express against DuckDB, and the operators' edges."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from spanscan import plans
from spanscan.functions import text as T
from spanscan.functions import wire
from spanscan.operators import context, telemetry
from spanscan.sources.tables import rules
from spanscan.streaming import reassembly

TABLES = Path("/root/testdata/sf0.001")


def plain(rows, names):
    return sorted(repr([round(float(r[n]), 6) if isinstance(r[n], float) else r[n] for n in sorted(names)]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, str(TABLES))
    got = [r.asDict() for r in df.collect()]
    if name in plans.SQL:
        want = duck.execute(plans.SQL[name]).df().astype(object)
        want = [{k: None if v != v else v for k, v in r.items()} for r in want.to_dict("records")]
        number = lambda rows: [{k: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else bool(v) if type(v).__name__ == "bool_" else v for k, v in r.items()} for r in rows]
        assert plain(number(got), df.columns) == plain(number(want), df.columns)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("f", "good", "bad"),
    [
        (T.luhn, ["4111 1111 1111 1111", "5500-0000-0000-0004"], ["4111 1111 1111 1112", "0000000000000000", "", None, "abc"]),
        (T.siren, ["732829320", "732 829 320"], ["732829321", "000000000", "", None]),
        (T.ssn, ["123-45-6789", "123456789"], ["000-45-6789", "666-45-6789", "912-45-6789", "123-00-6789", "123-45-0000", "x", None]),
        (T.iban, ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "gb82west12345698765432"], ["GB82WEST12345698765433", "GB82", "", None]),
        (T.npi, ["1234567893", "12 3456 7893"], ["1234567890", "1111111111", "123", "", None]),
        (T.ipv4, ["10.0.0.1", "255.255.255.0"], ["0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "", None]),
        (T.nino, ["AB123456C", "ab 12 34 56 c"], ["GB123456C", "DA123456C", "AB123456E", "", None]),
        (T.siret, ["732 829 320 00074", "35600000000001"], ["73282932000075", "00000000000000", "35600000000002", "", None]),
        (T.nir, ["255081416802538", "2 55 08 14 168 025 38", "1850320000001" + f"{97 - 1850320000001 % 97:02d}", "185032A000001" + f"{97 - 1850319000001 % 97:02d}", "285032b000001" + f"{97 - 2850318000001 % 97:02d}"], ["255081416802539", "955081416802538", "255131416802538", "185002A00000111", "", None]),
        (T.postcode, ["SW1A 1AA", "m1 1ae", " GIR 0AA ", "B33 8TH", "CR2 6XH", "DN55 1PT", "W1A 0AX", "EC1A1BB"], ["QQ1 1AA", "SW1A", "AI1 1AA", "W1I 0AX", "EC1C 1BB", "B33 8TC", "B333 8TH", "SW1A  1AA", "", None]),
        (T.jwt, ["eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.c2ln"], ["a.b", "eyJhIjoxfQ.b.c", "eyJhbGciOjF9.b.c", "..", "", None]),
        (T.ipv6, ["fe80::1", "2001:db8:0:0:0:0:0:1", "::ffff"], ["::", "1:2:3:4:5:6:7:8", "1::2::3", "12345::", "x::1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "", None]),
        (T.generic_secret, ["a8Fk29dLmQ0zXc7VbN3rTy6UiOp1WsEe"], ["a1" * 20, "short1", "", None]),
        (T.nhs, ["9434765919", "943 476 5919", "943-476-5919"], ["9434765918", "0000000000", "", None, "abcdefghij"]),
    ],
)
def test_validators(spark, f, good, bad):
    assert all(one(spark, v, f) is True for v in good) and all(one(spark, v, f) is False for v in bad)


def test_text_functions(spark):
    assert one(spark, "a10 1gn0r3 42 @b", T.plain_leet) == "aio ignore 42 ab" or one(spark, "a10", T.plain_leet) == "ai0"
    assert one(spark, "", T.entropy) == 0.0 and one(spark, "abab", T.entropy) == 1.0 and one(spark, None, T.entropy) is None
    assert one(spark, "p​аy", lambda c: T.strip_invisible(T.fold_lookalikes(c))) == "pay"


def test_letters_and_wrappers(spark):
    assert one(spark, "so i g n o r e, a b c", T.joined_letters) == "so ignore, a b c" and one(spark, "a b c d efg", T.joined_letters) == "abcdefg"
    assert one(spark, "", T.joined_letters) == "" and one(spark, None, T.joined_letters) is None
    assert one(spark, '<document id="1">a\nb</document> <SEARCH_RESULT>c</SEARCH_RESULT>', T.wrapped) == ["a\nb", "c"]


def test_wire(spark):
    kind = lambda b: spark.createDataFrame([(b,)], "v binary").select(wire.sniff(F.col("v"))).first()[0]
    heads = [b"%PDF-1.7", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"GIF89a", b"RIFF\0\0\0\0WEBP", b"ID3\x04", b"\xff\xfb\x90", b"\0\0\0\x18ftypheic", b"\0\0\0\x18ftypM4A ", b"plain", b"", None]
    assert [kind(h) for h in heads] == ["pdf", "image", "image", "image", "image", "audio", "audio", "image", "audio", None, None, None]
    assert one(spark, "a\n\nb\r\n\r\nrest", wire.frames) == ["a", "b"] and one(spark, "", wire.frames) == []
    assert one(spark, 'data: {"choices":[{"delta":{"content":"hi"}}]}', wire.delta_text) == "hi" and one(spark, "data: [DONE]", wire.delta_text) is None and one(spark, "data: odd", wire.delta_text) == "odd "
    assert one(spark, "../a b.txt", wire.file_name) == "..ab.txt" and one(spark, "/", wire.file_name) == "file" and one(spark, "%zz", wire.url_decoded) == "%zz"
    assert one(spark, "x", lambda c: wire.safe_header(F.lit("X-A"), c)) is True and one(spark, "x\r\ny", lambda c: wire.safe_header(F.lit("X-A"), c)) is False
    assert one(spark, "x", lambda c: wire.proof_of_work(c, F.lit("1"), 0, F.lit(10))) is True and one(spark, "x", lambda c: wire.proof_of_work(c, F.lit("1"), 0, F.lit(121))) is False
    assert one(spark, "x", lambda c: context.even_places(F.lit(10), 4)) == [0, 3, 6, 9] and one(spark, "x", lambda c: context.even_places(F.lit(0), 4)) == []


def test_catalog_and_telemetry(spark, tmp_path):
    at = tmp_path / "rules.json"
    at.write_text(json.dumps([{"id": "a", "category": "c", "severity": "low", "pattern": "x+", "enabled": True}, {"id": "b", "category": "c", "severity": "low", "pattern": "y", "enabled": False}]))
    assert [r.id for r in rules(spark, str(at))] == ["a"]
    at.write_text(json.dumps([{"id": "a", "category": "c", "severity": "low", "pattern": "("}]))
    with pytest.raises(Exception, match="REGEX|regex|Unclosed"):  # Spark's own word on it
        rules(spark, str(at))
    at.write_text(json.dumps([{"id": "a", "category": "c", "severity": "low", "pattern": "x*"}]))
    with pytest.raises(ValueError, match="empty text"):
        rules(spark, str(at))
    df = spark.createDataFrame([("a", 0.5), ("a", 7.0), ("a", 5000.0), ("a", None)], "k string, v double")
    hist = telemetry.cumulative_histogram(df, "k", "v")
    assert {r["bound"]: r["n"] for r in hist.collect()} == {1: 1, 5: 1, 10: 2, 25: 2, 50: 2, 100: 2, 250: 2, 500: 2, 1000: 2, None: 3}
    assert telemetry.histogram_percentile(hist, "k", 0.5).first()["bound"] == 10 and telemetry.histogram_percentile(hist, "k", 0.99).first()["bound"] is None


def test_tails_of_long_streams(spark, monkeypatch):
    monkeypatch.setattr(reassembly, "STRETCH", 4)
    rows = [("a", i, f"chunk {i} " * (i % 3)) for i in range(50)] + [("b", 0, None), ("b", 1, "x"), ("c", 7, "")]
    got = {r["s"]: (r["n_chunks"], r["tail"]) for r in reassembly.tails(spark.createDataFrame(rows, "s string, i long, t string"), "s", "i", "t", 60).collect()}
    assert got == {"a": (50, "".join(t for s, _, t in rows if s == "a")[-60:]), "b": (2, "x"), "c": (1, "")}


def test_windows_over_a_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.col("t").cast("timestamp").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = reassembly.counts_by_window(stream, "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
