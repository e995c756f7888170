"""Tables that change: batches sent again, writers that stop, rows read while they change."""

import pytest
from pyspark.sql import functions as F

from spanscan.sources.versions import Versions

SCHEMA = "k string, n long, at timestamp_ntz"


def test_batches_count_once_and_stopped_changes_are_not_read(spark, tmp_path):
    at = str(tmp_path / "t")
    t = Versions(spark, at, "k string, n long")
    rows = lambda *r: spark.createDataFrame(r, "k string, n long")
    assert t.rows.collect() == []
    assert t.add_up("a", rows(("x", 1), ("x", 2), (None, 5)), "k") and t.add_up("b", rows(("x", 10), ("y", 1)), "k")
    assert not Versions(spark, at, "k string, n long").add_up("a", rows(("x", 1)), "k")  # another session
    want = {("x", 13), (None, 5), ("y", 1)}
    assert {tuple(r) for r in t.rows.collect()} == want
    before = t.rows
    broken = F.udf(lambda n: 1 // 0, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        t.change("c", lambda old: old.withColumn("n", broken("n")))
    spark.range(3).write.parquet(f"{at}/version-left-over")  # written, but its writer stopped before the log
    assert {tuple(r) for r in t.rows.collect()} == want
    assert t.change("c", lambda old: old.filter("k = 'x'")) and [tuple(r) for r in t.rows.collect()] == [("x", 13)]
    assert {tuple(r) for r in before.collect()} == want  # what was read before the change
    assert t.add_up("d", rows(), "k") and t.rows.count() == 1


def test_quota_newest_and_expiry(spark, tmp_path):
    row = lambda k, n, at: (k, n, at)
    made = lambda *r: spark.createDataFrame(r, "k string, n long, at string").withColumn("at", F.to_timestamp_ntz("at"))
    t = Versions(spark, str(tmp_path / "q"), SCHEMA)
    t.insert_within("1", made(*[row("hot", i, "2024-01-01 00:00:30") for i in range(500)], row("b", 1, "2024-01-01 00:00:59"), row(None, 7, "2024-01-01 00:00:00"), row("b", 3, None)), "k", "at", "n", 3)
    assert sorted((r["k"] or "", r["n"]) for r in t.rows.collect()) == [("", 7), ("b", 1), ("b", 3), ("hot", 0), ("hot", 1), ("hot", 2)]
    t.insert_within("2", made(row("hot", 900, "2024-01-01 00:00:00"), row("hot", 901, "2024-01-01 00:01:00"), *[row("b", i, "2024-01-01 00:00:01") for i in (4, 5, 6)], *[row(None, 8, "2024-01-01 00:00:00")] * 3), "k", "at", "n", 3)
    assert sorted((r["k"] or "", r["n"]) for r in t.rows.collect()) == [("", 7), ("", 8), ("", 8), ("b", 1), ("b", 3), ("b", 4), ("b", 5), ("hot", 0), ("hot", 1), ("hot", 2), ("hot", 901)]
    t.drop_expired("3", "at", "2024-01-02 00:01:00", 1)
    assert sorted(r["n"] for r in t.rows.collect()) == [3, 901]
    n = Versions(spark, str(tmp_path / "n"), SCHEMA)
    for batch in ("1", "2", "2"):
        n.keep_newest(batch, made(*[row("k", 10 * int(batch) + i, None) for i in range(5)]), [F.desc("n")], 7)
    assert sorted(r["n"] for r in n.rows.collect()) == [13, 14, 20, 21, 22, 23, 24]
