"""Stages that number rows, with file splits that change between their jobs, as when executors come or go."""

import pytest
from test_free import docs

from spanscan.llm import decontam, neardup, simhash

PASSAGE = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("stage", ["decontam", "simhash", "neardup"])
def test_splits_change_between_jobs(spark, tmp_path, stage):
    rows = [(i, f"{PASSAGE} {i}" if stage == "decontam" and i % 3 == 0 else f"{'same text as others' if i % 3 == 1 else f'a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}'}") for i in range(60)]
    docs(spark, rows).repartition(12).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64m")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64m")
        if stage == "decontam":
            out = decontam.clean(stored, docs(spark, [(1, PASSAGE)]).withColumnRenamed("doc_id", "item_id"))
            want = [i for i in range(60) if i % 3]
        else:
            out = {"simhash": simhash, "neardup": neardup}[stage].one_of_each(stored)
            want = [i for i in range(60) if i % 3 != 1 or i == 1]
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.files.minPartitionNum", "2")
        assert sorted(r["doc_id"] for r in out.collect()) == want
    finally:
        for k in ("openCostInBytes", "maxPartitionBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{k}")
