"""Tables that change: each change writes a new version as a Parquet table, and a row of a log, written last, makes it the one that is read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "n long, version string, batch string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors both write: below spark.checkpoint.dir. One of this machine only where Spark is local and no such setting is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spanscan-")
    return f"{base.rstrip('/')}/versions-{uuid.uuid4().hex}"


class Versions:
    """A table under a folder, for one writer at a time and any number of readers.

    A change of a batch that is in the log already does nothing, so a batch may be sent again. What a change left that
    stopped before its row of the log isn't read. Rows read before a change stay readable after it, as old versions
    aren't removed. Repeated rows and null keys are kept, and a table without versions is empty.
    """

    def __init__(self, spark: SparkSession, at: str, schema: str):
        self.spark, self.at, self.schema = spark, at, schema

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.at}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # no change has been made yet
                raise
            return self.spark.createDataFrame([], LOG)

    @property
    def rows(self) -> DataFrame:
        last = self._log().orderBy(F.desc("n")).first()
        return self.spark.read.schema(self.schema).parquet(f"{self.at}/{last['version']}") if last else self.spark.createDataFrame([], self.schema)

    def change(self, batch: str, to: Callable[[DataFrame], DataFrame]) -> bool:
        """Writes to(rows) as the next version; False where the batch was applied before."""
        log = self._log()
        known = log.agg(F.max("n").alias("n"), F.coalesce(F.bool_or(F.col("batch") == batch), F.lit(False)).alias("done")).first()
        if known["done"]:
            return False
        name = f"version-{uuid.uuid4().hex}"
        to(self.rows).write.parquet(f"{self.at}/{name}")
        entry = self.spark.createDataFrame([((known["n"] or 0) + 1, name, batch)], LOG)
        entry.coalesce(1).write.mode("append").parquet(f"{self.at}/log")
        return True

    def add_up(self, batch: str, delta: DataFrame, key: str) -> bool:
        """Counters by key, with those of a batch added."""
        add = lambda old: old.unionByName(delta).groupBy(key).agg(*[F.sum(c).cast(t).alias(c) for c, t in old.dtypes if c != key]).select(*old.columns)
        return self.change(batch, add)

    def keep_newest(self, batch: str, rows: DataFrame, order: list[Column], most: int = 100) -> bool:
        """The first rows by an order, of those that are stored and those of a batch."""
        return self.change(batch, lambda old: old.unionByName(rows).orderBy(*order).limit(most))

    def drop_expired(self, batch: str, ts: str, now: str, days: int) -> bool:
        """Without the rows that are older than so many days; a row without a time stays."""
        fresh = F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
        return self.change(batch, lambda old: old.filter(F.coalesce(fresh, F.lit(True))))

    def insert_within(self, batch: str, rows: DataFrame, by: str, ts: str, key: str, most: int, unit: str = "minute") -> bool:
        """Adds of a batch, for each `by` and window of time, the first rows by ts and key, until the window holds `most`; all others are refused.

        Stored rows are counted by window. Of a batch no task holds more than `most` rows of a window from each of its
        partitions, as the rank is limited before rows meet.
        """
        window = lambda df: df.withColumn("_window", F.date_trunc(unit, F.col(ts).cast("timestamp")))

        def insert(old: DataFrame) -> DataFrame:
            held = window(old).groupBy(F.col(by).alias("_by"), "_window").agg(F.count("*").alias("_held"))
            first = window(rows).withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_window").orderBy(ts, key))).filter(F.col("_rank") <= most).alias("r")
            same = F.col(f"r.{by}").eqNullSafe(F.col("h._by")) & F.col("r._window").eqNullSafe(F.col("h._window"))
            taken = first.join(held.alias("h"), same, "left").filter(F.col("_rank") + F.coalesce("_held", F.lit(0)) <= most)
            return old.unionByName(taken.select(*[F.col(f"r.{c}") for c in old.columns]))

        return self.change(batch, insert)
