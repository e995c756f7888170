"""What several of the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key's text modulo `modulus`; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own if all of Spark is in this process, as in tests; on a cluster, an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spanscan-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """As `settled`, as a Parquet table, packed more tightly than by default: later readers take only the columns they need."""
    at = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def in_few(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """The same rows in as few partitions as so many rows need: small tables in rounds of joins cost tasks and files more than anything else."""
    return df.coalesce(max(1, -(-rows // per_task)))


def numbered(df: DataFrame) -> DataFrame:
    """row (a struct of all columns, so that no name of theirs meets one of ours) and place, a number; written once, so that all readers see the same numbers."""
    return written(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("place")), "numbered")


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two columns that tell rows apart; repeated rows share them, and null ids are told apart by their text."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("\u0000")).alias("_id"), F.xxhash64(text_col).alias("_text_hash")
