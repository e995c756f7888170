"""A corpus made ready for training: five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all rows that the one before kept, repeated ones and those with a null id among them, and gives an
empty table for an empty one. All but the last return the columns of their input, whatever others there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanscan.llm import bpe, decontam, linededup, neardup, queries, toxicity
from spanscan.llm.common import remainder, shared_folder

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC; null and empty texts have the base rate's score and stay, equal texts go or stay alike.

    The labels of the held-out quarter aren't learned from here either. Without labels all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 4) != 2)
    return docs.filter(toxicity.score("text", toxicity.fit(docs, labels)) < TOXIC)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share and another document keeps; n_chars follows the text.

    Null texts stay null. What rows without an id do is said at `dedup_lines`.
    """
    out = linededup.dedup_lines(docs, queries.MIN_SITES)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the five-word shingles shared), that with the smallest id; a null id is the smallest.

    Null, empty and wordless texts are one group. Of repeated rows the first stays.
    """
    return neardup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; null and empty texts hold none. With an empty benchmark all stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, exact: whether the ids decode to the text. Null texts are encoded as empty ones, which have no ids."""
    done = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("was"), bpe.encoded("text", queries._vocabulary()).alias("e"))
    return done.select("doc_id", "lang", "source", "e.ids", F.size("e.ids").cast("long").alias("n_tokens"), (F.col("e.decoded_sha256") == F.col("was")).alias("exact"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate), ("near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on `documents`; tables between them are in the shared folder."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs


#: SQL has no Viterbi decoding, no min-hashes and no BPE: the tests hold the stages against plain versions.
ORACLE_SQL = None
