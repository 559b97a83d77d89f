"""Corpus pipeline: quality rules, near duplicates, pseudonyms, source mixing,
packing.  Each stage gets what the one before it kept, reread from Parquet.

Every stage takes whole texts of any length, null values in any column, and empty
tables (which give empty tables).  What each does with null, empty and repeated texts
and with ties stands at the stage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bestfit_packing, compression_quality, minhash_tensored, pii_pseudonyms, pivotal_mixing
from scriptorium.llm.common import table
from scriptorium.llm.queries import PSEUDONYM_KEY
from scriptorium.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands.  Null, empty and
    blank texts fail; repeated rows are judged alike, each on its own; a very long text
    is judged whole and chunk by chunk."""
    return compression_quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the smallest id, or without an id
    where the group has none.  Repeated rows are one group; of rows that tie in id and
    text one stays.  Rows without words (null, empty, blank) are near nothing and stay."""
    return minhash_tensored.keep_one(docs, width=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced; n_chars follows the text.  Null texts
    stay null, empty ones empty; repeated rows get the same text."""
    out = pii_pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.  Null and empty texts have size 0
    and weigh nothing; of repeated rows a part is taken once more than the rest; a null
    source is a source of its own."""
    return pivotal_mixing.repeat(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids in planned sequences.  A null or empty text is its
    closing id alone; a text taken twice is packed twice; very long ones are cut."""
    return bestfit_packing.best_fit_pack(docs).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixing", mixing), ("packing", packing)]
#: compression ratios, random rounding and library tokens have no SQL form
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder
    and read again, and removed when the next one is written; the last one stays."""
    folder, before = os.path.join(checkpoint_dir(spark), f"corpus-pipeline-{uuid.uuid4().hex}"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
