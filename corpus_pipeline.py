"""A training corpus from ``documents`` in stages, each calling one operator of the subpackage.

Every stage but the last returns the columns of ``documents``. Rows of one id go or stay together.
A null id is an id like any other; null text is empty, except that the suffix-array stage leaves it
null where nothing was removed. Columns beyond those of ``documents`` are left out. An empty table
passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areametrics.llm import minhash, packing, quality, rules, suffixes
from areametrics.llm.common import importable
from areametrics.sources.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept``."""
    ids = kept.select(F.col("doc_id").alias("_id"))
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality posterior does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _only(docs, quality.judge(docs, labels).where("kept"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, by their strict limits too."""
    return _only(docs, rules.judge(docs).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies on shingles of five words: the least id."""
    return _only(docs, minhash.judge(docs, percent=80, size=5).where("kept"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 100 that start earlier, with the new length. A
    document of which nothing is left goes."""
    found = suffixes.dedup(docs, with_text=True).select(
        F.col("doc_id").alias("_id"), "n_removed", F.col("kept_text").alias("_text")
    )
    joined = docs.select("doc_id", "lang", "source", "n_chars", F.col("text").isNull().alias("_none")).join(
        found, F.col("doc_id").eqNullSafe(F.col("_id"))
    )
    text = F.when(~F.col("_none") | (F.col("n_removed") > 0), F.col("_text"))
    out = joined.where("n_removed = 0 OR octet_length(_text) > 0").withColumn("text", text)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids, a row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]
#: The stages learn models and cut texts by token ids, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
