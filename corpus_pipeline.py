"""A corpus through the training-data operators, stage by stage: quality, near-duplicates, repeated passages, privacy, packing.

Each stage takes all that the one before it kept and returns the columns of ``documents``, the last one the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import minhash, packing, pii, quality, suffix
from veilspark.llm._common import Scratch


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of characters of its present texts."""
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return docs if kind is None else docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id, rows without an id coming last.

    Rows are told apart by a key of their own, so of rows that repeat both id and text one stays, and rows of one id with different texts are judged
    each by its own text. Texts without words are copies of nothing: all of them stay.
    """
    rows = Scratch(spark).save(docs.withColumn("row__", F.monotonically_increasing_id()), "rows")
    groups = minhash.near_duplicates(rows, doc_id="row__").select(F.col("doc_id").alias("row__"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", F.xxhash64("text").alias("tie"), "row__")
    first = groups.join(rows.select("row__", order.alias("order__")), "row__").groupBy("component_id").agg(F.min("order__").alias("order__"))
    return rows.join(first.select("order__.row__"), "row__", "left_semi").select(*docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 250 bytes (about fifty words) or more that stand earlier in the corpus go; the first copy stays."""
    return _counted(suffix.deduplicate(docs, suffix.PASSAGE))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return _counted(pii.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets and batches for training."""
    return packing.bucket_batches(docs)


STAGES = [("quality", clean), ("near", distinct), ("suffix", unrepeated), ("pii", private), ("packing", packed)]
#: No SQL says what a fitted model or a suffix order does; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each from a written table."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)  # stages read their input more than once
    return STAGES[-1][1](spark, docs, sf_dir)
