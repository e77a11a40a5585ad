"""The engine's front door: functions for DataFrames, and names for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks, draw
from .operators import detect, fields, pseudonymise, review, structured, tables
from .operators.detect import Pattern
from .sources import formats, leaves, splits

__all__ = ["Pattern", "detect", "fields", "leaves", "mask_column", "read_files", "pseudonymise", "pseudonymise_files", "read_large", "register_functions", "register_views", "review", "structured", "with_patterns"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of files of any format, with refused files as problems."""
    files = formats.read(spark, path)
    good = leaves.leaves(files.where("refused is null"), "path", "text", "format")
    bad = files.where("refused is not null").select(F.col("path").alias("doc_id"), F.lit(0).cast("long").alias("leaf_id"), F.lit("problem").alias("kind"), F.lit("$").alias("path"), F.lit("").alias("key"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"), F.array().cast("array<long>").alias("record_ids"), F.col("refused").alias("problem"))
    return good.unionByName(bad)


def read_large(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Leaves of files of any size, of which many tasks read ranges: ``csv``, ``jsonl`` or ``text`` (a leaf for each line)."""
    if kind == "csv":
        return splits.csv_leaves(spark, path)
    if kind == "jsonl":
        return splits.json_lines(spark, path)
    if kind != "text":
        raise ValueError(f"{kind} files are not read by ranges")
    rows = splits.lines(spark, path).withColumn("doc_id", F.concat_ws("#", "path", "block", "at"))
    return leaves.leaves(rows.withColumn("kind", F.lit("text")), text="value", kind="kind")


def pseudonymise_files(spark: SparkSession, path: str, seed: str) -> DataFrame:
    """Files of a folder pseudonymised in their own formats: path, output, n_values, problem; refused files have only a problem."""
    files = formats.read(spark, path)
    good = structured.pseudonymise_documents(files.where("refused is null"), seed, "path", "text", "format").withColumnRenamed("doc_id", "path")
    none = F.lit(None).cast("string")
    return good.unionByName(files.where("refused is not null").select("path", none.alias("output"), F.lit(0).cast("long").alias("n_values"), F.col("refused").alias("problem")))


def with_patterns(*more: Pattern) -> tuple[Pattern, ...]:
    """The bank with a user's own patterns before it."""
    return (*more, *detect.BANK)


def mask_column(df: DataFrame, column: str, seed: str, entity: str | None = None) -> DataFrame:
    """A table with one column's values replaced consistently, so that joins on it still work: null stays null, equal stays equal.

    Without ``entity`` a value becomes 24 keyed hexadecimal digits, so different values stay different. The forms of an entity look real, but short ones
    are few and may meet.
    """
    value = F.col(column).cast("string")
    made = F.substring(draw.stream(seed, "dataset", "KEY", value), 1, 24) if entity is None else draw.DRAWS[entity](value, seed, "dataset")
    return df.withColumn(column, F.when(F.col(column).isNotNull(), made))


def register_views(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id") -> None:
    """SQL views over documents: ``pii_spans`` (key, start, end, entity, score, value) and ``pii_counts`` (entity, n)."""
    found = detect.detect(docs.select(key, F.col(text).alias("text"))).select(key, F.explode("spans").alias("s")).select(key, "s.*")
    found.createOrReplaceTempView("pii_spans")
    spark.sql("select entity, count(*) as n from pii_spans group by entity").createOrReplaceTempView("pii_counts")


def luhn(df: DataFrame, column: str) -> DataFrame:
    """``df`` with whether a column's digits pass the mod-10 check."""
    return df.withColumn(f"{column}_luhn", checks.luhn(checks.digits(F.col(column))))


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL, to be joined laterally: ``pii_spans(text)`` and ``pii_leaves(document, format)`` (a null format is sniffed).

    ``select d.doc_id, s.* from documents d, lateral pii_spans(d.text) s``
    """
    for name, function in tables.FUNCTIONS.items():
        spark.udtf.register(name, function)
