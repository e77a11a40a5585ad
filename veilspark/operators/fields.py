"""Decisions over whole fields: categories, identifier columns, the kind that most values have, people columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, keys, national, scan


def unpivoted(df: DataFrame, row: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(row, field, text) leaves of a table's columns; one pass over it."""
    columns = [c for c in (columns or df.columns) if c != row]
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns))
    return df.select(F.col(row).alias("row"), F.explode(pairs).alias("p")).select("row", "p.field", "p.text")


def categorical(leaves: DataFrame) -> DataFrame:
    """(field, n, n_distinct, categorical): four values or more, short, of one case, few kinds that repeat."""
    v = leaves.where("text is not null and text <> ''")
    stats = v.groupBy("field").agg(
        F.count("*").alias("n"),
        F.countDistinct("text").alias("n_distinct"),
        F.max(F.length("text")).alias("longest"),
        F.bool_and(F.col("text") == F.upper("text")).alias("all_upper"),
        F.bool_and(F.col("text") == F.lower("text")).alias("all_lower"),
    )
    good = (F.col("n") >= 4) & (F.col("longest") <= 32) & (F.col("all_upper") | F.col("all_lower")) & (F.col("n_distinct") <= 12) & (F.col("n_distinct") < F.col("n"))
    return stats.select("field", "n", "n_distinct", good.alias("categorical"))


def identifier_columns(leaves: DataFrame, registry: Sequence[identifiers.Identifier] = identifiers.REGISTRY) -> DataFrame:
    """(field, kind, n_distinct, share) of fields nine in ten of whose four or more distinct values pass one kind's check; ties go to the earlier kind."""
    verifying = [k for k in registry if k.check not in (identifiers._shape, national.shape)]
    distinct = leaves.where("text is not null and text <> ''").select("field", "text").distinct()
    names = keys.literals(k.kind for k in verifying)
    whole = scan.matches(F.col("text"), [(f"^(?:{k.form})$", None, False) for k in verifying])
    found = distinct.withColumn("found__", whole).select("field", F.explode("found__").alias("m"))
    passed = found.where(identifiers.passes(F.col("m.pattern"), F.col("m.value"), verifying))
    votes = passed.select("field", F.struct((-F.col("m.pattern")).alias("rank"), F.element_at(names, F.col("m.pattern") + 1).alias("kind")).alias("k"))
    sizes = distinct.groupBy("field").agg(F.count("*").alias("n_distinct")).where("n_distinct >= 4")
    votes = votes.groupBy("field", "k").agg(F.count("*").alias("n"))
    best = votes.groupBy("field").agg(F.max_by("k", F.struct("n", "k.rank")).alias("k"), F.max("n").alias("n"))
    return best.join(sizes, "field").where(F.col("n") >= 0.9 * F.col("n_distinct")).select("field", "k.kind", "n_distinct", (F.col("n") / F.col("n_distinct")).alias("share"))


def majority(read: DataFrame) -> DataFrame:
    """(field, entity) that six in ten of two or more distinct values were read as; for giving to the unread ones at 0.8."""
    distinct = read.where("text is not null and text <> ''").select("field", "text", "entity").distinct()
    sizes = distinct.groupBy("field").agg(F.countDistinct("text").alias("n"))
    votes = distinct.where("entity is not null").groupBy("field", "entity").agg(F.countDistinct("text").alias("votes"))
    best = votes.groupBy("field").agg(F.max_by("entity", F.struct("votes", "entity")).alias("entity"), F.max("votes").alias("votes"))
    return best.join(sizes, "field").where((F.col("votes") >= 2) & (F.col("votes") >= 0.6 * F.col("n"))).select("field", "entity")


def carried(read: DataFrame) -> DataFrame:
    """``read`` with unread values of a decided field given its kind, at score 0.8, where they fit."""
    kinds = majority(read).withColumnRenamed("entity", "carried")
    give = F.col("entity").isNull() & F.col("carried").isNotNull() & F.coalesce(keys.fits(F.col("carried"), F.col("text")), F.lit(False))
    return read.join(kinds, "field", "left").select(
        *(c for c in read.columns if c not in ("entity", "score")), F.when(give, F.col("carried")).otherwise(F.col("entity")).alias("entity"), F.when(give, F.lit(0.8)).otherwise(F.col("score")).alias("score")
    )


def people_columns(leaves: DataFrame, people: DataFrame) -> DataFrame:
    """Fields half of whose values or more are of ``people`` (text): all of them are people."""
    known = people.select("text").distinct().withColumn("hit", F.lit(1))
    share = leaves.where("text is not null and text <> ''").join(known, "text", "left").groupBy("field").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return share.where("share >= 0.5").select("field", "share")
