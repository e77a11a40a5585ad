"""Findings for review, the user's choices over them, and what may leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, keys
from ..functions import spans as S
from .detect import REVIEW_BELOW

EXCERPT = 40


def findings(marks: DataFrame) -> DataFrame:
    """One row for each (entity, original, stand_in, doubt) of marks (leaf_id, start, end, text and those): n, the least confidence, places, excerpts, needs_review."""
    before = F.substring("text", F.greatest(F.col("start") - EXCERPT, F.lit(0)) + 1, F.least(F.col("start"), F.lit(EXCERPT)))
    after = F.substring("text", F.col("end") + 1, F.lit(EXCERPT))
    place = F.struct("leaf_id", "start", "end", "confidence", before.alias("before"), after.alias("after"))
    made = marks.groupBy("entity", "original", "stand_in", "doubt").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"), F.array_sort(F.collect_list(place)).alias("places"))
    return made.withColumn("needs_review", (F.col("confidence") < REVIEW_BELOW) | F.col("doubt").isNotNull())


def summary(marks: DataFrame) -> DataFrame:
    """(entity, n_findings, n_places, confidence, needs_review): findings counted without their places, for any size of input."""
    each = marks.groupBy("entity", "original", "stand_in", "doubt").agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))
    ask = ((F.col("confidence") < REVIEW_BELOW) | F.col("doubt").isNotNull()).cast("long")
    return each.groupBy("entity").agg(F.count("*").alias("n_findings"), F.sum("n").alias("n_places"), F.min("confidence").alias("confidence"), F.sum(ask).alias("needs_review"))


def apply_choices(docs: DataFrame, edits: DataFrame, choices: DataFrame) -> DataFrame:
    """Renders ``docs`` (leaf_id, text) anew: a place's choice beats its finding's, ``keep`` leaves the original, ``replace`` may bring its own text.

    ``edits`` is (leaf_id, start, end, entity, original, new), ``choices`` (entity, original, leaf_id, start, action, text); a choice with null leaf_id is the
    finding's. A pure function of its inputs.
    """
    place = choices.where("leaf_id is not null").select("leaf_id", "start", F.col("action").alias("p_action"), F.col("text").alias("p_text"))
    finding = choices.where("leaf_id is null").select("entity", "original", F.col("action").alias("f_action"), F.col("text").alias("f_text"))
    e = edits.join(place, ["leaf_id", "start"], "left").join(finding, ["entity", "original"], "left")
    action = F.coalesce("p_action", "f_action", F.lit("replace"))
    typed = F.when(F.col("p_action").isNotNull(), F.col("p_text")).otherwise(F.col("f_text"))
    kept = e.where(action != "keep").select("leaf_id", F.struct(F.col("start"), F.col("end"), F.coalesce(typed, F.col("new")).alias("new")).alias("e"))
    made = kept.groupBy("leaf_id").agg(F.array_sort(F.collect_list("e")).alias("edits"))
    none = F.array().cast("array<struct<start: int, end: int, new: string>>")
    return docs.join(made, "leaf_id", "left").select("leaf_id", S.apply_edits(F.col("text"), F.coalesce("edits", none)).alias("output"))


def refused(typed: Column, entity: Column, original: Column, names: Column) -> Column:
    """Why a typed replacement is refused, else null: empty, holds the original, or keeps a word of three letters or more of a found name."""
    words = F.regexp_extract_all(keys.plain(typed), F.lit(r"\p{L}{3,}"), F.lit(0))
    known = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(keys.plain(n), F.lit(r"\p{L}{3,}"), F.lit(0))))
    return (
        F.when(F.trim(typed) == "", "empty")
        .when(F.instr(keys.plain(typed), keys.plain(original)) > 0, "holds_original")
        .when(F.arrays_overlap(words, known), "name_word")
    )


def guess_kind(selection: Column) -> Column:
    """The entity of a value marked by hand, by its shape."""
    return (
        F.when(selection.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "EMAIL_ADDRESS")
        .when(selection.rlike(r"^(\d{1,3}\.){3}\d{1,3}$"), "IP_ADDRESS")
        .when(selection.rlike(r"^\d{3}-\d{2}-\d{4}$"), "US_SSN")
        .when(selection.rlike(r"^\+?[\d ().-]{7,20}$") & (F.length(F.regexp_replace(selection, r"\D", "")) >= 13) & ~selection.startswith("+"), "CREDIT_CARD")
        .when(selection.rlike(r"^\+?[\d ().-]{7,20}$"), "PHONE_NUMBER")
        .when(selection.rlike(r"^\p{Lu}[\p{L}'’-]+( \p{Lu}[\p{L}.'’-]*)+$"), "PERSON")
        .when(selection.rlike(r"^(?=.*\d)[\w-]{6,}$"), "ID_NUMBER")
        .otherwise("PERSON")
    )


class NotReviewed(RuntimeError):
    """Something still waits for review."""


def export(outputs: DataFrame, marks: DataFrame, path: str, force: bool = False) -> None:
    """Writes the outputs, but only once nothing needs review (or with ``force``)."""
    waiting = marks.where((F.col("confidence") < REVIEW_BELOW) | F.col("doubt").isNotNull())
    if not force and not waiting.isEmpty():
        raise NotReviewed("findings wait for review")
    outputs.write.mode("errorifexists").parquet(path)


def coverage() -> list[str]:
    """The optional parts that this installation lacks: detection runs without learned models."""
    return ["name_model", "address_model", "context_model", "span_tagger"]


def left_as_written(found: DataFrame, choices: DataFrame) -> DataFrame:
    """(n_left): places of findings (entity, original, n) that the user's choices (entity, original, action) leave as written."""
    kept = choices.where("action = 'keep'").select("entity", "original").distinct()
    return found.join(kept, ["entity", "original"], "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_left"))


def proposals(suspects: DataFrame, seed: str) -> DataFrame:
    """``suspects`` (scope, entity, original, ...) with the stand-in that each would take, which is the one its value has elsewhere in the scope."""
    drawn = draw.stand_ins(suspects.select("scope", "entity", "original").distinct(), seed)
    return suspects.join(drawn.withColumnRenamed("stand_in", "proposal"), ["scope", "entity", "original"], "left")


def person_links(edits: DataFrame) -> DataFrame:
    """(scope, original, stand_in, person) of edits, one row each, for later edits of the same person; values of several people have no link."""
    met = edits.where("person is not null").groupBy("scope", "original", "stand_in").agg(F.count_distinct("person").alias("n"), F.min("person").alias("person"))
    return met.where("n = 1").drop("n")
