"""The whole operator: texts or leaves in, pseudonymised text with marks and counts out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, maps
from ..functions import spans as S
from ..sources.scratch import Scratch, dealt
from . import detect, distinct


def found_values(spans: DataFrame, scope: Column) -> DataFrame:
    """(scope, entity, original, score): one row for each distinct value, of its surest kind."""
    each = spans.select(scope.alias("scope"), F.explode("spans").alias("s"))
    kinds = each.groupBy("scope", F.col("s.value").alias("original"), F.col("s.entity").alias("entity")).agg(F.max("s.score").alias("score"), F.count("*").alias("n"))
    best = kinds.groupBy("scope", "original").agg(F.max_by("entity", F.struct("score", "n", "entity")).alias("entity"), F.max("score").alias("score"))
    return best.select("scope", "entity", "original", "score")


def guarded(drawn: DataFrame, originals: DataFrame, seed: str) -> DataFrame:
    """Stand-ins that are no original of their scope: a clash takes the shape of the value under another key."""
    clash = originals.select("scope", F.lower("original").alias("low")).distinct()
    met = drawn.withColumn("low", F.lower("stand_in")).join(clash.withColumn("hit", F.lit(True)), ["scope", "low"], "left")
    other = draw.same_shape(F.col("original"), draw.stream(seed, F.col("scope"), "CLASH", F.col("original")))
    return met.select("scope", "entity", "original", F.when(F.col("hit"), other).otherwise(F.col("stand_in")).alias("stand_in"))


def pseudonymise(docs: DataFrame, seed: str, text: str = "text", key: str = "doc_id", scope: str | None = None, bank: Sequence[detect.Pattern] = detect.BANK, apart: bool = True, through: Sequence[str] = maps.SHOWN) -> DataFrame:
    """One row per row of ``docs``: key, output, marks (places in the output), counts by entity, n_spans.

    ``scope`` names a column within which one value takes one stand-in; without it that is the whole input. Detection reads each text once,
    drawing runs once per distinct value, and edits are gathered per text. ``key`` must tell the rows apart. Numbers, machine
    addresses and ids take stand-ins by permutation, so different ones stay different; names, handles and mailboxes by wide draws. With ``apart`` the few draws that meet are told apart, and a
    stand-in that is another value's original moves on; without it a value's stand-in depends on nothing else.

    Texts are searched as they are read through the layers ``through`` (``functions.maps``): without hidden characters and formatting inside words, and if asked for with
    references and escapes resolved. Originals are what is read; edits are made where it is written, and keep its formatting.
    """
    where = F.lit("dataset") if scope is None else F.col(scope).cast("string")
    rows = docs.select(F.col(key).alias("key"), where.alias("scope"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession)  # what is found and drawn is small beside the texts
    # searching costs more than the bytes of a file's row groups tell
    seen = dealt(rows, "key").withColumn("seen", maps.read(F.col("text"), through)).withColumn("read", F.coalesce("seen.text", "text"))
    found, some = detect.detect(seen, bank, text="read"), F.size("spans") > 0
    # texts without spans are left out as the table is read: the planner would move the filter, with the search, before the rows are dealt
    found = found.select("key", "scope", "spans", F.when(some, F.col("seen")).alias("seen"), F.when(some & F.col("seen").isNotNull(), F.col("text")).alias("text"))
    spans = scratch.save(found, "spans").where(some)
    values = found_values(spans, F.col("scope"))
    drawn = scratch.save(distinct.stand_ins(values, seed), "drawn")
    drawn = distinct.settled(distinct.met(drawn), values, seed, scratch) if apart else drawn
    each = spans.select("key", "scope", "spans", maps.places(F.col("text"), F.col("seen"), F.col("spans")).alias("places")).select("key", "scope", F.explode(F.arrays_zip("spans", "places")).alias("x")).select("key", "scope", F.col("x.spans").alias("s"), F.col("x.places").alias("p"))
    new = F.when(F.col("p.raw") != F.col("s.value"), maps.written_like(F.col("stand_in"), F.col("p.raw"), through)).otherwise(F.col("stand_in"))
    edits = each.join(drawn.select("scope", F.col("original").alias("value"), "stand_in"), (each["scope"] == drawn["scope"]) & (F.col("s.value") == F.col("value")), "left").select(
        "key", F.struct(F.col("p.start").alias("start"), F.col("p.end").alias("end"), new.alias("new"), F.col("s.entity").alias("entity"), F.col("s.value").alias("original"), F.col("s.score").alias("score")).alias("edit")
    )
    made = edits.groupBy("key").agg(F.array_sort(F.array_distinct(F.collect_list("edit"))).alias("edits"))
    return rows.join(made, "key", "left").select(F.col("key").alias(key), *_rendered(F.col("text"), F.coalesce("edits", F.array())))


def _rendered(text: Column, edits: Column) -> list[Column]:
    edits = edits.cast("array<struct<start: int, end: int, new: string, entity: string, original: string, score: double>>")
    places = S.shifted(edits)
    marks = F.zip_with(places, edits, lambda p, e: F.struct(p["start"].alias("start"), p["end"].alias("end"), e["entity"].alias("entity"), e["original"].alias("original"), e["new"].alias("stand_in"), e["score"].alias("confidence")))
    kinds = F.array_sort(F.array_distinct(F.transform(edits, lambda e: e["entity"])))
    counts = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(edits, lambda e: e["entity"] == k)).cast("long")))
    return [S.apply_edits(text, edits).alias("output"), marks.alias("marks"), counts.alias("counts"), F.size(edits).alias("n_spans")]
