"""Does anything personal still stand in the output? Variants of originals, parts of names, self-checking numbers; and rounds until nothing new is found."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks, keys, scan
from . import detect, lexicon, people

ROUNDS = 3
#: Words that are too common to be hunted as a part of a name.
LEAST_PART = 4
#: Runs of digits that may be a number's spelling.
NUMBERS = (r"\+?[0-9][0-9 ().-]{5,}[0-9]", None, False)


def variants(originals: DataFrame) -> DataFrame:
    """(scope, entity, original, form, folded): other spellings of originals (scope, entity, original).

    Names: parts, joined handles, initial with surname; emails: local parts; numbers of seven digits or more: the digits
    alone; dates: other orders.
    """
    p = people.parts(F.col("original"))
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    named = F.col("entity").isin("PERSON", "FIRST_NAME", "LAST_NAME")
    pieces = F.filter(p, lambda w: F.length(w) >= LEAST_PART)
    joined = F.when(F.size(p) > 1, F.array(F.concat(first, last), F.concat(F.substring(first, 1, 1), last), F.concat(first, F.substring(last, 1, 1)), F.concat_ws(" ", last, first), F.concat_ws(" ", F.substring(first, 1, 1), last)))
    digits = checks.digits(F.col("original"))
    day = F.coalesce(F.try_to_date("original", "yyyy-MM-dd"), F.try_to_date("original", "MM/dd/yyyy"))
    spelled = F.array(*(F.date_format(day, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "MMMM d, yyyy", "yyyyMMdd")))
    none = F.array().cast("array<string>")
    made = F.concat(
        F.transform(F.when(named, pieces).otherwise(none), lambda w: F.struct(F.lit("part").alias("form"), w.alias("text"))),
        F.transform(F.coalesce(F.when(named, joined), none), lambda w: F.struct(F.lit("joined").alias("form"), w.alias("text"))),
        F.transform(F.when(F.col("entity") == "EMAIL_ADDRESS", F.array(F.substring_index("original", "@", 1))).otherwise(none), lambda w: F.struct(F.lit("local").alias("form"), w.alias("text"))),
        F.transform(F.when((F.length(digits) >= 7) & F.col("entity").isin("PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "ID_NUMBER", "US_ITIN"), F.array(digits)).otherwise(none), lambda w: F.struct(F.lit("digits").alias("form"), w.alias("text"))),
        F.transform(F.coalesce(F.when((F.col("entity") == "DATE_OF_BIRTH") & day.isNotNull(), spelled), none), lambda w: F.struct(F.lit("date").alias("form"), w.alias("text"))),
        F.array(F.struct(F.lit("whole").alias("form"), F.col("original").alias("text"))),
    )
    rows = originals.select("scope", "entity", "original", F.explode(made).alias("v"))
    return rows.select("scope", "entity", "original", F.col("v.form").alias("form"), F.when(F.col("v.form") == "digits", F.col("v.text")).otherwise(lexicon.folded(F.col("v.text"))).alias("folded")).where("folded <> ''").distinct()


def leaks(outputs: DataFrame, originals: DataFrame) -> DataFrame:
    """(leaf_id, start, end, entity, original, form, value) where outputs (scope, leaf_id, text) still show an original of their scope in any spelling."""
    v = variants(originals)
    words = lexicon.hits(outputs, v.where("form <> 'digits'"))
    runs = scan.matches(F.col("text"), [NUMBERS])
    numbers = outputs.select("scope", "leaf_id", F.explode(runs).alias("m")).select("scope", "leaf_id", "m.start", "m.end", "m.value", checks.digits(F.col("m.value")).alias("folded"))
    numbers = numbers.join(v.where("form = 'digits'"), ["scope", "folded"])
    columns = ["leaf_id", "start", "end", "entity", "original", "form", "value"]
    return words.select(columns).union(numbers.select(columns)).distinct()


def within_budget(found: DataFrame, text_length: str = "text_length") -> DataFrame:
    """``found`` leaks with ``suspect``: those beyond max(256, an eighth of the text) of a leaf are only asked about."""
    w = Window.partitionBy("leaf_id").orderBy("start", "end", "original", "form")
    return found.withColumn("suspect", F.row_number().over(w) > F.greatest(F.lit(256), F.floor(F.col(text_length) / 8)))


def self_checking(outputs: DataFrame, marks: DataFrame) -> DataFrame:
    """Cards, IBANs and SSNs that still pass their check outside the marks (leaf_id, start, end), as suspects at 0.5."""
    kinds = ("CREDIT_CARD", "IBAN_CODE", "US_SSN")
    bank = [replace(p, words=(), score=0.5) for p in detect.BANK if p.entity in kinds and p.score >= 0.5]
    found = detect.find_all(outputs, bank)
    rows = found.select("leaf_id", "text", F.explode(F.array_distinct("spans")).alias("s")).select("leaf_id", "s.start", "s.end", "s.entity", "s.value", F.lower(F.substring("text", F.greatest(F.col("s.start") - 24, F.lit(0)) + 1, F.lit(24))).alias("before"))
    rows = rows.where(~F.col("before").rlike(r"\b(order|invoice|ticket|case|ref)\b[^a-z]*$")).drop("before")
    return lexicon.free(rows, marks)


def residue(outputs: DataFrame, names: DataFrame, ordinary: DataFrame | None = None) -> DataFrame:
    """(leaf_id, start, end, part) where a part of any found name (scope, name) is left, folded, unless it is an ordinary word (word)."""
    part = names.select("scope", F.explode(people.parts(F.col("name"))).alias("folded")).where(F.length("folded") >= LEAST_PART).distinct()
    if ordinary is not None:
        part = part.join(ordinary.select(keys.plain(F.col("word")).alias("folded")).distinct(), "folded", "left_anti")
    return lexicon.hits(outputs, part).select("leaf_id", "start", "end", F.col("folded").alias("part")).distinct()


def rounds(start: DataFrame, step: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], cut: Callable[[DataFrame, str], DataFrame], limit: int = ROUNDS) -> tuple[DataFrame, int]:
    """Repeats ``step`` (state, round) -> (state, what is new) until nothing is new, ``limit`` times at most. ``cut`` writes a table and reads it back, so plans stay short."""
    state = start
    for turn in range(1, limit + 1):
        state, fresh = step(state, turn)
        state, fresh = cut(state, f"state-{turn}"), cut(fresh, f"fresh-{turn}")
        if fresh.isEmpty():
            return state, turn
    return state, limit
