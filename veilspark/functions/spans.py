"""Spans of pattern matches as native columns: all matches with their places, without a UDF.

Between the matches of a pattern stand the pieces that splitting by it gives, so the start of a match is the length of all pieces and matches
before it. Offsets are code points. Patterns must not match the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: int, end: int, entity: string, score: double, value: string>"


def _total(strings: Column) -> Column:
    return F.aggregate(strings, F.lit(0), lambda n, s: n + F.length(s))


def matches(text: Column, pattern: str) -> Column:
    """Array of struct<start, end, value> of all matches in order; null text has none."""
    body = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    return _placed(F.split(body, pattern, -1), found)


def _placed(pieces: Column, found: Column) -> Column:
    """Places the matches, in one pass that carries the position."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, value: string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    # the piece after the last match has none; to cut it off by the number of matches would search the text once more
    pairs = F.filter(F.zip_with(pieces, found, lambda p, v: F.struct(p.alias("piece"), v.alias("value"))), lambda p: p["value"].isNotNull())
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def spans(text: Column, pattern: str, entity: str, score: float) -> Column:
    """Matches as spans of one entity and score."""
    return F.transform(
        matches(text, pattern),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(entity).alias("entity"), F.lit(float(score)).alias("score"), m["value"].alias("value")),
    )


def words_before(text: Column, start: Column, count: int) -> Column:
    """The last ``count`` words before a place, lower-cased, nearest first."""
    prefix = F.lower(F.substring(text, F.lit(1), start))
    return F.slice(F.reverse(F.regexp_extract_all(prefix, F.lit(r"(\p{L}[\p{L}\p{M}]*)"), F.lit(1))), 1, count)


def overlap(a: Column, b: Column) -> Column:
    """Whether two spans share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def resolve(found: Column) -> Column:
    """Spans without overlap: the surest first, then the longest, then the first; in order of place.

    A later span that strictly contains all that it overlaps, and is of another entity than each of these, takes their place.
    """
    key = F.transform(found, lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s.alias("s")))
    order = F.transform(F.array_sort(key), lambda k: k["s"])

    def step(kept: Column, s: Column) -> Column:
        met = F.filter(kept, lambda k: overlap(k, s))
        wider = F.forall(met, lambda k: (s["start"] <= k["start"]) & (k["end"] <= s["end"]) & ((s["end"] - s["start"]) > (k["end"] - k["start"])) & (s["entity"] != k["entity"]))
        rest = F.filter(kept, lambda k: ~overlap(k, s))
        return F.when(F.size(met) == 0, F.concat(kept, F.array(s))).when(wider, F.concat(rest, F.array(s))).otherwise(kept)

    return F.array_sort(F.aggregate(order, F.array().cast(f"array<{SPAN}>"), step))


def apply_edits(text: Column, edits: Column) -> Column:
    """``text`` with its disjoint, ascending edits (start, end, new) made in one pass."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, e: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, e["start"] - state["at"])
        return F.struct(e["end"].alias("at"), F.concat(state["out"], gap, e["new"]).alias("out"))

    return F.aggregate(edits, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def shifted(edits: Column) -> Column:
    """The places of edits in the new text: struct<start, end> in order."""
    start = F.struct(F.lit(0).alias("by"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        begin = e["start"] + state["by"]
        end = begin + F.length(e["new"])
        return F.struct((end - e["end"]).alias("by"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(edits, start, step, lambda s: s["out"])
