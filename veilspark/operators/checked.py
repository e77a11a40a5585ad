"""Pseudonymising with its checks: what the output still shows of an original, in any spelling, is replaced too, round by round.

The rounds are semi-naive. An index of the outputs, word to text, is written once. The originals are looked up in it by the first word of each spelling, and only the texts it names are searched. A
round that changes texts can show something new only there, so the next round searches those texts alone; originals that a round adds go through the index again. What a round reads thus
shrinks with what the round before changed, however many texts there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, draw, scan
from ..functions import spans as S
from . import lexicon, pseudonymise, verify

Cut = Callable[[DataFrame, str], DataFrame]


def _replacement(seed: str) -> Column:
    """What stands for a leak: the part, handle, local part or digits of the original's stand-in."""
    s, v = F.col("stand_in"), F.col("value")
    return (
        F.when(F.col("form") == "part", F.element_at(F.split(s, r"\s+"), -1))
        .when(F.col("form") == "joined", F.lower(F.regexp_replace(s, r"\s+", "")))
        .when(F.col("form") == "local", F.substring_index(s, "@", 1))
        .when(F.col("form") == "digits", draw.pour(v, checks.digits(s)))
        .when(F.col("form") == "date", draw.same_shape(v, draw.stream(seed, F.lit("dataset"), "DATE", v)))
        .otherwise(s)
    )


def index(texts: DataFrame) -> DataFrame:
    """(scope, token, leaf_id) of texts (scope, leaf_id, text): a 64-bit hash of each folded word and of the digits of each number, once for each text."""
    words = F.transform(scan.ngrams(F.col("text"), [1]), lambda g: g["folded"])
    numbers = F.transform(scan.matches(F.col("text"), [verify.NUMBERS]), lambda m: checks.digits(m["value"]))
    tokens = texts.select("scope", "leaf_id", words.alias("words"), numbers.alias("numbers")).select("scope", "leaf_id", F.array_distinct(F.concat("words", "numbers")).alias("t"))
    return tokens.select("scope", F.explode(F.transform("t", lambda t: F.xxhash64(t))).alias("token"), "leaf_id")


def named(postings: DataFrame, originals: DataFrame) -> DataFrame:
    """(leaf_id) of the texts that may show an original in any spelling: those that hold a spelling's first word. No text that shows one is missing."""
    v = verify.variants(originals)
    heads = v.select("scope", F.xxhash64(F.substring_index("folded", " ", 1)).alias("token")).distinct()
    return postings.join(heads, ["scope", "token"], "left_semi").select("leaf_id").distinct()


@dataclass
class Round:
    read: int  # texts searched
    leaks: int
    changed: int  # texts changed


@dataclass
class Checked:
    outputs: DataFrame  # (leaf_id, scope, text)
    suspects: DataFrame  # what is still shown
    log: list[Round]


def rounds(docs: DataFrame, seed: str, cut: Cut, text: str = "text", key: str = "doc_id", more: Callable[[DataFrame, int], DataFrame] | None = None, limit: int = verify.ROUNDS) -> Checked:
    """``docs`` pseudonymised, then searched and mended until a round finds nothing, ``limit`` times at most.

    ``cut`` writes a table and reads it back. ``more`` (leaks, round) may give originals (scope, entity, original, stand_in) that a round brought to light: they are hunted in all texts
    by the next one. Leaks beyond a text's budget are only suspects. Null texts are empty; ``key`` must tell the rows apart.
    """
    out = cut(pseudonymise.pseudonymise(docs, seed, text, key), "pseudonymised")
    known = cut(out.select(F.explode("marks").alias("m")).select(F.lit("dataset").alias("scope"), "m.entity", "m.original", "m.stand_in").distinct(), "originals-0")
    base = out.select(F.col(key).alias("leaf_id"), F.lit("dataset").alias("scope"), F.col("output").alias("text"))
    postings = cut(index(base), "index")
    latest, mended, fresh, log = base, None, known, []
    touched = cut(named(postings, known.select("scope", "entity", "original")), "named-0")
    for turn in range(1, limit + 1):
        now = cut(latest.join(touched, "leaf_id", "left_semi"), f"read-{turn}")
        found = verify.leaks(now, known.select("scope", "entity", "original")).join(now.select("leaf_id", F.length("text").alias("text_length")), "leaf_id")
        found = verify.within_budget(found).where("not suspect").join(known.select("entity", "original", "stand_in"), ["entity", "original"])
        found = cut(found.select("leaf_id", "start", "end", "entity", "original", "form", "value", _replacement(seed).alias("new")), f"leaks-{turn}")
        edits = found.groupBy("leaf_id").agg(F.collect_list(F.struct("start", "end", F.lit("LEAK").alias("entity"), F.lit(1.0).alias("score"), F.col("new").alias("value"))).alias("e"))
        edits = edits.select("leaf_id", F.transform(S.resolve(F.col("e")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("new"))).alias("edits"))
        changed = cut(now.join(edits, "leaf_id").select("leaf_id", "scope", S.apply_edits(F.col("text"), F.col("edits")).alias("text")), f"changed-{turn}")
        n = changed.count()
        log.append(Round(now.count(), found.count(), n))
        added = None if more is None else cut(more(found, turn).join(known, ["scope", "entity", "original"], "left_anti"), f"more-{turn}")
        if n:
            mended = changed if mended is None else cut(mended.join(changed, "leaf_id", "left_anti").unionByName(changed), f"mended-{turn}")
            latest = base.join(mended.select("leaf_id"), "leaf_id", "left_anti").unionByName(mended)
        touched = changed.select("leaf_id")
        if added is not None and not added.isEmpty():
            known = cut(known.unionByName(added.select("scope", "entity", "original", "stand_in")), f"originals-{turn}")
            touched = touched.union(named(postings, added.select("scope", "entity", "original"))).distinct()
        elif not n:
            touched = None
            break
    # a last round that changed texts leaves these to be looked at; all others were found clean after their last change
    last = latest if touched is None else cut(latest.join(touched, "leaf_id", "left_semi"), "last")
    suspects = verify.leaks(last if touched is not None else now, known.select("scope", "entity", "original"))
    return Checked(latest, cut(suspects, "suspects"), log)


def pseudonymise_checked(docs: DataFrame, seed: str, cut: Cut, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame, int]:
    """(outputs, suspects, rounds): (key, output) after up to three rounds, what is still shown then, and how many rounds there were."""
    done = rounds(docs, seed, cut, text, key)
    return done.outputs.select(F.col("leaf_id").alias(key), F.col("text").alias("output")), done.suspects, len(done.log)
