"""Known values found everywhere: a dictionary joined to the words of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, scan


#: First words that are handed to the search.
FIRSTS = 10_000


def folded(value: Column) -> Column:
    """A value's words, folded, with one space between."""
    return F.array_join(F.regexp_extract_all(keys.plain(value), F.lit(scan.WORD), F.lit(0)), " ")


def hits(leaves: DataFrame, entries: DataFrame) -> DataFrame:
    """Where entries (scope, folded, ...) stand in texts of their scope: leaf_id, start, end, value and the entries' other columns.

    An equi-join on scope and folded n-gram, for each number of words that an entry has, so a row meets only entries that stand there. The numbers are looked
    up first: a few rows, however many entries there are. Where entries open with at most ``FIRSTS`` words, only n-grams that open so are made; the result
    is the same either way.
    """
    known = entries.where("folded <> ''")
    sizes = [r[0] for r in known.select(F.size(F.split("folded", " "))).distinct().collect()]
    firsts = [r[0] for r in known.select(F.substring_index("folded", " ", 1)).distinct().limit(FIRSTS + 1).collect()]
    # a row carries its own few words, never its text
    grams = leaves.select("scope", "leaf_id", F.explode(scan.ngrams(F.col("text"), sizes, firsts if len(firsts) <= FIRSTS else None)).alias("g")).select("scope", "leaf_id", "g.*")
    others = [c for c in entries.columns if c not in ("scope", "folded")]
    return grams.join(known, ["scope", "folded"]).select("leaf_id", "start", "end", "value", "folded", *others)


def match(leaves: DataFrame, entries: DataFrame, score: float = 0.95) -> DataFrame:
    """(leaf_id, start, end, entity, score, value) where an entry (scope, entity, literal) stands in a text of its scope, whatever its case and accents."""
    known = entries.select("scope", "entity", folded(F.col("literal")).alias("folded")).where("folded <> ''").distinct()
    return hits(leaves, known).select("leaf_id", "start", "end", "entity", F.lit(score).alias("score"), "value")


def free(found: DataFrame, taken: DataFrame) -> DataFrame:
    """``found`` (leaf_id, start, end, ...) without what overlaps ``taken`` (leaf_id, start, end): the gaps that surer readers leave."""
    t = taken.select(F.col("leaf_id"), F.col("start").alias("a"), F.col("end").alias("b"))
    return found.join(t, (found["leaf_id"] == t["leaf_id"]) & (found["start"] < t["b"]) & (t["a"] < found["end"]), "left_anti")
