"""Connected components of a graph in tables, by alternating stars: every node learns the least node that it can reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], name: str = "stars") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not the least of its component; loops, repeated edges and nulls are fine.

    A round hangs each node's larger neighbours on its least one, then each node's smaller neighbours on their least. Both keep what is connected; the edges end as stars around the
    roots, after about as many rounds as the logarithm of the longest path. A hub costs as many rows as it has edges, never their pairs. ``cut`` writes a table and reads it back.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before, turn = cut(edges, f"{name}-0"), None, 0
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, turn = mark, turn + 1
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        hung = cut(hung, f"{name}-large-{turn}")
        least = hung.groupBy("a").agg(F.min("b").alias("m"))
        low = hung.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(low.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
