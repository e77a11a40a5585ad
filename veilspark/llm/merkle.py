"""A manifest of a table: every row is a leaf of a Merkle tree, and proves with a few digests that it belongs under the root.

Leaves are numbered inside their group (``ranked``: no group has to fit in one task). A level is a window over (group, number of the parent): the ordered list of a run's
digests is the preimage of the parent and holds each node's siblings. The parents, told once each, are written and are the next level, a sixteenth as large. The groups' roots, in order of the
groups, make the same tree again. Proofs are then laid from the root down: a node's proof is its siblings, and after them the proof of its parent, which all of a run share until the last join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, ranked

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value so that it cannot run into its neighbours: its length in bytes, a colon, itself; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row."""
    return digest(*map(framed, values))


def folded(first: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, first, lambda h, step: digest(step["before"], h, step["after"]))


def siblings(proof: Column) -> Column:
    """The digests of a proof as one string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _runs(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, i, n, h, ...) with p (number of the parent), run (digests of the run that a node stands in) and its own step of a proof."""
    run = F.collect_list("h").over(Window.partitionBy("g", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = F.pmod("i", F.lit(FAN)).cast("int")
    step = F.struct(F.array_join(F.slice("run", F.lit(1), own), "").alias("before"), F.array_join(F.slice("run", own + 2, F.lit(FAN)), "").alias("after"))
    return nodes.withColumn("p", F.expr(f"i div {FAN}")).withColumn("run", run).withColumn("step", step)


def _levels(nodes: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """The tables (g, i, n, h) of all levels, from ``nodes`` up to one node a group; a group that is down to one node keeps it."""
    levels, n = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while n > 1:
        parent = F.when(F.col("n") > 1, F.sha2(F.array_join("run", "").cast("binary"), 256)).otherwise(F.col("h"))
        above = _runs(levels[-1].select("g", "i", "n", "h")).select("g", F.col("p").alias("i"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), parent.alias("h"))
        levels.append(scratch.save(above.distinct(), f"{name}-{len(levels)}"))
        n = -(-n // FAN)
    return levels


def _proofs(levels: list[DataFrame], top: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest level's rows with ``proof`` and the columns ``carried`` of their group's row in ``top`` (g, proof, ...), from the highest level down."""
    columns = ["proof", *carried]
    highest = levels[-1].join(top.withColumnRenamed("g", "top_g"), F.col("g").eqNullSafe(F.col("top_g"))).select(*levels[-1].columns, *columns)
    for level in levels[-2::-1]:
        parents = highest.select(F.col("g").alias("up_g"), F.col("i").alias("up_i"), F.col("proof").alias("rest"), *carried)
        met = _runs(level).join(parents, F.col("g").eqNullSafe(F.col("up_g")) & (F.col("p") == F.col("up_i")))
        proof = F.when(F.col("n") > 1, F.concat(F.array("step"), "rest")).otherwise(F.col("rest"))
        highest = met.select(*level.columns, proof.alias("proof"), *carried)
    return highest


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", doc_id: str = "doc_id", also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof (array of before, after: the digests left and right of a node, level by level), and the columns ``also``.

    A leaf is the digest of ``fields``, a null told from an empty value. Leaves ascend by ``doc_id`` in their group, nulls first, rows of one id by their digest; rows that repeat
    wholly are leaves each, and interchangeable. Groups go by the bytes of their names, null first. ``also`` is worked out while the rows are read, so that texts are read once.
    An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    also = dict(also or {})
    rows = docs.select(F.col(group).cast("string").alias("g"), F.col(doc_id).alias("doc_id"), leaf([F.col(f) for f in fields]).alias("h"), *(c.alias(f"also_{k}") for k, c in also.items()))
    placed = ranked(rows, ["g"], ["doc_id", "h"], scratch, "leaves")
    nodes = scratch.save(placed.select("g", F.col("rank").alias("i"), F.col("of").alias("n"), "h", "doc_id", *(f"also_{k}" for k in also)), "numbered")
    levels = _levels(nodes, scratch, "level")
    subroots = ranked(levels[-1].select(F.col("g").alias("name"), F.col("h").alias("subroot")), [], ["name"], scratch, "groups")
    crown = scratch.save(subroots.select(F.lit(0).alias("g"), F.col("rank").alias("i"), F.col("of").alias("n"), F.col("subroot").alias("h"), "name"), "subroots")
    crowns = _levels(crown, scratch, "crown")
    root = crowns[-1].select("g", F.col("h").alias("root"), F.array().cast(PROOF).alias("proof"))
    top = scratch.save(_proofs(crowns, root, ["root"]).select(F.col("name").alias("g"), F.col("h").alias("subroot"), "root", "proof"), "top")
    found = _proofs(levels, top, ["subroot", "root"])
    return found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", "proof", *(F.col(f"also_{k}").alias(k) for k in also))
