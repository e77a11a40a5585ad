"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Each source's target is its share of the mix by weight, stopped at a multiple of what it has; what lies above is shared out again. A document of a source is then wanted
``target / size of the source`` times. The whole part of that is taken as it is; the fraction is rounded. Two documents with fractions left trade words: as
much as makes one of them whole is moved one way or the other, by chance, so that neither's expectation changes and the pair's words stay the same. The one that is
left trades with the next, and the very last one goes to its nearer end, so a source's words come within half a document of the target, whatever is drawn.

Documents are ranked by falling size in their source, so that partners are of like size. A block of ``FAN`` neighbours is rounded in one row, its residual goes up to
the next level, and so on to one residual for each source: a reduction tree whose rows never hold more than ``FAN`` documents. That last residual may be a long text that the few others up there
cannot settle. So some documents of all sizes wait for it, 64 for each doubling of the rank: they trade in one last row, by falling size, and what is left over is short. Their number grows as
the logarithm of a source. Chances are keyed hashes of places in that tree, so reruns agree on any cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, let, ranked

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 13
FAN = 64
#: Documents that wait for the last row: the first ranks up to twice this, and so many of each doubling after.
WAITING = 64
_ITEM = "struct<doc_id: bigint, size: bigint, mass: double>"
_OUT = "array<struct<doc_id: bigint, size: bigint, up: bigint>>"


def n_words(text: Column) -> Column:
    """White-space words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source_size, weight, ...) with ``target``: ``share`` of all sizes dealt by weight, none above ``most`` times its size.

    A round shares what the stopped sources leave among the others, until none is above. Rounds see three numbers of an aggregation each.
    """
    cap = F.col("source_size") * F.lit(float(most))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > cap
        left = sources.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        kept, open_weight = total - (left[1] or 0.0), left[2] or 0.0
        if left[0] == stopped or not open_weight:
            break
        stopped, level = left[0], kept / open_weight
    return sources.withColumn("target", F.least(cap, kept * F.col("weight") / open_weight) if open_weight else cap)


def _chance(*keys: Column) -> Column:
    """A number from 0 up to 1, even and the same for the same keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)


def _settled(x: Column) -> Column:
    return (x["mass"] <= 0) | (x["mass"] >= x["size"])


def _told(x: Column) -> Column:
    """A settled item as a row of the result: whether it is taken once more."""
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), ((x["mass"] > 0) & (x["mass"] >= x["size"])).cast("long").alias("up"))


def _with(x: Column, mass: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), mass.alias("mass"))


def _traded(a: Column, b: Column, chance: Column) -> Column:
    """struct<a, b> after words went from one to the other: at least one of them is settled, exactly."""
    room, give = a["size"] - a["mass"], b["size"] - b["mass"]
    up, down = F.least(room, b["mass"]), F.least(a["mass"], give)
    rises = F.struct(
        _with(a, F.when(room <= b["mass"], a["size"].cast("double")).otherwise(a["mass"] + b["mass"])).alias("a"), _with(b, F.when(b["mass"] <= room, F.lit(0.0)).otherwise(b["mass"] - room)).alias("b")
    )
    falls = F.struct(
        _with(a, F.when(a["mass"] <= give, F.lit(0.0)).otherwise(a["mass"] - give)).alias("a"), _with(b, F.when(give <= a["mass"], b["size"].cast("double")).otherwise(b["mass"] + a["mass"])).alias("b")
    )
    return F.when(chance * (up + down) < down, rises).otherwise(falls)


def _rounded(items: Column, seed: int, source: Column, level: Column) -> Column:
    """struct<carry, out>: all ``items`` (rank, doc_id, size, mass; in order) rounded but one, at most."""
    empty = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast(_OUT).alias("out"))

    def step(state: Column, x: Column) -> Column:
        def with_pair(t: Column) -> Column:
            done = F.transform(F.filter(F.array(t["a"], t["b"]), _settled), _told)
            return F.struct(F.get(F.filter(F.array(t["a"], t["b"]), lambda y: ~_settled(y)), F.lit(0)).alias("carry"), F.concat(state["out"], done).alias("out"))

        chance = _chance(F.lit(seed), source, level, x["rank"])
        return (
            F.when(_settled(x), F.struct(state["carry"].alias("carry"), F.concat(state["out"], F.array(_told(x))).alias("out")))
            .when(state["carry"].isNull(), F.struct(_with(x, x["mass"]).alias("carry"), state["out"].alias("out")))
            .otherwise(let(_traded(state["carry"], x, chance), with_pair))
        )

    return F.aggregate(items, empty, step)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target (of its source, in words), taken (words, repeats counted), copies.

    Sources take ``weights`` in turn by code point, null last; they share ``share`` times all sizes, and none is taken more than ``most`` times. A source's taken words differ from its target by at most half of one of
    its documents, as a rule a small one. Null and blank texts have size 0 and are taken with nothing, as are sources of size 0. Rows may repeat, and each is rounded by itself; null ids are ids. Other
    columns are ignored, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.save(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    in_turn = ranked(sources, [], ["unnamed", "source"], scratch, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    shares = scratch.save(targets(in_turn.select("source", "source_size", weight.alias("weight")), weights, share, most).select("source", "source_size", "target"), "targets")

    rows = ranked(sized.withColumn("falling", -F.col("size")), ["source"], ["falling", "doc_id"], scratch, "items", shares)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(wanted)).withColumn("mass", (wanted - F.col("whole")) * F.col("size"))
    kept = ["source", "source_size", "target", "whole"]
    rows = rows.select(*kept, "rank", "doc_id", "size", "mass")
    # ranks of 2**k and more wait where they are multiples of 2**k / WAITING
    waits = (F.col("rank") < 2 * WAITING) | (F.expr(f"rank % shiftleft(1L, length(bin(rank)) - {WAITING.bit_length()})") == 0)
    items, out, level = rows.where(~waits), [], 0
    while True:
        blocks = items.groupBy(*kept, F.expr(f"rank div {FAN}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "size", "mass"))).alias("items"))
        blocks = scratch.save(blocks.select(*kept, "block", _rounded(F.col("items"), seed, F.col("source"), F.lit(level)).alias("done")), f"blocks-{level}")
        out.append(blocks.select(*kept, F.explode("done.out").alias("x")))
        items = blocks.where("done.carry is not null").select(*kept, F.col("block").alias("rank"), "done.carry.*")
        if not blocks.agg(F.max("block")).first()[0]:  # one block for each source, at most
            break
        level += 1
    final = rows.where(waits).unionByName(items.withColumn("rank", F.lit(-1).cast("long")))
    final = final.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("falling"), "rank", "doc_id", "size", "mass"))).alias("items"))
    final = scratch.save(final.select(*kept, _rounded(F.col("items"), seed, F.col("source"), F.lit(-1)).alias("done")), "final")
    up = (2 * F.col("done.carry.mass") >= F.col("done.carry.size")).cast("long")  # it has no partner: the nearer end
    out.append(final.select(*kept, F.explode("done.out").alias("x")))
    out.append(final.where("done.carry is not null").select(*kept, F.struct("done.carry.doc_id", "done.carry.size", up.alias("up")).alias("x")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    copies = F.col("whole") + F.col("x.up")
    return found.select("x.doc_id", "source", "x.size", "source_size", "target", (copies * F.col("x.size")).alias("taken"), copies.alias("copies"))
