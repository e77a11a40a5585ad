"""Who a value belongs to: records' owners, persons told apart by key, addresses, nearness in text, nearest scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..sources.scratch import large


def owners(leaves: DataFrame, identities: DataFrame) -> DataFrame:
    """``leaves`` (with record_ids, outermost first) with the person of the innermost enclosing record that has one.

    ``identities`` is (record_id, person). The records of a leaf are exploded with their depth and the deepest match wins, so it is an equi-join.
    """
    each = leaves.select("leaf_id", F.posexplode("record_ids").alias("depth", "record_id"))
    best = each.join(large(identities), "record_id").groupBy("leaf_id").agg(F.max_by("person", "depth").alias("owner"))
    return leaves.join(large(best), "leaf_id", "left")


def flat_persons(leaves: DataFrame) -> DataFrame:
    """(record_id, prefix, person): a record with names under two prefixes holds two people; otherwise its values are one person's."""
    named = leaves.where(keys.hint(F.col("key")).isin("PERSON", "FIRST_NAME", "LAST_NAME")).select("record_id", F.coalesce(keys.person_prefix(F.col("key")), F.lit("")).alias("prefix")).distinct()
    several = named.groupBy("record_id").agg(F.count("*").alias("names"))
    prefixes = leaves.select("record_id", F.coalesce(keys.person_prefix(F.col("key")), F.lit("")).alias("prefix")).distinct()
    own = prefixes.join(named.withColumn("own", F.lit(True)), ["record_id", "prefix"], "left").join(several, "record_id", "left")
    person = F.when((F.coalesce("names", F.lit(0)) >= 2) & F.col("own"), F.concat_ws("/", F.col("record_id").cast("string"), "prefix")).otherwise(F.col("record_id").cast("string"))
    return own.select("record_id", "prefix", person.alias("person"))


def addresses(leaves: DataFrame) -> DataFrame:
    """(record_id, qualifier, street, city, region, postcode): the address parts of a record, told apart by what stands before the part in its key."""
    part = keys.hint(F.col("key"))
    qualifier = F.array_join(F.slice(keys.words(F.col("key")), 1, F.greatest(F.size(keys.words(F.col("key"))) - 1, F.lit(0))), "_")
    rows = leaves.where(part.isin("ADDRESS", "LOCATION", "REGION", "POSTAL_CODE")).select("record_id", qualifier.alias("qualifier"), part.alias("part"), "leaf_id", "text")
    one = lambda p, name: F.min_by("text", F.when(F.col("part") == p, F.col("leaf_id"))).alias(name)
    return rows.groupBy("record_id", "qualifier").agg(one("ADDRESS", "street"), one("LOCATION", "city"), one("REGION", "region"), one("POSTAL_CODE", "postcode"))


def near(spans: DataFrame, gap: int, unique: bool = False) -> DataFrame:
    """``spans`` (leaf_id, start, end, entity) with ``group_no``: neighbours at most ``gap`` apart are one group; with ``unique`` a group also ends where an entity repeats the one before.

    Partitions are single texts, so a window never outgrows a text.
    """
    w = Window.partitionBy("leaf_id").orderBy("start", "end")
    apart = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
    if unique:
        apart = apart | F.coalesce(F.lag("entity").over(w) == F.col("entity"), F.lit(False))
    return spans.withColumn("fresh", apart.cast("int")).withColumn("group_no", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def nearest(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """Each ask (ask_id, scopes: innermost first) with the value that the nearest scope offers (scope, value), and whether it is the only one there.

    An ask whose nearest offering scope has several values is in doubt.
    """
    each = asks.select("ask_id", F.posexplode("scopes").alias("rank", "scope"))
    held = offers.groupBy("scope").agg(F.min("value").alias("value"), F.countDistinct("value").alias("n_values"))
    best = each.join(held, "scope").groupBy("ask_id").agg(F.min_by(F.struct("value", "n_values", "rank"), "rank").alias("b"))
    return best.select("ask_id", F.when(F.col("b.n_values") == 1, F.col("b.value")).alias("value"), (F.col("b.n_values") > 1).alias("unclear_owner"))
