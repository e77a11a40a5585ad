"""Who is who: mentions of people resolved to persons within their scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

# Short forms of given names.
NICKNAMES = {"bob": "robert", "rob": "robert", "bobby": "robert", "bill": "william", "will": "william", "liz": "elizabeth", "beth": "elizabeth", "kate": "katherine", "katie": "katherine", "mike": "michael", "jim": "james", "jimmy": "james", "tom": "thomas", "tony": "anthony", "dave": "david", "dan": "daniel", "sam": "samuel", "alex": "alexander", "chris": "christopher", "steve": "stephen", "joe": "joseph", "ed": "edward", "ted": "edward", "dick": "richard", "rick": "richard", "peggy": "margaret", "maggie": "margaret", "sue": "susan", "jen": "jennifer", "nick": "nicholas", "ben": "benjamin", "andy": "andrew", "greg": "gregory"}
# Titles, and whom they are for.
TITLES = {"mr": "m", "mrs": "f", "ms": "f", "miss": "f", "herr": "m", "frau": "f", "mme": "f", "m": "m", "sr": "m", "sra": "f", "dr": "", "prof": ""}


def natural_order(name: Column) -> Column:
    """``Okafor, Ama`` as ``Ama Okafor``."""
    return F.when(name.rlike(r"^[^,]+,\s*[^,]+$"), F.concat_ws(" ", F.trim(F.element_at(F.split(name, ","), 2)), F.trim(F.element_at(F.split(name, ","), 1)))).otherwise(F.trim(name))


def parts(name: Column) -> Column:
    """The folded words of a name in natural order, without title."""
    w = F.filter(F.split(keys.plain(natural_order(name)), r"[^\p{L}\p{N}'’-]+"), lambda x: x != "")
    return F.when((F.size(w) > 1) & F.element_at(w, 1).isin(*TITLES), F.slice(w, 2, 100)).otherwise(w)


def sex(name: Column) -> Column:
    """m or f where a title tells it."""
    first = F.element_at(F.split(keys.plain(F.trim(name)), r"[^\p{L}]+"), 1)
    table = keys.literals((x for pair in TITLES.items() for x in pair), "map")
    found = F.element_at(table, first)
    return F.when(found != "", found)


def given(first: Column) -> Column:
    """A given name with its short form spelled out."""
    table = keys.literals((x for pair in NICKNAMES.items() for x in pair), "map")
    return F.coalesce(F.element_at(table, first), first)


def resolve(mentions: DataFrame) -> DataFrame:
    """``mentions`` (scope, name) with ``person``: the full name that each mention stands for within its scope, else its own form.

    A full name is its own person, but for given names and their short forms. An initial with a surname, or a lone surname, is the one full name of that surname (and
    initial, and title's sex); with several or none it stands alone. Blocks are (scope, surname), so no person pairs are made.
    """
    m = mentions.withColumn("p", parts(F.col("name"))).withColumn("sex", sex(F.col("name")))
    m = m.withColumn("first", F.when(F.size("p") > 1, given(F.element_at("p", 1)))).withColumn("last", F.element_at("p", -1))
    own = F.concat_ws(" ", F.col("first"), F.col("last"))
    full = m.where(F.length("first") > 1).select("scope", "last", "first", "sex")
    counted = lambda *by: full.groupBy(*by).agg(F.count_distinct("first").alias("n"), F.min("first").alias("only"), F.min("sex").alias("known_sex"))
    # one row for each surname, and for each surname and initial: how many given names it has, and the one if there is one
    alone = counted("scope", "last").withColumn("initial", F.lit(""))
    lettered = counted("scope", "last", F.substring("first", 1, 1).alias("initial"))
    block = alone.unionByName(lettered)
    initial = F.when(F.col("first").isNull(), F.lit("")).when(F.length(F.regexp_replace("first", "[.]", "")) == 1, F.substring("first", 1, 1))
    met = m.withColumn("initial", initial).join(block, ["scope", "last", "initial"], "left")
    clash = F.col("sex").isNotNull() & F.col("known_sex").isNotNull() & (F.col("sex") != F.col("known_sex"))
    person = F.when(F.col("initial").isNotNull() & (F.col("n") == 1) & ~clash, F.concat_ws(" ", F.col("only"), F.col("last"))).otherwise(own)
    return met.select("scope", "name", person.alias("person"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def shared_given_names(full_names: DataFrame) -> DataFrame:
    """Given names (scope, first) that several surnames of a scope have: alone they tell no one."""
    p = parts(F.col("name"))
    return full_names.where(F.size(p) > 1).select("scope", F.element_at(p, 1).alias("first"), F.element_at(p, -1).alias("last")).groupBy("scope", "first").agg(F.countDistinct("last").alias("n")).where("n > 1").select("scope", "first")


def spelled_by_email(mentions: DataFrame, emails: DataFrame) -> DataFrame:
    """(scope, name, email) where the local part spells the name: first.last, flast, firstl or last."""
    p = parts(F.col("name"))
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    forms = F.array_distinct(F.array(F.concat(first, last), F.concat(last, first), F.concat(F.substring(first, 1, 1), last), F.concat(first, F.substring(last, 1, 1))))
    named = mentions.where(F.size(p) > 1).select("scope", "name", F.explode(forms).alias("form"))
    local = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index("email", "@", 1)), r"[._-]", ""), r"\d+$", "")
    return named.join(emails.select("scope", "email", local.alias("form")), ["scope", "form"]).select("scope", "name", "email").distinct()
