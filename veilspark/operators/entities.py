"""Mentions resolved to persons by what they share, under constraints.

Mentions of one mailbox, phone or handle are one person's, then those of one full name; then a mention that has only an initial and a surname, or a surname alone, joins the one person whom that can
mean. No person has two full names or two sexes: a key that would make one so is shared by several people (a family's phone, an office's mailbox) and says nothing, and neither do keys that
would do so together. Every step is a grouping by key and connected components of its stars, so no pairs of mentions are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, draw
from . import people
from .components import components

#: What mentions are joined by, the surest first.
KEYS = ("email", "phone", "handle", "full")


def _least_most(of: str) -> list[Column]:
    return [F.min(of).alias(f"{of}_least"), F.max(of).alias(f"{of}_most")]


def _at_odds() -> Column:
    """Whether what is grouped has two full names or two sexes."""
    return F.coalesce((F.col("full_least") != F.col("full_most")) | (F.col("sex_least") != F.col("sex_most")), F.lit(False))


def _merged(state: DataFrame, links: DataFrame, cut: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """``state`` (mention, person, ...) with persons joined by ``links`` (a, b), but for components that would be at odds with themselves."""
    roots = components(links, cut, f"{name}-stars")
    known = cut(state.join(roots.withColumnRenamed("node", "person"), "person", "left").withColumn("new", F.coalesce("root", "person")), f"{name}-met")
    bad = known.groupBy("new").agg(*_least_most("full"), *_least_most("sex")).where(_at_odds()).select("new", F.lit(True).alias("bad"))
    kept = known.join(bad, "new", "left").withColumn("person", F.when(F.coalesce("bad", F.lit(False)), F.col("person")).otherwise(F.col("new")))
    return cut(kept.select(*state.columns), f"{name}-state")


def resolve(mentions: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(scope, mention, person, full) of ``mentions`` (scope, mention, name, email, phone, handle): the least mention of the same person, and their full name if one is known.

    ``mention`` tells the rows apart in the whole table; all other columns may be null. Names are folded, short forms spelled out, titles tell a sex. Role mailboxes are no one's. Phones are
    compared by their last nine digits, from seven on.
    """
    p = people.parts(F.col("name"))
    first, last = F.when(F.size(p) > 1, F.element_at(p, 1)), F.try_element_at(p, F.lit(-1))
    digits = checks.digits(F.col("phone"))
    told = mentions.select(
        "scope",
        "mention",
        F.col("mention").alias("person"),
        people.sex(F.col("name")).alias("sex"),
        last.alias("last"),
        F.when(F.length(F.regexp_replace(first, "[.]", "")) == 1, F.substring(first, 1, 1)).when(first.isNull() & last.isNotNull(), F.lit("")).alias("initial"),
        F.when(F.length(F.regexp_replace(first, "[.]", "")) > 1, F.concat_ws(" ", people.given(first), last)).alias("full"),
        F.when(~draw.role_mailbox(F.col("email")), F.lower(F.trim("email"))).alias("email"),
        F.when(F.length(digits) >= 7, F.substring(digits, -9, 9)).alias("phone"),
        F.lower(F.regexp_replace("handle", "^@", "")).alias("handle"),
    )
    state = cut(told, "mentions")
    for key in KEYS:
        held = state.where(F.col(key).isNotNull())
        # the full names and sexes of whole persons, not of the mentions that hold the key alone
        persons = state.groupBy("person").agg(F.min("full").alias("full"), F.min("sex").alias("sex"))
        each = held.select("scope", F.col(key).alias("k"), "person").distinct().join(persons, "person")
        one = each.groupBy("scope", "k").agg(F.min("person").alias("b"), F.count("*").alias("n"), *_least_most("full"), *_least_most("sex")).where(~_at_odds() & (F.col("n") > 1))
        links = each.join(one.select("scope", "k", "b"), ["scope", "k"]).select(F.col("person").alias("a"), "b").where("a <> b")
        state = _merged(state, links, cut, key)
    for step, initials in (("initial", "initial <> ''"), ("surname", "initial = ''")):
        persons = state.groupBy("scope", "person").agg(F.min("full").alias("full"), F.min("sex").alias("sex"))
        named = persons.where("full is not null").withColumn("last", F.substring_index("full", " ", -1)).withColumn("initial", F.substring("full", 1, 1) if step == "initial" else F.lit(""))
        # a surname's people, counted by sex as well: a title may tell which one is meant
        by_sex = named.groupBy("scope", "last", "initial").agg(F.count("*").alias("n"), F.min("person").alias("b"), *(x for s in "mf" for x in (F.count_if(F.coalesce("sex", F.lit(s)) == s).alias(f"n_{s}"), F.min(F.when(F.coalesce("sex", F.lit(s)) == s, F.col("person"))).alias(f"b_{s}"))))
        loose = state.where(initials).join(persons.where("full is null").select("person", F.col("sex").alias("of")), "person").select("scope", "person", "last", "initial", F.coalesce("of", "sex").alias("of")).distinct()
        met = loose.join(by_sex, ["scope", "last", "initial"])
        n, b = (F.when(F.col("of") == "m", F.col(f"{x}_m")).when(F.col("of") == "f", F.col(f"{x}_f")).otherwise(F.col(x)) for x in "nb")
        links = met.where(n == 1).select("person", b.alias("b"))
        # a person who may be several others joins none of them
        links = links.groupBy("person").agg(F.min("b").alias("b"), F.max("b").alias("most")).where("b = most").select(F.col("person").alias("a"), "b")
        state = _merged(state, links, cut, step)
    full = state.groupBy("person").agg(F.min("full").alias("full"), F.min("mention").alias("least"))
    return state.drop("full").join(full, "person").select("scope", "mention", F.col("least").alias("person"), "full")
