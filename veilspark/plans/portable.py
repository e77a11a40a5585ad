"""Patterns and SQL fragments that read the same in Spark and in DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S

SEED = "veil"
PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9][A-Za-z0-9-]*)+",
    "PHONE_NUMBER": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "IP_ADDRESS": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "CREDIT_CARD": r"[0-9]{16}",
    "SECRET": r"[0-9a-f]{40}",
}
SCORES = {"EMAIL_ADDRESS": 1.0, "PHONE_NUMBER": 0.75, "IP_ADDRESS": 0.6, "CREDIT_CARD": 0.95, "SECRET": 0.9}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matched(docs: DataFrame, entity: str, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., entity, ord, start_at, end_at, value) of one entity's matches; texts without any are dropped by a cheap filter first."""
    rows = docs.where(F.col(text).rlike(PATTERNS[entity])).select(*keep, F.posexplode(S.matches(F.col(text), PATTERNS[entity])).alias("ord", "m"))
    return rows.select(*keep, F.lit(entity).alias("entity"), (F.col("ord") + 1).alias("ord"), F.col("m.start").alias("start_at"), F.col("m.end").alias("end_at"), F.col("m.value").alias("value"))


#: What each match of a pattern holds: a text without it need not be searched.
HOLDS = {"EMAIL_ADDRESS": "@", "PHONE_NUMBER": "+1 ("}


def values(docs: DataFrame, entities: Sequence[str], text: str = "text") -> DataFrame:
    """(entity, value): the distinct matches of some entities, from one pass over the texts, in which each pattern searches a text once."""

    def found(entity: str) -> Column:
        each = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[entity]), F.lit(0))
        held = F.contains(F.col(text), F.lit(HOLDS[entity])) if entity in HOLDS else F.col(text).isNotNull()
        return F.coalesce(F.when(held, F.transform(each, lambda v: F.struct(F.lit(entity).alias("entity"), v.alias("value")))), F.expr("cast(array() as array<struct<entity: string, value: string>>)"))

    # an outer explode, as the filter that the planner makes of another would search once more
    rows = docs.select(F.explode_outer(F.concat(*map(found, entities))).alias("x"))
    return rows.where(F.col("x").isNotNull()).select("x.entity", "x.value").distinct()


def all_matched(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    parts = [matched(docs, e, *keep, text=text) for e in PATTERNS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sql_matched(entity: str, *keep: str, table: str = "documents", text: str = "text") -> str:
    """The same in SQL: starts from the lengths of the pieces and matches before."""
    columns = "".join(f"{k}, " for k in keep)
    p = PATTERNS[entity]
    return f"""
    select {columns}'{entity}' as entity, i as ord,
        cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) as integer) as start_at,
        cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + list_sum(list_transform(found[1:i], lambda x: length(x))) as integer) as end_at,
        found[i] as value
    from (
        select {columns}regexp_extract_all({text}, '{p}') as found, string_split_regex({text}, '{p}') as pieces
        from {table} where regexp_matches({text}, '{p}')
    ), unnest(range(1, len(found) + 1)) t(i)"""


def sql_all(*keep: str, table: str = "documents", text: str = "text") -> str:
    return " union all ".join(sql_matched(e, *keep, table=table, text=text) for e in PATTERNS)


def sql_stream(kind: str, value: str, attempt: int = 0) -> str:
    """The hexadecimal digits of a draw."""
    return f"sha256(concat_ws(chr(0), '{SEED}', 'dataset', '{kind}', {value}, '{attempt}'))"


def sql_number(hexes: str, at: int, width: int = 8) -> str:
    return f"cast('0x' || substr({hexes}, {at + 1}, {width}) as bigint)"


def sql_pick(hexes: str, at: int, items: list) -> str:
    names = ", ".join(f"'{x}'" for x in items)
    return f"([{names}])[{sql_number(hexes, at)} % {len(items)} + 1]"


def sql_first_new(original: str, draw, attempts: int) -> str:
    """The first of the attempts that differs from the original."""
    out = draw(attempts - 1)
    for attempt in range(attempts - 2, -1, -1):
        out = f"case when lower({draw(attempt)}) <> lower({original}) then {draw(attempt)} else {out} end"
    return out


def sql_luhn(digits: str) -> str:
    """The mod-10 check of a string of digits."""
    d = f"cast(substr({digits}, length({digits}) - i + 1, 1) as integer)"
    return f"(select sum(case when i % 2 = 1 then {d} when {d} * 2 > 9 then {d} * 2 - 9 else {d} * 2 end) % 10 = 0 from unnest(range(1, length({digits}) + 1)) t(i))"
