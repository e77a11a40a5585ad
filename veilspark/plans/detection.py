"""Detection queries: where personal values stand, which are valid, and of what class."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, identifiers, keys
from ..operators import detect, fields, lexicon
from ..sources import csvsource
from . import portable as P

QUERIES, ORACLE_SQL = {}, {}


def _spans(name: str, entity: str) -> None:
    QUERIES[f"span_{name}"] = lambda spark, sf: P.matched(P.table(spark, sf, "documents"), entity, "doc_id").select("doc_id", F.col("ord").cast("long").alias("ord"), "start_at", "end_at", "value")
    ORACLE_SQL[f"span_{name}"] = f"select doc_id, ord, start_at, end_at, value from ({P.sql_matched(entity, 'doc_id')})"


for _name, _entity in (("email", "EMAIL_ADDRESS"), ("phone", "PHONE_NUMBER"), ("ipv4", "IP_ADDRESS"), ("card", "CREDIT_CARD"), ("token", "SECRET")):
    _spans(_name, _entity)


def card_luhn_valid(spark, sf):
    """Card numbers with their check and network."""
    m = P.matched(P.table(spark, sf, "documents"), "CREDIT_CARD", "doc_id")
    return m.select("doc_id", "start_at", "value", checks.luhn(F.col("value")).alias("valid"), checks.card_network(F.col("value")).alias("network"))


QUERIES["card_luhn_valid"] = card_luhn_valid
_NETWORK = """case when regexp_matches(value, '^4') then 'visa' when regexp_matches(value, '^5[1-5]|^2(22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)') then 'mastercard'
    when regexp_matches(value, '^3[47]') then 'amex' when regexp_matches(value, '^35') then 'jcb' when regexp_matches(value, '^3[68]') then 'diners'
    when regexp_matches(value, '^6011|^64[4-9]|^65') then 'discover' when regexp_matches(value, '^62') then 'unionpay' end"""
ORACLE_SQL["card_luhn_valid"] = f"select doc_id, start_at, value, {P.sql_luhn('value')} as valid, {_NETWORK} as network from ({P.sql_matched('CREDIT_CARD', 'doc_id')})"


def ipv4_classes(spark, sf):
    """Dotted addresses by class."""
    m = P.matched(P.table(spark, sf, "documents"), "IP_ADDRESS", "doc_id")
    v = F.col("value")
    kind = F.when(~checks.ipv4(v), "none").when(checks.private_ip(v), "private").when(checks.shared_ip(v), "shared").otherwise("public")
    return m.select("doc_id", "start_at", "value", kind.alias("class"))


QUERIES["ipv4_classes"] = ipv4_classes
ORACLE_SQL["ipv4_classes"] = f"""
with m as (select doc_id, start_at, value, list_transform(string_split(value, '.'), lambda x: cast(x as integer)) as o from ({P.sql_matched('IP_ADDRESS', 'doc_id')}))
select doc_id, start_at, value, case when list_max(o) > 255 then 'none'
    when o[1] = 10 or (o[1] = 172 and o[2] between 16 and 31) or (o[1] = 192 and o[2] = 168) then 'private'
    when o[1] in (0, 127) or value in ('8.8.8.8', '8.8.4.4', '1.1.1.1', '1.0.0.1', '9.9.9.9', '255.255.255.255') then 'shared' else 'public' end as class
from m"""


def _weighted(name: str, table: str, key: str, width: int, kind: str, sql: str) -> None:
    """A check of the registry over zero-padded keys, beside the same sum in SQL."""
    spec = next(k for k in identifiers.REGISTRY if k.kind == kind)

    def query(spark, sf):
        v = F.lpad(F.col(key).cast("string"), width, "0")
        return P.table(spark, sf, table).select(F.col(key).alias("id"), identifiers.valid(spec, v).alias("valid"))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"select id, coalesce({sql}, false) as valid from (select {key} as id, lpad(cast({key} as varchar), {width}, '0') as v from {table})"


def _sum(weights: list[int], v: str = "v") -> str:
    return "(" + " + ".join(f"{w} * cast(substr({v}, {i}, 1) as integer)" for i, w in enumerate(weights, 1)) + ")"


_weighted("check_bsn", "orders", "o_orderkey", 9, "BSN", f"({_sum([9, 8, 7, 6, 5, 4, 3, 2])} - cast(substr(v, 9, 1) as integer)) % 11 = 0")
_weighted("check_routing", "orders", "o_orderkey", 9, "ROUTING", f"{_sum([3, 7, 1, 3, 7, 1, 3, 7, 1])} % 10 = 0")
_weighted("check_tfn", "customer", "c_custkey", 9, "TFN", f"{_sum([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0")
_weighted("check_ean", "part", "p_partkey", 13, "EAN", f"(10 - {_sum([1, 3] * 6)} % 10) % 10 = cast(substr(v, 13, 1) as integer)")
_weighted("check_nhs", "orders", "o_orderkey", 10, "NHS_NUMBER", f"(11 - {_sum(list(range(10, 1, -1)))} % 11) % 11 <> 10 and cast(substr(v, 10, 1) as integer) = (11 - {_sum(list(range(10, 1, -1)))} % 11) % 11")
_weighted("check_sin", "customer", "c_custkey", 9, "SIN", P.sql_luhn("v"))
_weighted("check_pesel_sum", "orders", "o_orderkey", 10, "EGN", f"cast(substr(v, 10, 1) as integer) = {_sum([2, 4, 8, 5, 10, 9, 7, 3, 6])} % 11 % 10")
_weighted("check_abn", "orders", "o_custkey", 11, "ABN", f"({_sum([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0")
_weighted("check_nip", "orders", "o_orderkey", 10, "NIP", f"cast(substr(v, 10, 1) as integer) = {_sum([6, 5, 7, 2, 3, 4, 5, 6, 7])} % 11")
_weighted("check_regon", "orders", "o_orderkey", 9, "REGON", f"cast(substr(v, 9, 1) as integer) = {_sum([8, 9, 2, 3, 4, 5, 6, 7])} % 11 % 10")


def bank_spans(spark, sf):
    """The whole pattern bank, resolved; no SQL has its look-arounds."""
    docs = detect.detect(P.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.explode("spans").alias("s"))
    return docs.select("doc_id", "s.start", "s.end", "s.entity", "s.score", "s.value")


QUERIES["bank_spans"] = bank_spans


def key_hints(spark, sf):
    """What the columns of the tables are called after, and how many values each has."""
    parts = []
    for t in ("customer", "orders", "supplier", "part", "documents", "events", "nation", "region"):
        df = P.table(spark, sf, t)
        counts = df.agg(*(F.count(c).alias(c) for c in df.columns))
        parts.append(counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("name", "n")))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df.select("name", "n", F.array_join(keys.words(F.col("name")), " ").alias("words"), keys.hint(F.col("name")).alias("entity"), keys.structural(F.col("name")).alias("structural"))


QUERIES["key_hints"] = key_hints

_NOTICES = ["MIT License", "Apache License", "GNU General Public License", "CC BY-NC"]


def dictionary_join(spark, sf):
    """Known literals found in all documents by an equi-join of n-grams."""
    entries = spark.createDataFrame([("all", "NOTICE", n) for n in _NOTICES], "scope string, entity string, literal string")
    docs = P.table(spark, sf, "documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("leaf_id"), "text")
    found = lexicon.match(docs, entries).where(F.col("value").isin(*_NOTICES))
    return found.groupBy(F.col("value").alias("literal")).agg(F.count("*").alias("n"), F.countDistinct("leaf_id").alias("docs"))


QUERIES["dictionary_join"] = dictionary_join
ORACLE_SQL["dictionary_join"] = " union all ".join(
    f"select '{n}' as literal, cast(sum(len(regexp_extract_all(text, '{n}'))) as bigint) as n, cast(count(*) as bigint) as docs from documents where contains(text, '{n}') having count(*) > 0" for n in _NOTICES
)


def categorical_fields(spark, sf):
    """Which columns of orders are categories."""
    leaves = fields.unpivoted(P.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return fields.categorical(leaves)


QUERIES["categorical_fields"] = categorical_fields
ORACLE_SQL["categorical_fields"] = """
with l as (select 'o_orderstatus' as field, o_orderstatus as text from orders union all select 'o_orderpriority', o_orderpriority from orders)
select field, count(*) as n, count(distinct text) as n_distinct,
    count(*) >= 4 and max(length(text)) <= 32 and (bool_and(text = upper(text)) or bool_and(text = lower(text))) and count(distinct text) <= 12 and count(distinct text) < count(*) as categorical
from l where text is not null and text <> '' group by field"""


def identifier_columns(spark, sf):
    """Columns whose values pass one kind's check."""
    docs = P.matched(P.table(spark, sf, "documents"), "CREDIT_CARD", "doc_id").select(F.lit("cards").alias("field"), F.col("value").alias("text"))
    rows = P.table(spark, sf, "orders").select(F.lit("o_orderkey").alias("field"), F.col("o_orderkey").cast("string").alias("text"))
    return fields.identifier_columns(docs.union(rows))


QUERIES["identifier_columns"] = identifier_columns


def neutralised_lines(spark, sf):
    """Lines that a spreadsheet would run, made harmless."""
    parts = F.explode(F.array(F.concat(F.lit("="), F.col("c_name")), F.col("c_acctbal").cast("string"), F.concat(F.lit("@"), F.col("c_mktsegment")), F.concat(F.lit("-"), F.col("c_nationkey").cast("string"))))
    cells = P.table(spark, sf, "customer").select("c_custkey", parts.alias("cell"))
    return cells.select("c_custkey", "cell", csvsource.neutralised(F.col("cell")).alias("safe"))


QUERIES["neutralised_cells"] = neutralised_lines
ORACLE_SQL["neutralised_cells"] = """
with c as (select c_custkey, unnest(['=' || c_name, cast(c_acctbal as varchar), '@' || c_mktsegment, '-' || cast(c_nationkey as varchar)]) as cell from customer)
select c_custkey, cell, case when regexp_matches(cell, '^[=@+-]') and not regexp_matches(cell, '^[+-]?[0-9]+([.,][0-9]+)*%?$') then '''' || cell else cell end as safe from c"""
