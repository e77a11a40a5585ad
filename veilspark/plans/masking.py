"""Masking queries: stand-ins, their consistency, and tables that still join."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import checks, draw
from ..operators import distinct, pseudonymise
from ..sources.scratch import Scratch
from . import portable as P

QUERIES, ORACLE_SQL = {}, {}


def _distinct(spark, sf, entity):
    return P.matched(P.table(spark, sf, "documents"), entity, "doc_id").select(F.lit("dataset").alias("scope"), "entity", F.col("value").alias("original")).distinct()


def standin_email(spark, sf):
    """Emails and their stand-ins."""
    return draw.stand_ins(_distinct(spark, sf, "EMAIL_ADDRESS"), P.SEED, ["EMAIL_ADDRESS"]).select("original", "stand_in")


def _email_sql(attempt: int) -> str:
    h = P.sql_stream("EMAIL_ADDRESS", "lower(original)", attempt)
    roles = ", ".join(f"'{r}'" for r in draw.ROLES)
    name = f"lower({P.sql_pick(h, 0, draw.FIRST)}) || '.' || lower({P.sql_pick(h, 8, draw.LAST)}) || '.' || cast({P.sql_number(h, 16)} % 10000 as varchar)"
    return f"(case when lower(split_part(original, '@', 1)) in ({roles}) then split_part(original, '@', 1) else {name} end || '@' || {P.sql_pick(h, 24, list(draw.DOMAINS))})"


QUERIES["standin_email"] = standin_email
_originals = lambda entity: f"select distinct value as original from ({P.sql_matched(entity, 'doc_id')})"
ORACLE_SQL["standin_email"] = f"select original, {P.sql_first_new('original', _email_sql, draw.ATTEMPTS)} as stand_in from ({_originals('EMAIL_ADDRESS')})"


def standin_ip(spark, sf):
    """Addresses and their stand-ins from the documentation range."""
    return draw.stand_ins(_distinct(spark, sf, "IP_ADDRESS"), P.SEED, ["IP_ADDRESS"]).select("original", "stand_in")


QUERIES["standin_ip"] = standin_ip
ORACLE_SQL["standin_ip"] = f"select original, {P.sql_first_new('original', lambda a: '(' + chr(39) + '203.0.113.' + chr(39) + ' || cast(' + P.sql_number(P.sql_stream('IP_ADDRESS', 'lower(original)', a), 0) + ' % 254 + 1 as varchar))', draw.ATTEMPTS)} as stand_in from ({_originals('IP_ADDRESS')})"


def standin_phone(spark, sf):
    """Phones in their own layout, at numbers kept for fiction."""
    return draw.stand_ins(_distinct(spark, sf, "PHONE_NUMBER"), P.SEED, ["PHONE_NUMBER"]).select("original", "stand_in")


def _phone_sql(attempt: int) -> str:
    h = P.sql_stream("PHONE_NUMBER", "substr(regexp_replace(original, '[^0-9]', '', 'g'), 2, 10)", attempt)
    area = P.sql_pick(h, 0, [p[3] for p in draw.PLACES])
    return f"('+1 (' || {area} || ') 555-01' || lpad(cast({P.sql_number(h, 8)} % 100 as varchar), 2, '0'))"


QUERIES["standin_phone"] = standin_phone
ORACLE_SQL["standin_phone"] = f"select original, {P.sql_first_new('original', _phone_sql, draw.ATTEMPTS)} as stand_in from ({_originals('PHONE_NUMBER')})"


def standin_secret(spark, sf):
    """Hexadecimal tokens stay hexadecimal."""
    return draw.stand_ins(_distinct(spark, sf, "SECRET"), P.SEED, ["SECRET"]).select("original", "stand_in")


QUERIES["standin_secret"] = standin_secret
ORACLE_SQL["standin_secret"] = f"select original, {P.sql_first_new('original', lambda a: 'substr(' + P.sql_stream('SECRET', 'original', a) + ', 1, 40)', draw.ATTEMPTS)} as stand_in from ({_originals('SECRET')})"


def standin_card(spark, sf):
    """Cards keep network, length and check: how many do."""
    drawn = draw.stand_ins(_distinct(spark, sf, "CREDIT_CARD"), P.SEED, ["CREDIT_CARD"])
    from ..functions import checks

    good = checks.luhn(F.col("stand_in")) & (F.length("stand_in") == F.length("original")) & (F.substring("stand_in", 1, 4) == F.substring("original", 1, 4)) & (F.col("stand_in") != F.col("original"))
    return drawn.agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("good"))


QUERIES["standin_card"] = standin_card
ORACLE_SQL["standin_card"] = f"select count(*) as n, cast(count(*) as bigint) as good from ({_originals('CREDIT_CARD')})"


def standin_consistency(spark, sf):
    """Every value has one stand-in, and no stand-in is an original."""
    found = P.all_matched(P.table(spark, sf, "documents"), "doc_id").select(F.lit("dataset").alias("scope"), "entity", F.col("value").alias("original"))
    scratch = Scratch(spark)
    found = scratch.save(found.distinct(), "values")  # read three times
    drawn = scratch.save(pseudonymise.guarded(draw.stand_ins(found, P.SEED, P.PATTERNS), found, P.SEED), "drawn")
    many = drawn.groupBy("entity", "original").agg(F.countDistinct("stand_in").alias("k"))
    clash = drawn.join(found.select(F.lower("original").alias("low")).distinct(), F.lower("stand_in") == F.col("low"), "left_semi").groupBy("entity").agg(F.count("*").alias("clashes"))
    return many.groupBy("entity").agg(F.count("*").alias("originals"), F.max("k").alias("most")).join(clash, "entity", "left").select("entity", "originals", "most", F.coalesce("clashes", F.lit(0)).cast("long").alias("clashes"))


QUERIES["standin_consistency"] = standin_consistency
ORACLE_SQL["standin_consistency"] = f"select entity, count(distinct value) as originals, cast(1 as bigint) as most, cast(0 as bigint) as clashes from ({P.sql_all('doc_id')}) group by entity"


def _tagged(text):
    for entity, pattern in P.PATTERNS.items():
        text = F.regexp_replace(text, pattern, f"<{entity}>")
    return text


def mask_tags(spark, sf):
    """Documents with every portable match as its tag, in one pass of native replacements."""
    docs = P.table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(_tagged(F.col("text")), 256).alias("masked_sha256"), F.length(_tagged(F.col("text"))).alias("n_chars"))


def _tags_sql(text: str) -> str:
    for entity, pattern in P.PATTERNS.items():
        text = f"regexp_replace({text}, '{pattern}', '<{entity}>', 'g')"
    return text


QUERIES["mask_tags"] = mask_tags
ORACLE_SQL["mask_tags"] = f"select doc_id, sha256({_tags_sql('text')}) as masked_sha256, cast(length({_tags_sql('text')}) as integer) as n_chars from documents"


def mask_email(spark, sf):
    """Documents with emails replaced by their stand-ins: edits are gathered per text, never per value."""
    docs = P.table(spark, sf, "documents")
    found = P.matched(docs, "EMAIL_ADDRESS", "doc_id")
    drawn = draw.stand_ins(found.select(F.lit("dataset").alias("scope"), "entity", F.col("value").alias("original")), P.SEED, ["EMAIL_ADDRESS"])
    from ..functions import spans as S

    edits = found.join(drawn.select(F.col("original").alias("value"), "stand_in"), "value").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.col("stand_in").alias("new")))).alias("edits"))
    return docs.join(edits, "doc_id").select("doc_id", F.sha2(S.apply_edits(F.col("text"), F.col("edits")), 256).alias("masked_sha256"))


QUERIES["mask_email"] = mask_email
ORACLE_SQL["mask_email"] = f"""
with m as ({P.sql_matched('EMAIL_ADDRESS', 'doc_id')}),
drawn as (select original, {P.sql_first_new('original', _email_sql, draw.ATTEMPTS)} as stand_in from ({_originals('EMAIL_ADDRESS')})),
pieces as (select m.doc_id, m.ord, stand_in, string_split_regex(d.text, '{P.PATTERNS['EMAIL_ADDRESS']}') as p from m join drawn on value = original join documents d using (doc_id))
select doc_id, sha256(string_agg(p[ord] || stand_in, '' order by ord) || max(p[len(p)])) as masked_sha256 from pieces group by doc_id"""


def pseudonymise_customer(spark, sf):
    """Customers with names of stand-ins."""
    out = P.table(spark, sf, "customer").select("c_custkey", F.concat_ws(" ", F.lit("Customer"), F.col("c_custkey").cast("string")).alias("name"))
    return out.select("c_custkey", draw.person(F.col("name"), P.SEED, "dataset").alias("stand_in"))


def _person_sql(attempt: int) -> str:
    h = P.sql_stream("PERSON", "lower(name)", attempt)
    return f"({P.sql_pick(h, 0, draw.FIRST)} || ' ' || {P.sql_pick(h, 8, draw.LAST)})"


QUERIES["pseudonymise_customer"] = pseudonymise_customer
ORACLE_SQL["pseudonymise_customer"] = f"select c_custkey, {P.sql_first_new('name', _person_sql, draw.ATTEMPTS)} as stand_in from (select c_custkey, 'Customer ' || c_custkey as name from customer)"


def pseudonymised_join_orders(spark, sf):
    """Totals after both keys were replaced: the join still works."""
    hidden = lambda c: draw.stream(P.SEED, "dataset", "RECORD_ID", F.col(c).cast("string"))
    c = P.table(spark, sf, "customer").select(hidden("c_custkey").alias("k"), "c_mktsegment")
    o = P.table(spark, sf, "orders").select(hidden("o_custkey").alias("k"), "o_totalprice")
    return o.join(c, "k").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


QUERIES["pseudonymised_join_orders"] = pseudonymised_join_orders
ORACLE_SQL["pseudonymised_join_orders"] = "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by c_mktsegment"


def masked_keys(spark, sf):
    """A masked column keeps its joins: distinct keys before and after."""
    df = P.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), "s_name")
    return api.mask_column(df, "s_name", P.SEED).agg(F.countDistinct("k").alias("keys"), F.count("s_name").alias("names"))


QUERIES["masked_keys"] = masked_keys
ORACLE_SQL["masked_keys"] = "select count(distinct s_suppkey) as keys, count(s_name) as names from supplier"


def pseudonymise_documents(spark, sf):
    """The whole operator over documents; its look-arounds and edits are beyond portable SQL."""
    out = pseudonymise.pseudonymise(P.table(spark, sf, "documents"), P.SEED)
    return out.select("doc_id", F.sha2("output", 256).alias("output_sha256"), "n_spans")


QUERIES["pseudonymise_documents"] = pseudonymise_documents


def _apart(name: str, entity: str, kept: str) -> None:
    """Different originals have different stand-ins, none of which is an original; ``kept`` is a pattern of what they look like."""

    def query(spark, sf):
        scratch = Scratch(spark)
        values = scratch.save(distinct.stand_ins(_distinct(spark, sf, entity), P.SEED), "first")
        drawn = scratch.save(distinct.settled(distinct.met(values, scratch), values, P.SEED, scratch), "drawn")
        clash = drawn.join(values.select(F.col("original").alias("stand_in")), "stand_in", "left_semi").agg(F.count("*").alias("clashes"))
        told = drawn.agg(F.count("*").alias("originals"), F.countDistinct(F.lower("stand_in")).alias("stand_ins"), F.count_if(F.col("stand_in").rlike(kept)).alias("kept"))
        return told.crossJoin(clash)  # one row each

    QUERIES[f"standin_distinct_{name}"] = query
    n = "count(distinct value)"
    ORACLE_SQL[f"standin_distinct_{name}"] = f"select {n} as originals, {n} as stand_ins, {n} as kept, cast(0 as bigint) as clashes from ({P.sql_matched(entity, 'doc_id')})"


_apart("phone", "PHONE_NUMBER", r"^\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}$")
_apart("card", "CREDIT_CARD", "^[0-9]{16}$")
_apart("token", "SECRET", "^[0-9a-f]{40}$")
_apart("email", "EMAIL_ADDRESS", r"^[a-z.0-9]+@example\.(com|net|org)$")


def standin_distinct_ip(spark, sf):
    """Public addresses take public ones: how many, how many different ones, and how many are no public address."""
    values = _distinct(spark, sf, "IP_ADDRESS").where(checks.ipv4(F.col("original")) & ~checks.shared_ip(F.col("original")) & ~checks.private_ip(F.col("original")))
    drawn = distinct.stand_ins(values, P.SEED)
    bad = ~checks.ipv4(F.col("stand_in")) | checks.private_ip(F.col("stand_in")) | checks.shared_ip(F.col("stand_in"))
    return drawn.agg(F.count("*").alias("originals"), F.countDistinct("stand_in").alias("stand_ins"), F.count_if(bad).alias("bad"))


QUERIES["standin_distinct_ip"] = standin_distinct_ip
ORACLE_SQL["standin_distinct_ip"] = f"""
with o as (select distinct value, list_transform(string_split(value, '.'), lambda x: cast(x as integer)) as o from ({P.sql_matched('IP_ADDRESS', 'doc_id')}))
select count(*) as originals, count(*) as stand_ins, cast(0 as bigint) as bad from o where list_max(o) <= 255 and o[1] not in (0, 10, 127) and not (o[1] = 172 and o[2] between 16 and 31) and not (o[1] = 192 and o[2] = 168)
    and value not in ('8.8.8.8', '8.8.4.4', '1.1.1.1', '1.0.0.1', '9.9.9.9', '255.255.255.255')"""


def standin_distinct_keys(spark, sf):
    """Keys of orders by their permutation: as many different ones, each as long as it was, none unchanged."""
    values = P.table(spark, sf, "orders").select(F.lit("dataset").alias("scope"), F.lit("ID_NUMBER").alias("entity"), F.col("o_orderkey").cast("string").alias("original"))
    drawn = distinct.stand_ins(values, P.SEED)
    return drawn.agg(
        F.count("*").alias("originals"), F.countDistinct("stand_in").alias("stand_ins"), F.count_if(F.length("stand_in") == F.length("original")).alias("as_long"), F.count_if(F.col("stand_in") == F.col("original")).alias("unchanged")
    )


QUERIES["standin_distinct_keys"] = standin_distinct_keys
ORACLE_SQL["standin_distinct_keys"] = "select count(distinct o_orderkey) as originals, count(distinct o_orderkey) as stand_ins, count(distinct o_orderkey) as as_long, cast(0 as bigint) as unchanged from orders"
