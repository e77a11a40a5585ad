"""Formats over the driver's tables: their rows as XML and JSON documents, read as leaves, changed at their places and written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import api
from ..functions import keys
from ..operators import structured
from ..sources import leaves, splits
from ..sources.scratch import Scratch
from . import portable as P

QUERIES, ORACLE_SQL = {}, {}
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _documents(spark, sf) -> DataFrame:
    """Each document that holds an email, four times in one XML document: as text, as CDATA, in a comment, and with its at signs as references and tags."""
    p = P.PATTERNS["EMAIL_ADDRESS"]
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", _CONTROL, " "), r"\r", " "), "--|]]>", "  ")
    docs = P.table(spark, sf, "documents").where(F.col("text").rlike(p)).select("doc_id", F.concat(F.lit("."), t, F.lit(".")).alias("t"))
    split = F.regexp_replace(_escaped(F.col("t")), "@", "<b>&#64;</b>")
    parts = ["<doc><body>", _escaped(F.col("t")), "</body><raw><![CDATA[", F.col("t"), "]]></raw><!--", F.col("t"), "--><cut>", split, "</cut></doc>"]
    return docs.select("doc_id", "t", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("xml"))


def xml_emails_masked(spark, sf):
    """Emails of XML documents replaced where they stand, across references and tags; all else is kept byte for byte."""
    docs = _documents(spark, sf)
    found = leaves.leaves(docs.select("doc_id", "xml", F.lit("xml").alias("kind")), text="xml", kind="kind")
    m = P.matched(found, "EMAIL_ADDRESS", "doc_id", "leaf_id", "kind", "path", "start", "end", "text")
    edit = F.struct(F.col("start_at").alias("start"), F.col("end_at").alias("end"), F.lit("<EMAIL>").alias("new"))
    changed = m.groupBy("doc_id", "leaf_id", "kind", "path", "start", "end", "text").agg(F.array_sort(F.collect_list(edit)).alias("edits")).withColumn("new", F.lit(""))
    none = found.where("kind = 'problem'").select("doc_id", "problem")
    out = structured.rewritten(docs.select("doc_id", "xml", F.lit("xml").alias("kind")), changed, none, text="xml", kind="kind")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("output", 256).alias("sha256"), "n_values", "problem")


QUERIES["xml_emails_masked"] = xml_emails_masked
_P = P.PATTERNS["EMAIL_ADDRESS"]
_LOCAL, _HOST = _P.split("@")
_esc = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE_SQL["xml_emails_masked"] = f"""
with d as (select doc_id, '.' || regexp_replace(regexp_replace(regexp_replace(text, '{_CONTROL}', ' ', 'g'), '\\r', ' ', 'g'), '--|]]>', '  ', 'g') || '.' as t from documents where regexp_matches(text, '{_P}')),
e as (select *, replace({_esc('t')}, '@', '<b>&#64;</b>') as cut, len(regexp_extract_all(t, '{_P}')) as n from d)
select doc_id, sha256('<doc><body>' || regexp_replace({_esc('t')}, '{_P}', '&lt;EMAIL&gt;', 'g') || '</body><raw><![CDATA[' || regexp_replace(t, '{_P}', '<EMAIL>', 'g') || ']]></raw><!--' || regexp_replace(t, '{_P}', '<EMAIL>', 'g')
    || '--><cut>' || regexp_replace(cut, '{_LOCAL}<b>&#64;</b>{_HOST}', '&lt;EMAIL&gt;<b></b>', 'g') || '</cut></doc>') as sha256, cast(4 * n as bigint) as n_values, cast(null as varchar) as problem from e"""


def xml_leaves_of_turns(spark, sf):
    """Turns of conversations as XML: their leaves are the values that went in."""
    t = F.trim(F.regexp_replace(F.regexp_replace("text", _CONTROL, " "), r"\s+", " "))
    rows = P.table(spark, sf, "conversations").select("conv_id", "turn", "role", t.alias("t"))
    parts = ['<turn n="', F.col("turn").cast("string"), '"><who>', _escaped(F.col("role")), "</who><said><i>", _escaped(F.substring("t", 1, 5)), "</i>", _escaped(F.expr("substring(t, 6)")), "</said></turn>"]
    docs = rows.select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("xml"), F.lit("xml").alias("kind"))
    found = leaves.leaves(docs, text="xml", kind="kind")
    return found.groupBy("path", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.bit_xor(F.crc32(F.concat_ws("|", "doc_id", "text").cast("binary"))).alias("mark")).drop("mark")


QUERIES["xml_leaves_of_turns"] = xml_leaves_of_turns
ORACLE_SQL["xml_leaves_of_turns"] = f"""
with r as (select turn, role, trim(regexp_replace(regexp_replace(text, '{_CONTROL}', ' ', 'g'), '\\s+', ' ', 'g')) as t from conversations)
select '/turn/@n' as path, 'attribute' as kind, count(*) as n, cast(sum(length(cast(turn as varchar))) as bigint) as chars from r
union all select '/turn/who', 'text', count(*), cast(sum(length(role)) as bigint) from r
union all select '/turn/said', 'text', count(*), cast(sum(length(t)) as bigint) from r where length(t) > 5
union all select '/turn/said/i', 'text', count(*), cast(sum(length(t)) as bigint) from r where length(t) between 1 and 5 having count(*) > 0"""


def labelled_fields(spark, sf):
    """Customers as forms of label and value: what the values are is what their labels say."""
    c = P.table(spark, sf, "customer")
    field = lambda label, value: F.struct(F.lit(label).alias("name"), value.alias("value"))
    form = F.struct(F.array(field("email", F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example"))), field("plan", F.col("c_mktsegment")), field("Phone Number", F.format_string("+1 458 555 %04d", F.col("c_custkey") % 10000))).alias("fields"))
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.to_json(form).alias("text"), F.lit("json").alias("kind"))
    found = structured.labelled(leaves.leaves(docs, kind="kind")).where("kind = 'value'")
    return found.select(F.col("doc_id").cast("long").alias("c_custkey"), "path", "key", keys.header(F.col("key")).alias("entity"), "text")


QUERIES["labelled_fields"] = labelled_fields
ORACLE_SQL["labelled_fields"] = """
with f as (select c_custkey, unnest([{'i': 0, 'k': 'email', 'e': 'EMAIL_ADDRESS', 'v': 'c' || c_custkey || '@mail.example'}, {'i': 1, 'k': 'plan', 'e': null, 'v': c_mktsegment},
    {'i': 2, 'k': 'Phone Number', 'e': 'PHONE_NUMBER', 'v': '+1 458 555 ' || lpad(cast(c_custkey % 10000 as varchar), 4, '0')}]) as f from customer)
select c_custkey, '$.fields[' || f.i || '].value' as path, f.k as key, f.e as entity, f.v as text from f
union all select c_custkey, '$.fields[' || f.i || '].name', 'fieldname', null, f.k from f"""


def csv_by_ranges(spark, sf):
    """Documents written as CSV and read back by ranges: every text is whole, whatever lines and quotes it holds."""
    scratch = Scratch(spark)
    docs = P.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    docs.select(F.concat_ws(",", cell("doc_id"), cell("lang"), cell("text")).alias("value")).write.text(f"{scratch.root}/documents.csv")
    rows = splits.csv_rows(spark, f"{scratch.root}/documents.csv", ",", '"')
    return rows.select(F.col("cells")[0].cast("long").alias("doc_id"), F.col("cells")[1].alias("lang"), F.sha2(F.col("cells")[2].cast("binary"), 256).alias("sha256"))


QUERIES["csv_by_ranges"] = csv_by_ranges
ORACLE_SQL["csv_by_ranges"] = "select doc_id, coalesce(lang, '') as lang, sha256(coalesce(text, '')) as sha256 from documents"


def json_lines_by_ranges(spark, sf):
    """Turns of conversations written as JSON Lines and read back by ranges: leaves by key."""
    scratch = Scratch(spark)
    P.table(spark, sf, "conversations").select("conv_id", "role", "text").write.json(f"{scratch.root}/turns.jsonl")
    found = splits.json_lines(spark, f"{scratch.root}/turns.jsonl").where("kind in ('value', 'number', 'problem')")
    return found.groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


QUERIES["json_lines_by_ranges"] = json_lines_by_ranges
ORACLE_SQL["json_lines_by_ranges"] = " union all ".join(
    f"select '{c}' as key, '{kind}' as kind, count(*) as n, cast(sum(length(cast({c} as varchar))) as bigint) as chars from conversations where {c} is not null" for c, kind in (("conv_id", "number"), ("role", "value"), ("text", "value"))
)


def sql_spans(spark, sf):
    """Emails of documents by the table function, in plain SQL."""
    api.register_functions(spark)
    P.table(spark, sf, "documents").createOrReplaceTempView("veil_documents")
    return spark.sql("select d.doc_id, s.entity, s.value, count(*) as n from veil_documents d, lateral pii_spans(d.text) s where s.entity = 'EMAIL_ADDRESS' group by all")


QUERIES["sql_spans"] = sql_spans
ORACLE_SQL["sql_spans"] = f"select doc_id, entity, value, count(*) as n from ({P.sql_matched('EMAIL_ADDRESS', 'doc_id')}) group by all"


def sql_leaves(spark, sf):
    """Leaves of the events' properties by the table function, in plain SQL."""
    api.register_functions(spark)
    P.table(spark, sf, "events").createOrReplaceTempView("veil_events")
    return spark.sql("select e.event_id, l.path, l.text from veil_events e, lateral pii_leaves(e.props, 'json') l where l.kind in ('number', 'value')")


QUERIES["sql_leaves"] = sql_leaves
ORACLE_SQL["sql_leaves"] = "select event_id, '$.' || k as path, json_extract_string(props, '$.' || k) as text from (select event_id, props, unnest(json_keys(props)) as k from events)"
