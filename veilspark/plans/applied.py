"""Operators over the rows of the driver's tables: values that the tables give are written into the forms that an operator reads, and the SQL twin says what must come out of every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, keys, links, maps
from ..functions import spans as S
from ..functions import text as T
from ..operators import associate, checked, detect, distinct, entities, people, pseudonymise, readers, structured
from ..sources import formats, leaves
from ..sources.scratch import Scratch, dealt, large
from . import portable as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def _column(name: str, table: str, key: str, value: Callable[[], Column], made: str, result: Callable[[Column], Column], sql: str) -> None:
    """A query of a column function over a value that each row of a table gives; ``made`` and ``sql`` say the same in SQL, over ``v``."""
    _query(name, f"select {key}, v, {sql} as result from (select {key}, {made} as v from {table})")(lambda spark, sf: P.table(spark, sf, table).select(key, value().alias("v")).select(key, "v", result(F.col("v")).alias("result")))


def _padded(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")


def _pad(column: str, width: int) -> str:
    return f"lpad(cast({column} as varchar), {width}, '0')"


# ---- keys, texts and checks

_camel = lambda: F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
_CAMEL = "list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b)"
_parted = lambda: F.concat(F.initcap("p_name"), F.lit("_ID2"))
_PARTED = "list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) || '_ID2'"
_column("keys_words", "part", "p_partkey", lambda: F.element_at(F.array(_parted(), F.concat(F.lit("billing"), _camel(), F.lit("ZipCode")), F.concat(F.lit("XMLHttp"), _camel()), F.concat(F.lit("straße-"), F.col("p_name"), F.lit(".nr.2")), F.lit("")), (F.col("p_partkey") % 5 + 1).cast("int")),
        f"([{_PARTED}, 'billing' || {_CAMEL} || 'ZipCode', 'XMLHttp' || {_CAMEL}, 'straße-' || p_name || '.nr.2', ''])[p_partkey % 5 + 1]", lambda v: F.array_join(keys.words(v), " "),
        r"case p_partkey % 5 when 0 then lower(replace(v, '_', ' ')) when 1 then lower(regexp_replace(v, '([a-z])([A-Z])', '\1 \2', 'g')) when 2 then 'xml http ' || lower(regexp_replace(substr(v, 8), '([a-z])([A-Z])', '\1 \2', 'g')) else replace(replace(replace(v, 'ß', 'ss'), '-', ' '), '.', ' ') end")
_column("keys_folded", "conversations", "conv_id", lambda: F.col("text"), "text", lambda v: F.sha2(keys.plain(v), 256), "sha256(replace(replace(replace(replace(lower(strip_accents(v)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'))")
_column("keys_person_prefix", "events", "event_id", lambda: F.concat_ws("_", F.element_at(F.array(F.lit("applicant"), F.lit("plan"), F.lit("spouse")), (F.col("event_id") % 3 + 1).cast("int")), "event_type"),
        "(['applicant', 'plan', 'spouse'])[event_id % 3 + 1] || '_' || event_type", keys.person_prefix, "case when v not like 'plan%' then split_part(v, '_', 1) end")
_column("format_by_name", "pages", "page_id", lambda: F.concat("url", F.element_at(F.array(*map(F.lit, (".JSON", ".ndjson", ".tsv", ".exe", "x"))), (F.col("page_id") % 5 + 1).cast("int"))), "url || (['.JSON', '.ndjson', '.tsv', '.exe', 'x'])[page_id % 5 + 1]",
        formats.classify, "case lower(regexp_extract(v, '\\.([A-Za-z0-9]+)$', 1)) when 'json' then 'json' when 'ndjson' then 'jsonl' when 'tsv' then 'csv' when '' then null else 'unknown' end")
_column("text_company", "supplier", "s_suppkey", lambda: F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, " GmbH").otherwise("")), "s_name || case when s_suppkey % 2 = 0 then ' GmbH' else '' end", T.company, "v like '% GmbH'")
_column("text_visible", "conversations", "conv_id", lambda: F.regexp_replace("text", "e", "e­​"), "replace(text, 'e', 'e' || chr(173) || chr(8203))", lambda v: F.sha2(T.visible(v), 256), "sha256(replace(replace(v, chr(173), ''), chr(8203), ''))")
_column("links_decoded", "conversations", "conv_id", lambda: F.url_encode("text"), "replace(replace(url_encode(text), '%20', '+'), '~', '%7E')", lambda v: F.sha2(links.decoded(v), 256), "sha256(url_decode(replace(v, '+', '%20')))")
_column("check_epoch", "events", "event_id", lambda: F.expr("cast(timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as string)"), "cast(epoch_us(ts) // 1000 as varchar)", checks.epoch_milliseconds, "length(v) = 13 and v not like '4%'")
_column("check_ssn", "orders", "o_orderkey", lambda: F.lpad((F.col("o_orderkey") * 7919 % 1_000_000_000).cast("string"), 9, "0"), _pad("(o_orderkey * 7919 % 1000000000)", 9), checks.ssn,
        "not regexp_matches(v, '^(000|666|9)') and substr(v, 4, 2) <> '00' and substr(v, 6, 4) <> '0000' and v not in (" + ", ".join(f"'{x}'" for x in checks.SAMPLE_SSNS) + ")")
_column("check_itin", "orders", "o_orderkey", lambda: F.concat(F.lit("9"), F.lpad((F.col("o_orderkey") * 7919 % 100_000_000).cast("string"), 8, "0")), "'9' || " + _pad("(o_orderkey * 7919 % 100000000)", 8), checks.itin,
        "cast(substr(v, 4, 2) as integer) between 50 and 65 or cast(substr(v, 4, 2) as integer) between 70 and 88 or cast(substr(v, 4, 2) as integer) in (90, 91, 92, 94, 95, 96, 97, 98, 99)")
_column("check_iban", "orders", "o_orderkey", lambda: F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), _padded("o_orderkey", 18)), "'DE' || " + _pad("(o_orderkey % 97)", 2) + " || " + _pad("o_orderkey", 18), checks.iban,
        "cast(substr(v, 5) || '1314' || substr(v, 3, 2) as hugeint) % 97 = 1")
_column("check_icao", "customer", "c_custkey", lambda: F.upper("c_name"), "upper(c_name)", lambda v: checks.icao(v).cast("int"),
        "cast(list_sum(list_transform(range(1, length(v) + 1), lambda i: (case when substr(v, i, 1) between '0' and '9' then ascii(substr(v, i, 1)) - 48 when substr(v, i, 1) between 'A' and 'Z' then ascii(substr(v, i, 1)) - 55 else 0 end) * ([7, 3, 1])[(i - 1) % 3 + 1])) % 10 as integer)")
_column("check_verhoeff_single", "orders", "o_orderkey", lambda: _padded("o_orderkey", 8), _pad("o_orderkey", 8), lambda v: (checks.verhoeff(F.concat(v, F.lit("0"))).cast("int") + sum(checks.verhoeff(F.concat(v, F.lit(str(d)))).cast("int") for d in range(1, 10))), "1")
# English, German, French and Spanish, and a day that there is not
_SPELLED = (
    "January February March April May June July August September October November December", "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre", "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)
_MONTHS = "[" + ", ".join(str(x.split()) for x in _SPELLED) + "]"


def _dates() -> Column:
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    month = [F.element_at(keys.literals(x.split()), F.month("o_orderdate")) for x in _SPELLED]
    forms = F.concat_ws(" ", day, month[0], year), F.concat(day, F.lit(". "), month[1], F.lit(" "), year), F.concat_ws(" ", F.lit("le"), day, month[2], year), F.concat_ws(" de ", day, month[3], year), F.concat(F.lit("31 February "), year)
    return F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))


_column("reader_dates", "orders", "o_orderkey", _dates,
        "case o_orderkey % 5 when 4 then '31 February ' || year(o_orderdate) when 0 then concat_ws(' ', day(o_orderdate), {m}, year(o_orderdate)) when 1 then day(o_orderdate) || '. ' || {m} || ' ' || year(o_orderdate) when 2 then concat_ws(' ', 'le', day(o_orderdate), {m}, year(o_orderdate)) else concat_ws(' de ', day(o_orderdate), {m}, year(o_orderdate)) end".format(m=f"{_MONTHS}[o_orderkey % 5 + 1][month(o_orderdate)]"),
        lambda v: readers.written_date(v).cast("string"),
        f"case when o_orderkey % 5 < 4 then regexp_extract(v, '[0-9]{{4}}') || '-' || lpad(cast(list_position({_MONTHS}[o_orderkey % 5 + 1], regexp_extract(v, '[^0-9. ]{{3,}}')) as varchar), 2, '0') || '-' || lpad(regexp_extract(v, '[0-9]+'), 2, '0') end")
_column("people_natural_order", "customer", "c_custkey", lambda: F.concat_ws(", ", "c_mktsegment", F.col("c_name")), "c_mktsegment || ', ' || c_name", people.natural_order, "split_part(v, ', ', 2) || ' ' || split_part(v, ', ', 1)")


# ---- readers: every row of events as one line of a log or a settings file


def _read(name: str, line: Callable[[], Column], read: Callable[[Column], Column], want: str) -> None:
    """Spans that a reader finds in lines made of events; places are checked against the lines."""

    @_query(name, f"select event_id, entity, value, true as in_place from (select event_id, unnest([{want}], recursive := true) from events)")
    def query(spark, sf):
        rows = dealt(P.table(spark, sf, "events"), "event_id").select("event_id", line().alias("line"))
        each = rows.select("event_id", "line", F.explode(read(F.col("line"))).alias("s"))
        return each.select("event_id", "s.entity", "s.value", (F.substring("line", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) == F.col("s.value")).alias("in_place"))


_n = lambda: F.col("event_id").cast("string")
_LONG = 900
_read("reader_pairs", lambda: F.concat(F.lit('{"plan": "pro", "password": "'), F.lit("Pw-"), F.repeat(F.lit("x"), _LONG), _n(), F.lit('", email => \'u'), _n(), F.lit("@x.example'}")), readers.pairs,
      f"{{'entity': 'SECRET', 'value': 'Pw-' || repeat('x', {_LONG}) || event_id}}, {{'entity': 'EMAIL_ADDRESS', 'value': 'u' || event_id || '@x.example'}}")
_read("reader_cookies", lambda: F.concat(F.lit("Set-Cookie: theme=dark-mode; pad="), F.repeat(F.lit("y"), 300), F.lit("; session_id=abcdef"), _n(), F.lit("; Path=/")), readers.cookies, "{'entity': 'SECRET', 'value': 'abcdef' || event_id}")
_read("reader_connections", lambda: F.concat(F.lit("postgres://u"), F.col("user_id").cast("string"), F.lit(":pw-"), _n(), F.lit("@db.example:5432/x Server=a;User ID=app"), _n(), F.lit(";Password=s3cr"), _n(), F.lit(";")), readers.connection_strings,
      "{'entity': 'SECRET', 'value': 's3cr' || event_id}, {'entity': 'USERNAME', 'value': 'app' || event_id}, {'entity': 'SECRET', 'value': 'pw-' || event_id}")
_read("reader_labelled", lambda: F.concat(F.lit("Note: none\n**Email:** e"), _n(), F.lit("@x.example\n| Phone | +1 458 555 "), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"), F.lit(" |\n")), readers.labelled,
      "{'entity': 'EMAIL_ADDRESS', 'value': 'e' || event_id || '@x.example'}, {'entity': 'PHONE_NUMBER', 'value': '+1 458 555 ' || lpad(cast(event_id % 10000 as varchar), 4, '0')}")


# ---- the pattern bank itself, over documents

_BEFORE, _AFTER = "substr(text, start_at, 1)", "substr(text, end_at + 1, 1)"


def _bank(name: str, entity: str, sql: str) -> None:
    """Spans of one entity that the whole bank finds, resolved; the twin takes its pattern's matches by what stands around them."""

    @_query(f"bank_{name}", sql)
    def query(spark, sf):
        found = detect.detect(P.table(spark, sf, "documents").select("doc_id", "text"))
        return found.select("doc_id", F.explode("spans").alias("s")).where(F.col("s.entity") == entity).select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.value").alias("value"))


_matched = lambda entity: P.sql_matched(entity, "doc_id", "text")
_bank("email", "EMAIL_ADDRESS", f"select doc_id, start_at, end_at, value from ({_matched('EMAIL_ADDRESS')})")
_bank("card", "CREDIT_CARD", f"select doc_id, start_at, end_at, value from ({_matched('CREDIT_CARD')}) where {P.sql_luhn('value')} and not regexp_matches({_BEFORE}, '[0-9A-Za-z_-]') and not regexp_matches({_AFTER}, '[0-9A-Za-z_-]') and not regexp_matches(value, '^0')")
_bank("ip", "IP_ADDRESS", f"""select doc_id, start_at, end_at, value from (select *, list_transform(string_split(value, '.'), lambda x: cast(x as integer)) as o from ({_matched('IP_ADDRESS')}))
    where list_max(o) <= 255 and o[1] not in (0, 127) and value not in ('8.8.8.8', '8.8.4.4', '1.1.1.1', '1.0.0.1', '9.9.9.9', '255.255.255.255')""")  # fmt: skip
_bank("phone", "PHONE_NUMBER", f"select doc_id, start_at, end_at, value from ({_matched('PHONE_NUMBER')})")


@_query("engine_no_leak", f"select entity, count(distinct value) as originals, cast(0 as bigint) as left_over from ({P.sql_all('doc_id')}) where entity in ('EMAIL_ADDRESS', 'PHONE_NUMBER') group by entity")
def engine_no_leak(spark, sf):
    """Documents through the whole operator: how many emails and phones there were, and how many of them any output still shows."""
    docs = P.table(spark, sf, "documents")
    out = pseudonymise.pseudonymise(docs, P.SEED).select("doc_id", F.col("output").alias("text"))
    left = P.values(out, ("EMAIL_ADDRESS", "PHONE_NUMBER")).withColumn("left_over", F.lit(1))
    return P.values(docs, ("EMAIL_ADDRESS", "PHONE_NUMBER")).join(left, ["entity", "value"], "left").groupBy("entity").agg(F.count("*").alias("originals"), F.coalesce(F.sum("left_over"), F.lit(0)).cast("long").alias("left_over"))


# ---- values written so that a reader sees them and a search does not, behind each page's own markup

_DISGUISED = "'us<b>er</b>' || page_id || '&#64;qui' || chr(8203) || 'et.example'"
_PLAIN = "'user' || page_id || '@quiet.example'"


def _disguised(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("us<b>er</b>"), F.col("page_id").cast("string"), F.lit("&#64;qui\u200bet.example"))
    return P.table(spark, sf, "pages").select("page_id", F.concat("html", F.lit("<p>Mail "), raw, F.lit(", <i>cc</i></p>")).alias("text"))


def _disguised_spans(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, text, start, end, value, raw) of the disguised addresses that the bank finds through all layers."""
    seen = _disguised(spark, sf).withColumn("seen", maps.read(F.col("text"), maps.LAYERS)).withColumn("read", F.coalesce("seen.text", "text"))
    found = Scratch(spark).save(detect.detect(seen, text="read").select("page_id", "text", "seen", "spans"), "disguised")
    placed = found.select("page_id", "text", "spans", maps.places(F.col("text"), F.col("seen"), F.col("spans")).alias("places"))
    each = placed.select("page_id", "text", F.explode(F.arrays_zip("spans", "places")).alias("x"))
    return each.select("page_id", "text", "x.places.start", "x.places.end", "x.spans.value", "x.places.raw").where(F.col("value").endswith("@quiet.example"))


@_query("pages_disguised", f"select page_id, length(html) + 8 as start_at, length(html) + 8 + length({_DISGUISED}) as end_at, {_DISGUISED} as raw, {_PLAIN} as value from pages")
def pages_disguised(spark, sf):
    """Where disguised addresses stand in the markup, and what they read as."""
    return _disguised_spans(spark, sf).select("page_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "raw", "value")


@_query("pages_disguised_replaced", "select page_id, sha256(html || '<p>Mail new.name@other.example<b></b>, <i>cc</i></p>') as output_sha256 from pages")
def pages_disguised_replaced(spark, sf):
    """A fixed value written where they stand: the markup around and inside stays, the rest of the page byte for byte."""
    new = maps.written_like(F.lit("new.name@other.example"), F.col("raw"), maps.LAYERS)
    edit = F.array(F.struct(F.col("start"), F.col("end"), new.alias("new")))
    return _disguised_spans(spark, sf).select("page_id", F.sha2(S.apply_edits(F.col("text"), edit), 256).alias("output_sha256"))


@_query("pages_disguised_gone", f"select page_id, {_PLAIN} as value, false as left_over, true as rest_kept from pages")
def pages_disguised_gone(spark, sf):
    """Pages through the whole operator: whether the output still reads as the address, and keeps what stood behind it."""
    out = pseudonymise.pseudonymise(_disguised(spark, sf), P.SEED, key="page_id", through=maps.LAYERS)
    seen = out.select("page_id", "output", maps.read(F.col("output"), maps.LAYERS).alias("seen"), F.concat(F.lit("user"), F.col("page_id").cast("string"), F.lit("@quiet.example")).alias("value"))
    return seen.select("page_id", "value", F.contains(F.coalesce("seen.text", "output"), F.col("value")).alias("left_over"), F.col("output").endswith("<b></b>, <i>cc</i></p>").alias("rest_kept"))


# ---- records and documents


@_query("record_owners", "select c_custkey, case when c_custkey % 3 = 0 then c_name else n_name end as owner from customer join nation on c_nationkey = n_nationkey")
def record_owners(spark, sf):
    """Each customer's leaf belongs to the innermost record around it that names someone: the customer, else the nation."""
    c = P.table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("leaf_id"), F.array(F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("c"), F.col("c_custkey"))).alias("record_ids"))
    named = P.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("record_id"), F.col("n_name").alias("person"))
    named = named.unionByName(c.where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("record_id"), F.col("c_name").alias("person")))
    return associate.owners(rows, named).select(F.col("leaf_id").alias("c_custkey"), "owner")


def _customers_as(form: Column, kind: str):
    return lambda spark, sf: P.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), form.alias("text"), F.lit(kind).alias("kind"))


def _renamed(spark: SparkSession, docs: DataFrame, key: str, new: str) -> DataFrame:
    """Documents whose leaves of a key are replaced whole: doc_id, output, problem."""
    found = leaves.leaves(docs, kind="kind", nested=False).where((F.col("key") == key) | (F.col("kind") == "problem"))
    found = Scratch(spark).save(found, "leaves")
    hit = found.where((F.col("key") == key) & F.col("kind").isin("value", "text", "attribute"))
    edit = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(new).alias("new")))
    changed = hit.select("doc_id", "leaf_id", "kind", "path", "start", "end", "text", F.lit(new).alias("new"), edit.alias("edits"))
    out = structured.rewritten(docs, changed, found.where("kind = 'problem'").select("doc_id", "problem"), kind="kind")
    return out.select(F.col("doc_id").cast("long").alias("c_custkey"), "output", "problem")


@_query("json_patched", """select c_custkey, '{ "id":' || c_custkey || '.50, "name" : "New \\"N\\"", "tags":["' || c_mktsegment || '",null], "name":"New \\"N\\"" }' || chr(10) as output, cast(null as varchar) as problem from customer""")
def json_patched(spark, sf):
    """Names in JSON documents replaced: spacing, number spellings, doubled keys and all else stay."""
    form = F.concat(F.lit('{ "id":'), F.col("c_custkey"), F.lit('.50, "name" : "'), "c_name", F.lit('", "tags":["'), "c_mktsegment", F.lit('",null], "name":"x" }\n'))
    return _renamed(spark, _customers_as(form, "json")(spark, sf), "name", 'New "N"')


@_query("csv_written", """select c_custkey, 'id;name;note' || chr(13) || chr(10) || c_custkey || ';"New;N";"' || c_mktsegment || chr(10) || 'x"' || chr(13) || chr(10) as output, cast(null as varchar) as problem from customer""")
def csv_written(spark, sf):
    """Names in CSV documents replaced: delimiter, quotes and line ends are those of the file."""
    form = F.concat(F.lit("id;name;note\r\n"), F.col("c_custkey"), F.lit(";"), "c_name", F.lit(';"'), "c_mktsegment", F.lit('\nx"\r\n'))
    return _renamed(spark, _customers_as(form, "csv")(spark, sf), "name", "New;N")


@_query("xml_written", """select c_custkey, '<c seg="' || c_mktsegment || '"><name><![CDATA[N & N]]></name><note>to <name>N &amp; N</name> ' || c_name || '</note></c>' as output, cast(null as varchar) as problem from customer""")
def xml_written(spark, sf):
    """Names in XML documents replaced where they stand, in the spelling of each place; the same words elsewhere stay."""
    form = F.concat(F.lit('<c seg="'), "c_mktsegment", F.lit('"><name><![CDATA['), "c_name", F.lit("]]></name><note>to <name>"), "c_name", F.lit("</name> "), "c_name", F.lit("</note></c>"))
    return _renamed(spark, _customers_as(form, "xml")(spark, sf), "name", "N & N")


@_query("nested_records", "select event_id, p.path, p.text from (select event_id, unnest([{'path': '$.id', 'text': cast(event_id as varchar)}, {'path': '$.body~.type', 'text': event_type}, {'path': '$.body~.props~.k', 'text': json_extract_string(props, '$.k')}]) as p from events)")
def nested_records(spark, sf):
    """JSON in strings of JSON in strings of JSON: leaves with their whole paths."""
    e = P.table(spark, sf, "events")
    inner = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("props")))
    docs = e.select(F.col("event_id").cast("string").alias("doc_id"), F.to_json(F.struct(F.col("event_id").alias("id"), inner.alias("body"))).alias("text"), F.lit("json").alias("kind"))
    return leaves.leaves(docs, kind="kind").where("kind in ('value', 'number')").select(F.col("doc_id").cast("long").alias("event_id"), "path", "text")


@_query("standin_distinct_ssn", """
with v as (select distinct lpad(cast(o_orderkey * 7919 % 899000000 + 1010101 as varchar), 9, '0') as v from orders),
f as (select v from v where not regexp_matches(v, '^(000|666|9)') and substr(v, 4, 2) <> '00' and substr(v, 6, 4) <> '0000')
select count(*) as originals, count(*) as stand_ins, count(*) as issuable from f""")
def standin_distinct_ssn(spark, sf):
    """Issuable numbers take issuable ones, each its own."""
    v = F.lpad((F.col("o_orderkey") * 7919 % 899_000_000 + 1_010_101).cast("string"), 9, "0")
    fine = lambda c: ~F.col(c).rlike("^(000|666|9)") & (F.substring(c, 4, 2) != "00") & (F.substring(c, 6, 4) != "0000")
    values = P.table(spark, sf, "orders").select(F.lit("dataset").alias("scope"), F.lit("US_SSN").alias("entity"), v.alias("original")).where(fine("original"))
    return distinct.stand_ins(values, P.SEED).agg(F.count("*").alias("originals"), F.countDistinct("stand_in").alias("stand_ins"), F.count_if(fine("stand_in")).alias("issuable"))


@_query("standin_distinct_people", "select count(*) as originals, count(*) as stand_ins, cast(0 as bigint) as clashes from (select distinct 'Customer N' || c_custkey as n from customer union select distinct 'Order N' || o_orderkey from orders)")
def standin_distinct_people(spark, sf):
    """Names of customers and orders take names of their own, none of which is one of theirs."""
    name = lambda table, word, key: P.table(spark, sf, table).select(F.concat(F.lit(f"{word} N"), F.col(key)).alias("original"))
    values = name("customer", "Customer", "c_custkey").union(name("orders", "Order", "o_orderkey")).select(F.lit("dataset").alias("scope"), F.lit("PERSON").alias("entity"), "original")
    scratch = Scratch(spark)
    values = scratch.save(distinct.stand_ins(values, P.SEED), "first")  # one row for each value
    drawn = distinct.settled(distinct.met(values, scratch), values, P.SEED, scratch)
    clashes = drawn.join(values.select(F.lower("original").alias("low")), F.lower("stand_in") == F.col("low"), "left_semi").agg(F.count("*").alias("clashes"))
    return drawn.agg(F.count("*").alias("originals"), F.countDistinct(F.lower("stand_in")).alias("stand_ins")).crossJoin(clashes)  # one row each


@_query("checked_rounds", "select true as all_read_first_by_index, true as later_rounds_read_less, cast(0 as bigint) as leaks_left, count(*) as documents from documents")
def checked_rounds(spark, sf):
    """Documents pseudonymised with their checks: the first round reads the texts that the index names, later ones only what the round before changed; no leak is left."""
    docs = P.table(spark, sf, "documents")
    done = checked.rounds(docs, P.SEED, Scratch(spark).save)
    n = docs.count()
    reads = [r.read for r in done.log]
    told = F.lit(reads[0] <= n).alias("all_read_first_by_index"), F.lit(all(b <= a for a, b in zip(reads, reads[1:]))).alias("later_rounds_read_less")
    left = done.suspects.agg(F.count("*").alias("leaks_left"))
    return left.crossJoin(done.outputs.agg(F.count("*").alias("documents"))).select(*told, "leaks_left", "documents")  # one row each


def files_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON documents: names and phones change, one stand-in for each name, all else stays as it was spelled."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    docs = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))).alias("text"), F.lit("json").alias("kind"))
    out = structured.pseudonymise_documents(docs, P.SEED, kind="kind").select("doc_id", F.get_json_object("output", "$.name").alias("name"), F.get_json_object("output", "$.id").alias("id"), F.get_json_object("output", "$.segment").alias("segment"))
    out = Scratch(spark).save(out, "customers")
    apart = out.agg(F.count_distinct("name").alias("names"))
    counts = out.join(large(c.select(F.col("c_custkey").cast("string").alias("doc_id"), "c_name")), "doc_id").groupBy("segment").agg(F.count("*").alias("n"), F.sum((F.col("id") == F.col("doc_id")).cast("long")).alias("ids_kept"), F.sum((F.col("name") != F.col("c_name")).cast("long")).alias("names_changed"))
    return counts.join(F.broadcast(apart))  # one row


QUERIES["files_customers"] = files_customers
ORACLE_SQL["files_customers"] = "select c_mktsegment as segment, count(*) as n, count(*) as ids_kept, count(*) as names_changed, (select count(distinct c_name) from customer) as names from customer group by c_mktsegment"


@_query("people_components", """
with m as (select event_id, user_id, event_id % 3 as r from events)
select event_id as mention, case when bool_or(r = 0) over (partition by user_id) then min(event_id) over (partition by user_id) else min(event_id) over (partition by user_id, r) end as person from m""")
def people_components(spark, sf):
    """Events as mentions of their users, some by mailbox, some by phone, some by both: the persons are the components."""
    r, user = F.col("event_id") % 3, F.col("user_id")
    mail, phone = F.concat(F.lit("u"), user, F.lit("@mail.example")), F.concat(F.lit("555"), F.lpad(user.cast("string"), 9, "0"))
    none = F.lit(None).cast("string")
    rows = P.table(spark, sf, "events").select(F.lit("d").alias("scope"), F.col("event_id").alias("mention"), none.alias("name"), F.when(r != 1, mail).alias("email"), F.when(r != 2, phone).alias("phone"), none.alias("handle"))
    return entities.resolve(rows, Scratch(spark).save).select("mention", "person")
