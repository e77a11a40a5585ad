"""Reports over found values: counts, cubes, joins between tables, findings, windows, and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import associate, fields, readers, review
from ..sources import jsonsource
from . import portable as P

QUERIES, ORACLE_SQL = {}, {}
_ALL = f"({P.sql_all('doc_id', 'lang', 'source')})"


def _found(spark, sf):
    return P.all_matched(P.table(spark, sf, "documents"), "doc_id", "lang", "source")


def _query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


@_query("counts_by_kind", f"select entity, count(*) as n, count(distinct value) as n_values, count(distinct doc_id) as docs from {_ALL} group by entity")
def counts_by_kind(spark, sf):
    return _found(spark, sf).groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.countDistinct("doc_id").alias("docs"))


@_query("counts_by_lang_kind", f"select lang, entity, count(*) as n from {_ALL} group by lang, entity")
def counts_by_lang_kind(spark, sf):
    return _found(spark, sf).groupBy("lang", "entity").agg(F.count("*").alias("n"))


@_query("rollup_source_kind", f"select coalesce(source, '*') as source, coalesce(entity, '*') as entity, count(*) as n from {_ALL} group by rollup (source, entity)")
def rollup_source_kind(spark, sf):
    r = _found(spark, sf).rollup("source", "entity").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("entity", F.lit("*")).alias("entity"), "n")


@_query("cube_lang_kind", f"select coalesce(lang, '*') as lang, coalesce(entity, '*') as entity, count(*) as n from {_ALL} group by cube (lang, entity)")
def cube_lang_kind(spark, sf):
    r = _found(spark, sf).cube("lang", "entity").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("entity", F.lit("*")).alias("entity"), "n")


_ANY = "(" + " or ".join(f"regexp_matches(text, '{p}')" for p in P.PATTERNS.values()) + ")"


def _any(text):
    out = F.lit(False)
    for p in P.PATTERNS.values():
        out = out | F.coalesce(text.rlike(p), F.lit(False))
    return out


@_query("docs_with_any_pii", f"select doc_id, source from documents where {_ANY}")
def docs_with_any_pii(spark, sf):
    return P.table(spark, sf, "documents").where(_any(F.col("text"))).select("doc_id", "source")


@_query("docs_clean_labelled", f"select doc_id, quality from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and {_ANY})")
def docs_clean_labelled(spark, sf):
    personal = P.table(spark, sf, "documents").where(_any(F.col("text"))).select("doc_id")
    return P.table(spark, sf, "labels").join(personal, "doc_id", "left_anti").select("doc_id", "quality")


@_query("docs_pii_and_labelled", f"select doc_id, lang from documents d where {_ANY} and exists (select 1 from labels l where l.doc_id = d.doc_id)")
def docs_pii_and_labelled(spark, sf):
    docs = P.table(spark, sf, "documents").where(_any(F.col("text")))
    return docs.join(P.table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@_query("top_docs_by_density", f"select doc_id, n, round(n * 1000.0 / n_chars, 4) as per_1000 from (select doc_id, count(*) as n from {_ALL} group by doc_id) join documents using (doc_id) order by n * 1000.0 / n_chars desc, doc_id limit 10")
def top_docs_by_density(spark, sf):
    n = _found(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"))
    density = F.col("n") * F.lit(1000.0) / F.col("n_chars")
    return P.table(spark, sf, "documents").select("doc_id", "n_chars").join(n, "doc_id").orderBy(density.desc(), "doc_id").limit(10).select("doc_id", "n", F.round(density, 4).alias("per_1000"))


_MARKS = f"(select entity, value, doc_id, case entity {' '.join(f"when '{e}' then cast({s} as double)" for e, s in P.SCORES.items())} end as confidence from {_ALL})"


def _marks(spark, sf):
    scores = F.create_map(*(F.lit(x) for pair in P.SCORES.items() for x in pair))
    found = _found(spark, sf)
    return found.select("entity", F.col("value").alias("original"), F.lit(None).cast("string").alias("stand_in"), F.lit(None).cast("string").alias("doubt"), F.element_at(scores, F.col("entity")).alias("confidence"), F.col("doc_id").alias("leaf_id"))


@_query("findings_summary", f"select entity, count(*) as n_findings, cast(sum(n) as bigint) as n_places, min(confidence) as confidence, cast(sum(case when confidence < 0.65 then 1 else 0 end) as bigint) as needs_review from (select entity, value, count(*) as n, min(confidence) as confidence from {_MARKS} group by entity, value) group by entity")
def findings_summary(spark, sf):
    return review.summary(_marks(spark, sf))


@_query("needs_review", f"select entity, value as original, count(*) as n from {_MARKS} where confidence < 0.65 group by entity, value")
def needs_review(spark, sf):
    m = _marks(spark, sf)
    return m.where(F.col("confidence") < review.REVIEW_BELOW).groupBy("entity", "original").agg(F.count("*").alias("n"))


@_query("surest_kind", f"select value as original, arg_max(entity, confidence) as entity, max(confidence) as confidence from {_MARKS} group by value")
def surest_kind(spark, sf):
    return _marks(spark, sf).groupBy("original").agg(F.max_by("entity", "confidence").alias("entity"), F.max("confidence").alias("confidence"))


@_query("first_seen", f"select entity, value, doc_id, start_at from (select *, row_number() over (partition by entity, value order by doc_id, start_at) as rn from {_ALL}) where rn = 1")
def first_seen(spark, sf):
    return _found(spark, sf).groupBy("entity", "value").agg(F.min(F.struct("doc_id", "start_at")).alias("f")).select("entity", "value", "f.doc_id", "f.start_at")


@_query("majority_kind", f"select source, arg_max(entity, struct_pack(n := n, e := entity)) as entity from (select source, entity, count(distinct value) as n from {_ALL} group by source, entity) group by source")
def majority_kind(spark, sf):
    n = _found(spark, sf).groupBy("source", "entity").agg(F.countDistinct("value").alias("n"))
    return n.groupBy("source").agg(F.max_by("entity", F.struct("n", "entity")).alias("entity"))


@_query("near_groups", f"""
select doc_id, cast(group_no as bigint) as group_no, count(*) as n, min(start_at) as first_at from (
    select *, sum(fresh) over (partition by doc_id order by start_at, end_at rows unbounded preceding) as group_no from (
        select *, case when coalesce(start_at - lag(end_at) over (partition by doc_id order by start_at, end_at) > 160, true) then 1 else 0 end as fresh from {_ALL}))
group by doc_id, group_no""")
def near_groups(spark, sf):
    s = _found(spark, sf).select(F.col("doc_id").alias("leaf_id"), F.col("start_at").alias("start"), F.col("end_at").alias("end"), "entity")
    return associate.near(s, 160).groupBy("leaf_id", "group_no").agg(F.count("*").alias("n"), F.min("start").alias("first_at")).withColumnRenamed("leaf_id", "doc_id")


# values of both documents and pages; pages are HTML, whose quotes are spelled out
_PAGES = f"(select distinct value from ({P.sql_all('page_id', table='pages', text='html')}))"
_DOCS = f"(select distinct value from {_ALL})"


def _values(spark, sf):
    docs = _found(spark, sf).select("value").distinct()
    pages = P.all_matched(P.table(spark, sf, "pages"), "page_id", text="html").select("value").distinct()
    return docs, pages


@_query("set_union_values", f"select value from {_DOCS} union select value from {_PAGES}")
def set_union_values(spark, sf):
    a, b = _values(spark, sf)
    return a.union(b).distinct()


@_query("set_intersect_values", f"select value from {_DOCS} intersect select value from {_PAGES}")
def set_intersect_values(spark, sf):
    a, b = _values(spark, sf)
    return a.intersect(b)


@_query("set_except_values", f"select value from {_DOCS} except select value from {_PAGES}")
def set_except_values(spark, sf):
    a, b = _values(spark, sf)
    return a.exceptAll(b)


@_query("cross_table_leak", f"select d.doc_id, p.page_id, d.value from (select distinct doc_id, value from {_ALL}) d join (select distinct page_id, value from ({P.sql_all('page_id', table='pages', text='html')})) p using (value)")
def cross_table_leak(spark, sf):
    d = _found(spark, sf).select("doc_id", "value").distinct()
    p = P.all_matched(P.table(spark, sf, "pages"), "page_id", text="html").select("page_id", "value").distinct()
    return d.join(p, "value").select("doc_id", "page_id", "value")


@_query("pages_url_parts", "select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '[?]([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages")
def pages_url_parts(spark, sf):
    u = F.col("url")
    return P.table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, "^https?://[^/?#]+([^?#]*)", 1).alias("path"), F.regexp_extract(u, "[?]([^#]*)", 1).alias("query"), F.regexp_extract(u, "#(.*)$", 1).alias("fragment"))


@_query("pages_parameters", "select split_part(pair, '=', 1) as name, count(*) as n, count(distinct pair) as n_values from (select unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) as pair from pages where contains(url, '?')) where pair <> '' group by name")
def pages_parameters(spark, sf):
    pairs = P.table(spark, sf, "pages").where(F.col("url").contains("?")).select(F.explode(F.split(F.regexp_extract("url", "[?]([^#]*)", 1), "&")).alias("pair")).where("pair <> ''")
    return pairs.groupBy(F.substring_index("pair", "=", 1).alias("name")).agg(F.count("*").alias("n"), F.countDistinct("pair").alias("n_values"))


@_query("pages_html_tokens", f"select page_id, count(*) as n from (select page_id, unnest(regexp_extract_all(replace(html, '&quot;', chr(34)), 'token = \"([0-9a-f]{{40}})\"')) as t from pages) group by page_id")
def pages_html_tokens(spark, sf):
    plain = F.regexp_replace("html", "&quot;", '"')
    found = P.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all(plain, F.lit('token = "([0-9a-f]{40})"'), F.lit(0))).alias("t"))
    return found.groupBy("page_id").agg(F.count("*").alias("n"))


@_query("exact_dup_documents", "select md5(text) as digest, count(*) as n, min(doc_id) as first_id from documents group by md5(text) having count(*) > 1")
def exact_dup_documents(spark, sf):
    return P.table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@_query("repeated_lines", "select line, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(line) >= 20 group by line having count(distinct doc_id) > 1")
def repeated_lines(spark, sf):
    lines = P.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("docs > 1")


@_query("events_json_leaves", "select event_id, '$.' || k as path, json_extract_string(props, '$.' || k) as text from (select event_id, props, unnest(json_keys(props)) as k from events)")
def events_json_leaves(spark, sf):
    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(e, f.path, f.text) for e, p in zip(batch.event_id, batch.props) if p for f in jsonsource.leaves(p) if f.kind != "key"]
            yield pd.DataFrame(rows, columns=["event_id", "path", "text"])

    return P.table(spark, sf, "events").select("event_id", "props").mapInPandas(run, "event_id long, path string, text string")


@_query("events_field_values", "select event_type, count(*) as n, count(distinct json_extract_string(props, '$.k')) as n_distinct, round(avg(value), 4) as mean_value from events group by event_type")
def events_field_values(spark, sf):
    e = P.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("props", "$.k")).alias("n_distinct"), F.round(F.avg("value"), 4).alias("mean_value"))


@_query("conv_turn_context", "select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before, length(text) - lag(length(text)) over (partition by conv_id order by turn) as growth from conversations")
def conv_turn_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = P.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), (F.length("text") - F.lag(F.length("text")).over(w)).cast("long").alias("growth"))


@_query("conv_role_counts", "select role, count(*) as n, count(distinct conv_id) as conversations, cast(max(turn) as bigint) as last_turn from conversations group by role")
def conv_role_counts(spark, sf):
    return P.table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"))


@_query("events_tumbling", "select time_bucket(interval '1 hour', ts) as at, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def events_tumbling(spark, sf):
    e = P.table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.col("w.start").alias("at"), "event_type", "n", "total")


@_query("events_sliding", """select "at", count(*) as n from (select time_bucket(interval '30 minutes', ts) - k * interval '30 minutes' as "at" from events, (select unnest([0, 1]) as k)) group by "at\"""")
def events_sliding(spark, sf):
    e = P.table(spark, sf, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("at"), "n")


@_query("events_sessions", """
select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from (
    select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (
        select *, case when coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '30 minutes', true) then 1 else 0 end as fresh from events))
group by user_id, s""")
def events_sessions(spark, sf):
    e = P.table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return e.select("user_id", "first_ts", "last_ts", "n")


@_query("customer_fields_unpivoted", "select field, count(*) as n, count(distinct text) as n_distinct from (select unnest(['c_name', 'c_mktsegment']) as field, unnest([c_name, c_mktsegment]) as text from customer) group by field")
def customer_fields_unpivoted(spark, sf):
    leaves = fields.unpivoted(P.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return leaves.groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct"))


@_query("approx_values", None)
def approx_values(spark, sf):
    return _found(spark, sf).groupBy("entity").agg(F.approx_count_distinct("value").alias("about"))


_STOPS = ", ".join(f"{{'n': len(list_filter(w, lambda x: x in ({', '.join(repr(x) for x in words.split())}))), 'rank': {-i}, 'name': '{name}'}}" for i, (name, words) in enumerate(readers.STOP.items()))


@_query("doc_language", f"""
with w as (select doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') as w from documents),
b as (select doc_id, list_max([{_STOPS}]) as b from w)
select doc_id, case when b.n >= 3 then b.name end as language from b""")
def doc_language(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", readers.language(F.col("text")).alias("language"))


@_query("pages_path_segments", """
select page_id, cast(i as integer) as pos, case when i > 1 then lower(s[i - 1]) else '' end as name, s[i] as value from (
    select page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') as s from pages), unnest(range(1, len(s) + 1)) t(i)""")
def pages_path_segments(spark, sf):
    parts = F.filter(readers.components(F.col("url")), lambda c: c["part"] == "path")
    rows = P.table(spark, sf, "pages").select("page_id", F.posexplode(parts).alias("i", "c"))
    return rows.select("page_id", (F.col("i") + 1).alias("pos"), "c.name", "c.value")


@_query("document_windows", """
select doc_id, cast(len(w) as integer) as n_tokens, cast(greatest(1, ceil((len(w) - 128) / 96.0) + 1) as integer) as n_windows from (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from documents)""")
def document_windows(spark, sf):
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    return P.table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(readers.windows(tokens)).alias("n_windows"))


@_query("pages_personal_links", None)
def pages_personal_links(spark, sf):
    parts = F.transform(readers.components(F.col("url")), lambda c: F.struct(c["part"].alias("part"), c["name"].alias("name"), readers.personal(c).alias("entity")))
    return P.table(spark, sf, "pages").select(F.explode(F.filter(parts, lambda c: c["entity"].isNotNull())).alias("c")).groupBy("c.part", "c.name", "c.entity").count()
