"""Files of any format, pseudonymised whole: leaves, what their keys and texts say, whose they are, stand-ins of one persona for each person, and the
files written anew with only those values changed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks, draw, keys
from ..functions import spans as S
from ..sources import csvsource, jsonsource, leaves, xmlsource
from ..sources.scratch import Scratch, large
from . import associate, detect, distinct, fields, people

NAMES = ("PERSON", "FIRST_NAME", "LAST_NAME")
#: Kinds whose stand-ins follow their person.
FOLLOW = (*NAMES, "EMAIL_ADDRESS", "USERNAME", "INITIALS")


def read(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str | None = None, bank: Sequence[detect.Pattern] = detect.BANK, scratch: Scratch | None = None) -> DataFrame:
    """Leaves with ``spans`` and ``field`` (the path without its numbers): by their keys, by their texts, then by what most of their field's values are.

    Documents that cannot be read have one leaf with ``problem``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    found = labelled(leaves.leaves(docs, doc_id, text, kind, nested=False))
    found = scratch.save(found.withColumn("field", F.concat_ws(":", "kind", F.regexp_replace("path", r"\[\d+\]", "[]"))), "read")
    seen = detect.detect_leaves(found.withColumn("key", F.when(F.col("kind") != "key", F.col("key"))), bank)
    whole = F.get(F.filter("spans", lambda s: (s["start"] == 0) & (s["end"] == F.length("text"))), F.lit(0))
    told = scratch.save(seen.withColumn("entity", whole["entity"]).withColumn("score", whole["score"]), "told")
    decided = fields.majority(told.where("kind in ('value', 'number', 'text', 'attribute')").select("field", "text", "entity")).withColumnRenamed("entity", "carried")
    told = told.join(decided, "field", "left")
    give = (F.size("spans") == 0) & F.col("carried").isNotNull() & F.coalesce(keys.fits(F.col("carried"), F.col("text")), F.lit(False))
    carried = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("carried").alias("entity"), F.lit(0.8).alias("score"), F.col("text").alias("value")))
    spans = F.when(F.coalesce(give, F.lit(False)), carried).otherwise(F.col("spans"))
    keep = F.col("kind").isin("key", "problem")
    return told.select(*found.columns, F.when(keep, F.filter("spans", lambda s: F.lit(False))).otherwise(spans).alias("spans"))


# Keys of a pair of fields of which one names the other.
LABELS = ("name", "key", "field", "label", "fieldname", "id", "attribute", "property")
VALUES = ("value", "val", "content", "answer", "fieldvalue")


def labelled(found: DataFrame) -> DataFrame:
    """Leaves whose key only says that they are a value take the name that the one label beside them gives: ``<name>ssn</name><value>…</value>``, ``{"key": "email", "value": …}``.

    A label is a field's name as such, or written like one; it is no value itself. A record with two labels names nothing. Records are numbered inside a document, so a window is never larger than one of them.
    """
    # what a leaf says by itself is told once, before rows are shuffled
    named = found.withColumn("name__", F.when(F.col("kind").isin("value", "number", "text", "attribute"), keys.compact(F.col("key"))))
    spoken = keys.header(F.col("text")).isNotNull() | F.col("text").rlike(r"^[a-z][a-z0-9]*([_. -]?[A-Za-z0-9]+){0,5}$")
    told = F.when(F.coalesce((F.col("kind") != "number") & F.col("name__").isin(*LABELS) & spoken, F.lit(False)), F.col("text"))
    each = named.select(*found.columns, told.alias("told__"), F.coalesce(F.col("name__").isin(*VALUES), F.lit(False)).alias("value__"))
    beside = Window.partitionBy("doc_id", F.coalesce(F.try_element_at("record_ids", F.lit(-1)), -F.col("leaf_id")))
    pair = (F.count("told__").over(beside) == 1) & (F.count_if("value__").over(beside) > 0)
    label = F.when(pair & F.col("value__"), F.max("told__").over(beside)).when(pair & F.col("told__").isNotNull(), F.lit("fieldname"))
    return each.withColumn("label__", label).withColumn("key", F.coalesce("label__", "key")).select(*found.columns)


def owned(found: DataFrame) -> DataFrame:
    """``found`` with ``person``: the folded name of whoever a leaf is about, null if no one.

    A record with names under two prefixes holds two people; elsewhere the innermost enclosing record with a name decides.
    """
    at = F.concat_ws("/", "doc_id", F.element_at("record_ids", -1).cast("string"))
    rows = found.withColumn("record_id", F.when(F.size("record_ids") > 0, at)).withColumn("hint", keys.hint(F.col("key"))).withColumn("prefix", F.coalesce(keys.person_prefix(F.col("key")), F.lit("")))
    named = rows.where(F.col("hint").isin(*NAMES) & F.col("record_id").isNotNull() & (F.col("kind") != "key"))
    one = lambda entity: F.min_by("text", F.when(F.col("hint") == entity, F.col("leaf_id")))
    names = named.groupBy("record_id", "prefix").agg(F.coalesce(one("PERSON"), F.concat_ws(" ", one("FIRST_NAME"), one("LAST_NAME"))).alias("name"))
    names = names.select("record_id", "prefix", F.array_join(people.parts(F.col("name")), " ").alias("name")).where("name <> ''")
    alone = names.groupBy("record_id").agg(F.min("name").alias("person"), F.count("*").alias("n")).where("n = 1").select("record_id", "person")
    up = rows.select("doc_id", "leaf_id", F.transform("record_ids", lambda r: F.concat_ws("/", "doc_id", r.cast("string"))).alias("record_ids"))
    enclosing = associate.owners(up.withColumn("leaf_id", F.struct("doc_id", "leaf_id")), alone).select("leaf_id.doc_id", "leaf_id.leaf_id", "owner")
    told = rows.join(large(names.withColumnRenamed("name", "own")), ["record_id", "prefix"], "left").join(large(enclosing), ["doc_id", "leaf_id"], "left")
    return told.select(*found.columns, F.coalesce("own", "owner").alias("person"))


def _numbers(entity: Column, original: Column, new: Column, seed: str, scope: Column) -> Column:
    """A stand-in that may stand where a number stood."""
    digits = checks.digits(new)
    plain = new.rlike("^-?(0|[1-9][0-9]*)([.][0-9]+)?$")
    return F.when(plain, new).when(F.length(digits) == F.length(original), F.concat(F.regexp_replace(F.substring(digits, 1, 1), "0", "1"), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(draw.numeric(original, seed, scope))


def replaced(found: DataFrame, seed: str, scope: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Changed leaves of ``found`` (as ``owned`` gives it): doc_id, leaf_id, kind, path, start, end, text, new, edits.

    One value of a person takes one stand-in within a scope (all of the input without one), whatever files it stands in.
    """
    where = F.lit("dataset") if scope is None else F.col(scope).cast("string")
    each = found.withColumn("scope", where).select("scope", "doc_id", "leaf_id", "kind", "path", F.col("start").alias("at"), F.col("end").alias("to"), "text", "person", F.explode("spans").alias("s"))
    name = F.array_join(people.parts(F.col("s.value")), " ")
    who = F.when(F.col("s.entity") == "PERSON", name).when(F.col("s.entity").isin(*FOLLOW), F.col("person"))
    each = each.withColumn("person", F.when(who != "", who)).withColumn("entity", F.col("s.entity")).withColumn("original", F.col("s.value"))
    scratch = scratch or Scratch(found.sparkSession)
    each = scratch.save(each, "values")
    values = each.select("scope", "entity", "original").distinct()
    known = distinct.personas(each.where("person is not null").select("scope", "person"), seed)
    drawn = scratch.save(distinct.stand_ins(values, seed), "drawn")
    plain = distinct.settled(distinct.met(drawn), values, seed, scratch)
    met = each.join(large(known), ["scope", "person"], "left").join(large(plain), ["scope", "entity", "original"], "left")
    new = F.coalesce(F.when(F.col("who").isNotNull(), draw.of_persona(F.col("entity"), F.col("original"), F.col("who"), seed, F.col("scope"))), F.col("stand_in"))
    new = F.when(F.col("kind") == "number", _numbers(F.col("entity"), F.col("original"), new, seed, F.col("scope"))).otherwise(new)
    edit = F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), new.alias("new"), F.col("entity").alias("entity"), F.col("original").alias("original"), F.col("s.score").alias("score"))
    made = met.withColumn("edit", edit).groupBy("doc_id", "leaf_id", "kind", "path", "at", "to", "text").agg(F.array_sort(F.collect_list("edit")).alias("edits"))
    return made.select("doc_id", "leaf_id", "kind", "path", F.col("at").alias("start"), F.col("to").alias("end"), "text", S.apply_edits(F.col("text"), F.col("edits")).alias("new"), "edits")


def _written(text: str, kind: str, changes: list[dict]) -> str:
    if kind in ("json", "jsonl"):
        return jsonsource.patched(text, [(c["start"], c["end"], "number" if c["kind"] == "number" else "value", c["new"]) for c in changes])
    if kind == "xml":
        return xmlsource.patched(text, [(c["leaf_id"], e["start"], e["end"], e["new"]) for c in changes for e in c["edits"]])
    if kind == "csv":
        delimiter, quote = csvsource.sniff(text)
        rows = csvsource.parse(text, delimiter, quote)
        first = int(csvsource.header(rows, leaves.hinted))
        for c in changes:
            n, i = (int(x) for x in c["path"][1:-1].split("]["))
            rows[n + first][i] = csvsource.neutral(c["new"])
        return csvsource.written(rows, delimiter, quote, "\r\n" if "\r\n" in text else "\n")
    out, at = [], 0
    for c in sorted(changes, key=lambda c: c["start"]):  # prose, and documents written inside it
        new = jsonsource.spelled(c["kind"], c["new"]) if c["kind"] in ("value", "number") else c["new"]
        out += [text[at : c["start"]], new]
        at = c["end"]
    return "".join([*out, text[at:]])


def pseudonymise_documents(docs: DataFrame, seed: str, doc_id: str = "doc_id", text: str = "text", kind: str | None = None, bank: Sequence[detect.Pattern] = detect.BANK) -> DataFrame:
    """One row per row of ``docs``: doc_id (as a string), output, n_values, problem.

    ``kind`` names a column of formats (json, jsonl, csv, xml, text); without it they are sniffed. A document that cannot be read has a problem and no output:
    it is never passed on as it was. ``doc_id`` must tell the rows apart. A null text is an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(read(docs, doc_id, text, kind, bank, scratch), "leaves")
    changed = scratch.save(replaced(owned(found), seed, scratch=scratch), "changed")
    return rewritten(docs, changed, found.where("kind = 'problem'").select("doc_id", "problem"), doc_id, text, kind)


def rewritten(docs: DataFrame, changed: DataFrame, problems: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str | None = None) -> DataFrame:
    """Documents in their own formats with the leaves of ``changed`` (as ``replaced`` gives them) written anew: doc_id, output, n_values, problem.

    All but the edited characters is as it was. A change whose place cannot be found makes a problem of its document, which then has no output.
    """
    changes = changed.groupBy("doc_id").agg(F.collect_list(F.struct("leaf_id", "start", "end", "kind", "path", "text", "new", "edits")).alias("changes"), F.sum(F.size("edits")).alias("n_values"))
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("format"))
    joined = rows.join(large(changes), "doc_id", "left").join(large(problems), "doc_id", "left")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources import formats

        for batch in batches:
            out, why = [], []
            for body, form, changes, problem in zip(*(batch.column(c).to_pylist() for c in ("text", "format", "changes", "problem"))):
                made = None
                if problem is None:
                    try:
                        made = _written(body, form or formats.sniff_text(body), changes) if changes else body
                    except (jsonsource.BadJSON, csvsource.BadCSV, xmlsource.BadXML, IndexError) as e:
                        problem = f"not_written: {e}"
                out.append(made)
                why.append(problem)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "output": pa.array(out, pa.string()), "n_values": batch.column("n_values"), "problem": pa.array(why, pa.string())})

    return joined.select("doc_id", "text", "format", "changes", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"), "problem").mapInArrow(write, "doc_id string, output string, n_values long, problem string")
