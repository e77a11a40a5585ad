"""Identifiers that tell on a person: ids spelled from names, emails and phones, unread values beside a person, addresses written out, and places alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, keys, scan
from ..functions import spans as S
from . import people

# Words before ``id`` whose ids are a person's or an account's, and prefixes of such ids.
HOLDERS = ["customer", "client", "user", "member", "patient", "employee", "account", "subscriber", "student", "applicant", "person", "contact", "owner", "driver", "guest"]
PREFIXES = ["cus", "acct", "usr", "user", "mem", "pat", "emp", "sub", "per", "contact"]
#: (pattern, what each text with a match has, whether words before matter)
IDS = [
    (rf"(?i)(?<=\b(?:{'|'.join(HOLDERS)})[ _-]?(?:id|no|number|ref)\"?\s{{0,2}}[:=#]?\s{{0,2}}\"?)(?=[\w-]*[0-9])[A-Za-z0-9][\w-]{{3,63}}", r"(?i)(?:id|no|number|ref)\"?\s{0,2}[:=#]?\s{0,2}\"?[\w-]*[0-9]", False),
    (rf"(?<![\w-])(?:{'|'.join(PREFIXES)})_(?=\w*[0-9])[A-Za-z0-9]{{4,64}}(?![\w-])", "_", False),
]
_TOKEN = [(r"(?<![\w@.])[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)+(?![\w@])", r"[._-]", False)]


def record_ids(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``ids`` (start, end, value): ids named as a person's or an account's, and ids with such a prefix. A null text has none."""
    found = rows.withColumn("found__", scan.matches(F.col(text), IDS))
    return found.select(*rows.columns, F.array_sort(F.array_distinct(F.transform("found__", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))))).alias("ids"))


def spelled_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(scope, leaf_id, start, end, value) of joined words of rows (scope, leaf_id, text) that spell someone known (scope, entity, value).

    A name's last part (four letters or more) with another part, an email's local part, or a phone's last seven digits. An equi-join of exploded pieces: each
    candidate gives as many rows as it has pieces, each known value at most three.
    """
    p = people.parts(F.col("value"))
    digits = checks.digits(F.col("value"))
    local = F.regexp_replace(F.lower(F.substring_index("value", "@", 1)), "[^a-z0-9]", "")
    none = F.expr("cast(array() as array<string>)")
    names = F.when((F.size(p) > 1) & (F.length(F.element_at(p, -1)) >= 4), F.array(F.concat(F.element_at(p, 1), F.element_at(p, -1)), F.concat(F.element_at(p, -1), F.element_at(p, 1)), F.concat(F.substring(F.element_at(p, 1), 1, 1), F.element_at(p, -1))))
    made = F.when(F.col("entity") == "PERSON", names).when((F.col("entity") == "EMAIL_ADDRESS") & (F.length(local) >= 5), F.array(local)).when((F.col("entity") == "PHONE_NUMBER") & (F.length(digits) >= 7), F.array(F.substring(digits, -7, 7)))
    forms = known.select("scope", F.explode(F.coalesce(made, none)).alias("form")).distinct()
    found = rows.select("scope", "leaf_id", F.explode(scan.matches(F.col("text"), _TOKEN)).alias("m")).select("scope", "leaf_id", "m.start", "m.end", "m.value")
    words = F.filter(F.split(F.lower(F.col("value")), "[._-]"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), ""))
    pieces = F.array_distinct(F.concat(words, pairs, F.array(F.array_join(words, ""))))
    return found.withColumn("form", F.explode(pieces)).join(forms, ["scope", "form"], "left_semi").select("scope", "leaf_id", "start", "end", "value").distinct()


def identifier_shaped(value: Column) -> Column:
    """Nine digits or more, or a code of letters and digits, that nothing has read: what may still tell who someone is."""
    digits = checks.digits(value)
    code = value.rlike(r"^(?=[A-Za-z-]*[0-9])(?=[0-9-]*[A-Za-z])[A-Za-z0-9-]{6,32}$") & (F.length(digits) >= 3) & ~value.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}")
    return ((F.length(digits) >= 9) & value.rlike(r"^[0-9 ./+()-]+$") & ~value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")) | code


def person_identifiers(leaves: DataFrame, persons: DataFrame) -> DataFrame:
    """(leaf_id, field, text) of unread leaves (leaf_id, record_id, field, key, text, entity) shaped like identifiers in the record of a person (record_id).

    A field counts where at least half of its values in such records have that shape; structural keys never do.
    """
    held = leaves.join(persons.select("record_id").distinct(), "record_id", "left_semi").where(F.col("entity").isNull() & (F.length("text") > 0) & ~F.coalesce(keys.structural(F.col("key")), F.lit(False)))
    shaped = held.withColumn("shaped", F.coalesce(identifier_shaped(F.col("text")), F.lit(False)))
    fields = shaped.groupBy("field").agg(F.avg(F.col("shaped").cast("int")).alias("share")).where("share >= 0.5").select("field")
    return shaped.where("shaped").join(fields, "field", "left_semi").select("leaf_id", "field", "text")


def written_out(leaves: DataFrame, addresses: DataFrame) -> DataFrame:
    """(leaf_id, record_id, qualifier) of leaves (leaf_id, record_id, text) that hold their record's street and town in one line.

    ``addresses`` is what ``associate.addresses`` gives; an equi-join on the record, so a leaf meets only its own record's few addresses.
    """
    met = leaves.join(addresses.where("street is not null and city is not null"), "record_id")
    inside = lambda c: F.instr(keys.plain(F.col("text")), keys.plain(F.col(c))) > 0
    longer = F.length("text") > F.length("street")
    code = F.col("postcode").isNull() | inside("postcode")
    return met.where(inside("street") & inside("city") & code & longer).select("leaf_id", "record_id", "qualifier")


def merchant_lines(leaves: DataFrame) -> DataFrame:
    """leaf_id of names (leaf_id, record_id, key, text) that are a shop's: in a record with an amount and a merchant's, or a description's, key."""
    word = keys.compact(F.col("key"))
    flags = leaves.groupBy("record_id").agg(F.bool_or(word.isin("amount", "total", "price", "debit", "credit")).alias("paid"))
    shop = leaves.where(word.rlike("^(merchant|merchantname|payee|store|storename|vendor|description|memo)$"))
    return shop.join(flags.where("paid"), "record_id", "left_semi").select("leaf_id")


def places_alone(spans: DataFrame) -> DataFrame:
    """doc_id of documents all of whose spans (doc_id, entity) are places: those keep them, as no one is told of."""
    place = F.col("entity").isin("LOCATION", "REGION", "POSTAL_CODE", "COORDINATES", "LATITUDE", "LONGITUDE", "TIME_ZONE")
    return spans.groupBy("doc_id").agg(F.bool_and(place).alias("alone")).where("alone").select("doc_id")


def outside_keys(found: Column, text: Column) -> Column:
    """Spans that are no key of a pasted object: what a colon follows inside quotes, or an equals sign at a line's start."""

    def key(s: Column) -> Column:
        after = F.substring(text, s["end"] + 1, F.lit(4))
        before = F.substring(text, F.greatest(s["start"], F.lit(1)), F.when(s["start"] > 0, 1).otherwise(0))
        return (before.isin('"', "'") & after.rlike("^[\"']\\s?:")) | ((before == "") | (before == "\n")) & after.rlike("^=")

    return F.filter(found, lambda s: ~key(s))


def not_read_off(found: DataFrame, marks: DataFrame) -> DataFrame:
    """``found`` (leaf_id, start, end, ...) without what overlaps a stand-in already written (leaf_id, start, end)."""
    taken = marks.groupBy("leaf_id").agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    clear = ~F.exists("taken", lambda t: S.overlap(t, F.struct(F.col("start"), F.col("end"))))
    return found.join(taken, "leaf_id", "left").where(F.col("taken").isNull() | clear).select(*found.columns)
