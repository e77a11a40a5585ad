"""Rules over planted rows: key slots, names without cues, ids that tell on a person, links, choices; SQL twins state what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import checks, identifiers, keys, links
from veilspark.operators import associate, names, records, review
from .cases import _NATIONAL, SEED, _case, _of


def _two(name: str, columns: str, rows: list[tuple], f) -> None:
    """A query that gives a column function of all planted columns but the last."""
    given = columns.split()[:-1]
    _case(name, columns, rows)(lambda spark: spark.createDataFrame([r[:-1] for r in rows], ", ".join(f"{c} string" for c in given)).select(*given, f(*map(F.col, given)).alias(columns.split()[-1])))


# ---- keys

_two("keys_resolved", "key parent result", [("value", "email", "EMAIL_ADDRESS"), ("first", "customer_name", "FIRST_NAME"), ("year", "dob", "DATE_OF_BIRTH"), ("0", "phones", None), ("0", "phone", "PHONE_NUMBER"), ("plan", "email", None), ("city", "address", "LOCATION")], keys.resolved)
_of("keys_header", [("Contact Phones 0 Number", "PHONE_NUMBER"), ("https://schema.org/email", "EMAIL_ADDRESS"), ("First Name (required)", "FIRST_NAME"), ("Plan", None), ("", None)], keys.header)
_two("keys_numeric", "key parent number result", [("zip", "", "78701", "POSTAL_CODE"), ("total", "", "4111111111111111", "CREDIT_CARD"), ("total", "", "12", None), ("created_at", "", "4111111111111111", None), ("lat", "", "48.85", "LATITUDE"), ("phone", "", "4585552333", "PHONE_NUMBER")], keys.numeric)

# ---- names

_CAPS = [(0, "Ask Julie BEET or Ms CORDER-VALE"), (1, "JANE ROE"), (2, "Open API and HTTP ERROR"), (3, None), (4, "")]


@_case("names_capitals", "row value", [(0, "Julie BEET"), (0, "CORDER-VALE"), (1, "JANE ROE")])
def names_capitals(spark):
    return names.capitals(spark.createDataFrame(_CAPS, "row int, text string")).select("row", F.explode("names.value").alias("value"))


_of("names_trimmed", [("Manager Ana Costa said", "Ana Costa"), ("Dear Ana", "Ana"), ("March", None), ("Rui Costa,", "Rui Costa"), ("Flight 12", None), ("Hello", None)], names.trimmed)
_two("names_no_ones", "value before result", [("svc_deploy", "", True), ("Degraded", "status: ", True), ("12 MB", "", True), ("Ana Costa", "from ", False)], names.no_ones)


@_case("names_joined", "leaf_id first last", [(1, 0, 17), (1, 30, 40), (2, 0, 12)])
def names_joined(spark):
    parts = [(1, 0, 7, None), (1, 11, 17, " R. "), (1, 30, 40, " met "), (2, 0, 3, None), (2, 8, 12, " van ")]
    return names.joined(spark.createDataFrame(parts, "leaf_id int, start int, end int, between string")).select("leaf_id", F.col("start").alias("first"), F.col("end").alias("last"))


@_case("names_given_alone", "scope name verdict", [("s", "Ana Costa", "keep"), ("s", "Ana", "keep"), ("s", "Rui", "doubt"), ("s", "Eva", "keep"), ("t", "Ana", "doubt"), ("s", "Bo Lee", "keep"), ("s", "Bo Day", "keep"), ("s", "Bo", "doubt")])
def names_given_alone(spark):
    rows = [("s", "Ana Costa", False), ("s", "Ana", False), ("s", "Rui", None), ("s", "Eva", True), ("t", "Ana", False), ("s", "Bo Lee", False), ("s", "Bo Day", False), ("s", "Bo", False)]
    return names.given_alone(spark.createDataFrame(rows, "scope string, name string, evidence boolean"))


@_case("names_gated", "row doubt", [(1, None), (2, "no_evidence"), (3, None), (4, None), (5, "no_evidence")])
def names_gated(spark):
    rows = [(1, "en", "PERSON", "saw ", ""), (2, "de", "PERSON", "sah ", ""), (3, "de", "PERSON", "Herr ", ""), (4, "es", "PERSON", "", " <a@b.co"), (5, None, "PERSON", None, None)]
    return names.gated(spark.createDataFrame(rows, "row int, lang string, entity string, before string, after string"))


# ---- records


@_case("record_ids", "row value", [(0, "C-88123"), (0, "cus_9f31ab"), (1, "m20991")])
def record_ids(spark):
    rows = [(0, "customer_id: C-88123, see cus_9f31ab and order_id: 99123"), (1, "Member number m20991"), (2, None), (3, "")]
    return records.record_ids(spark.createDataFrame(rows, "row int, text string")).select("row", F.explode("ids.value").alias("value"))


@_case("record_spelled_ids", "leaf_id value", [(1, "acct-apereira-01"), (1, "ana.pereira"), (2, "x-5552333")])
def record_spelled_ids(spark):
    rows = spark.createDataFrame([("s", 1, "acct-apereira-01 and ana.pereira, not build-12"), ("s", 2, "ref x-5552333"), ("t", 3, "ana.pereira")], "scope string, leaf_id int, text string")
    known = spark.createDataFrame([("s", "PERSON", "Ana Pereira"), ("s", "PHONE_NUMBER", "+1 (458) 555-2333"), ("s", "EMAIL_ADDRESS", "bo@x.org")], "scope string, entity string, value string")
    return records.spelled_ids(rows, known).select("leaf_id", "value")


_of("record_identifier_shaped", [("458 555 2333", True), ("AB-12345", True), ("2024-01-02T10:11", False), ("plain", False), ("123", False)], records.identifier_shaped)
_LEAVES = [(1, "r1", "ref", "ref", "AB-12345", None), (2, "r1", "name", "name", "Ana Costa", "PERSON"), (3, "r2", "ref", "ref", "AB-99999", None), (4, "r1", "created_at", "created_at", "123456789012", None), (5, "r1", "note", "note", "fine", None)]


@_case("record_person_identifiers", "leaf_id field text", [(1, "ref", "AB-12345")])
def record_person_identifiers(spark):
    leaves = spark.createDataFrame(_LEAVES, "leaf_id int, record_id string, field string, key string, text string, entity string")
    return records.person_identifiers(leaves, leaves.where("entity = 'PERSON'"))


@_case("record_written_out", "leaf_id record_id qualifier", [(4, "r1", "")])
def record_written_out(spark):
    rows = [(1, "r1", "street", "12 Main St"), (2, "r1", "city", "Austin"), (3, "r1", "zip", "78701"), (4, "r1", "label", "12 MAIN ST, Austin TX 78701"), (5, "r2", "label", "12 Main St, Austin 78701"), (6, "r1", "label", "Austin 78701")]
    leaves = spark.createDataFrame(rows, "leaf_id int, record_id string, key string, text string")
    return records.written_out(leaves, associate.addresses(leaves))


@_case("record_merchants", "leaf_id", [(2,)])
def record_merchants(spark):
    rows = [(1, "r1", "amount", "12"), (2, "r1", "merchant", "Ana's Diner"), (3, "r2", "payee", "Ana Costa"), (4, "r1", "name", "Ana Costa")]
    return records.merchant_lines(spark.createDataFrame(rows, "leaf_id int, record_id string, key string, text string"))


@_case("record_places_alone", "doc_id", [(1,)])
def record_places_alone(spark):
    return records.places_alone(spark.createDataFrame([(1, "LOCATION"), (1, "POSTAL_CODE"), (2, "LOCATION"), (2, "PERSON")], "doc_id int, entity string"))


@_case("spans_outside_keys", "start", [(10,)])
def spans_outside_keys(spark):
    rows = spark.createDataFrame([('{"Marie": "Rosa"}', [(2, 7), (11, 15)])], "text string, spans array<struct<start: int, end: int>>")
    return rows.select(F.explode(records.outside_keys(F.col("spans"), F.col("text"))).alias("s")).select((F.col("s.start") - 1).alias("start"))


@_case("spans_not_read_off", "leaf_id start", [(1, 20), (2, 0)])
def spans_not_read_off(spark):
    found = spark.createDataFrame([(1, 0, 5), (1, 20, 25), (2, 0, 5)], "leaf_id int, start int, end int")
    return records.not_read_off(found, spark.createDataFrame([(1, 4, 9)], "leaf_id int, start int, end int")).select("leaf_id", "start")


# ---- links, choices, stand-ins

_of("links_decoded", [("a%40b.co", "a@b.co"), ("Ana+Costa", "Ana Costa"), ("S%C3%A3o", "São"), ("50%", "50%"), ("%ZZ", "%ZZ")], links.decoded)
_two("links_source_span", "raw result", [("a%40b.co", "1:4"), ("ab@x", "1:2")], lambda raw: F.concat_ws(":", links.source_span(raw, F.lit(1), F.lit(2))["start"].cast("string"), links.source_span(raw, F.lit(1), F.lit(2))["end"].cast("string")))
_two("links_encoded", "value raw result", [("e@x.org", "a%40b.co", "e%40x.org"), ("e@x.org", "a@b.co", "e@x.org"), ("Eva Lee", "Ana+Costa", "Eva+Lee"), ("Eva Lee", "Ana%20Costa", "Eva%20Lee")], links.encoded_like)


@_case("choices_left", "n_left", [(3,)])
def choices_left(spark):
    found = spark.createDataFrame([("PERSON", "Ana", 3), ("PERSON", "Bo", 2)], "entity string, original string, n long")
    return review.left_as_written(found, spark.createDataFrame([("PERSON", "Ana", "keep"), ("PERSON", "Bo", "replace")], "entity string, original string, action string"))


@_case("choices_proposals", "original other", [("Ana Costa", True), ("a@b.co", True)])
def choices_proposals(spark):
    rows = spark.createDataFrame([("s", "PERSON", "Ana Costa"), ("s", "EMAIL_ADDRESS", "a@b.co")], "scope string, entity string, original string")
    return review.proposals(rows, SEED).select("original", (F.col("proposal") != F.col("original")).alias("other"))


@_case("choices_person_links", "original person", [("Ana", "ana costa")])
def choices_person_links(spark):
    rows = [("s", "Ana", "Eva", "ana costa"), ("s", "Ana", "Eva", "ana costa"), ("s", "Costa", "Lee", "ana costa"), ("s", "Costa", "Lee", "rui costa"), ("s", "x", "y", None)]
    return review.person_links(spark.createDataFrame(rows, "scope string, original string, stand_in string, person string")).select("original", "person")


#: Kinds whose digits alone carry the check, so that another passing number can be drawn.
_DRAWN = [(k, v) for k, v in _NATIONAL if k in ("UY_CI", "CH_AHV", "DO_CEDULA", "KENNITALA", "ACN", "PARTITA_IVA", "DK_CVR", "NO_ORGNR", "PT_NIF", "RU_INN", "HU_ANUM", "EE_KMKR", "MZ_NUIT", "ORGANISATIONSNUMMER")]


@_case("standin_identifiers", "kind value changed valid", [(k, v, True, True) for k, v in _DRAWN])
def standin_identifiers(spark):
    chosen = {k for k, _ in _DRAWN}
    registry = [k for k in identifiers.REGISTRY if k.kind in chosen]
    at = F.expr(f"map({', '.join(f'{k.kind!r}, {i}' for i, k in enumerate(registry))})")
    rows = spark.createDataFrame(_DRAWN, "kind string, value string").withColumn("at", F.element_at(at, F.col("kind")))
    rows = rows.withColumn("new", identifiers.stand_in(F.col("at"), F.col("value"), SEED, "dataset", registry))
    same = F.regexp_replace("new", "[0-9]", "0") == F.regexp_replace("value", "[0-9]", "0")
    return rows.select("kind", "value", ((F.col("new") != F.col("value")) & same & (checks.digits(F.col("new")) != "")).alias("changed"), identifiers.passes(F.col("at"), F.col("new"), registry).alias("valid"))
