import pytest
from pyspark.sql import functions as F

from veilspark.functions import checks, draw, identifiers, keys
from veilspark.functions import spans as S


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_spans_have_places(spark):
    text = F.lit("a b@c.d é x@y.z 😀 q@r.s")
    assert [tuple(m) for m in one(spark, S.matches(text, "[a-z]+@[a-z.]+"))[0]] == [(2, 7, "b@c.d"), (10, 15, "x@y.z"), (18, 23, "q@r.s")]
    assert one(spark, S.matches(F.lit(None).cast("string"), "x"))[0] == []
    assert one(spark, S.matches(F.lit("x 11-22-33"), r"\d{2}([- ])\d{2}\1\d{2}"))[0][0]["value"] == "11-22-33"


def test_resolve_prefers_sure_long_and_first(spark):
    def span(a, b, e, s):
        return F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(e).alias("entity"), F.lit(float(s)).alias("score"), F.lit("v").alias("value"))

    found = F.array(span(0, 5, "A", 0.5), span(3, 8, "B", 0.9), span(9, 12, "C", 0.4), span(9, 14, "D", 0.4), span(20, 22, "E", 0.9), span(18, 30, "F", 0.5))
    assert [(r.start, r.end, r.entity) for r in one(spark, S.resolve(found))[0]] == [(3, 8, "B"), (9, 14, "D"), (18, 30, "F")]
    assert one(spark, S.resolve(F.slice(found, 1, 0)))[0] == []


def test_edits_and_their_places(spark):
    edits = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(n).alias("new")) for a, b, n in ((0, 2, "xyz"), (3, 4, ""))))
    row = one(spark, S.apply_edits(F.lit("ab c d"), edits), S.shifted(edits), S.apply_edits(F.lit("same"), F.slice(edits, 1, 0)))
    assert row[0] == "xyz  d" and [tuple(p) for p in row[1]] == [(0, 3), (4, 4)] and row[2] == "same"


GOOD = {
    "CPF": "529.982.247-25", "CNPJ": "11.222.333/0001-81", "CUIL": "20-12345678-6", "RUT": "12.345.678-5", "DNI": "12345678Z", "NIE": "X1234567L", "NIR": "1 85 05 78 006 084 91", "BELGIAN_NATIONAL_NUMBER": "85.07.30-033.28",
    "BSN": "111222333", "STEUER_ID": "86095742719", "PESEL": "44051401359", "PERSONNUMMER": "811218-9876", "FODSELSNUMMER": "01010750160", "HETU": "131052-308T", "NHS_NUMBER": "943 476 5919", "SIN": "146 454 286",
    "AADHAAR": "2345 6789 0124", "RESIDENT_ID": "11010519491231002X", "TCKN": "10000000146", "NRIC": "S1234567D", "TAIWAN_ID": "A123456789", "DOWOD": "ABA300000", "DEA": "AB1234563", "NPI": "1234567893", "TFN": "123 456 782",
    "AU_MEDICARE": "2123 45670 1", "ABN": "51 824 753 556", "VIN": "1M8GDM9AXKP042788", "LEI": "5493001KJTIIGC8Y1R12", "IMEI": "49-015420-323751-8", "EAN": "4006381333931", "ROUTING": "021000021", "SOUTH_AFRICAN_ID": "8001015009087",
    "THAI_ID": "1-1017-00230-70-8", "NIP": "123-456-32-18", "REGON": "123456785", "SIREN": "732 829 320", "EGN": "7523169263", "ESTONIAN_ID": "37605030299", "OIB": "69435151530", "JMBG": "0101006500006",
}


def test_identifiers_pass_and_changed_ones_fail(spark):
    kinds = {k.kind: k for k in identifiers.REGISTRY}
    row = one(spark, *(identifiers.valid(kinds[n], F.lit(v)) for n, v in GOOD.items() if n != "SIN"))
    assert all(row), [n for n, ok in zip((n for n in GOOD if n != "SIN"), row) if not ok]

    def changed(v):
        at = next(i for i in range(len(v) - 1, -1, -1) if v[i].isdigit())
        return v[:at] + str((int(v[at]) + 1) % 10) + v[at + 1 :]

    names = [n for n in GOOD if n not in ("HETU", "RESIDENT_ID", "AU_MEDICARE")]  # their last digit is no check digit
    row = one(spark, *(identifiers.valid(kinds[n], F.lit(changed(GOOD[n]))) for n in names))
    assert not any(row), [n for n, ok in zip(names, row) if ok]
    assert all(one(spark, *(F.lit(v).rlike(kinds[n].form) for n, v in GOOD.items())))


def test_checks(spark):
    row = one(spark, checks.iban(F.lit("GB82 WEST 1234 5698 7654 32")), checks.iban(F.lit("GB83 WEST 1234 5698 7654 32")), checks.card(F.lit("4111-1111-1111-1111")), checks.card(F.lit("1704067200007")), checks.ssn(F.lit("078-05-1120")), checks.ssn(F.lit("536-90-4399")), checks.private_ip(F.lit("172.20.1.1")), checks.shared_ip(F.lit("8.8.8.8")), checks.ipv4(F.lit("1.2.3.256")), checks.icao(F.lit("L898902C3")))
    assert list(row) == [True, False, True, False, False, True, True, True, False, 6]


ORIGINALS = [
    ("EMAIL_ADDRESS", "Jo@x.org"), ("EMAIL_ADDRESS", "billing@x.org"), ("PHONE_NUMBER", "+1 (458) 555-2333"), ("PHONE_NUMBER", "+44 20 7946 0958"), ("CREDIT_CARD", "4111-1111-1111-1111"), ("IP_ADDRESS", "1.2.3.4"), ("IP_ADDRESS", "2001:4860::1"),
    ("US_SSN", "536-90-4399"), ("US_ITIN", "912-70-1234"), ("SECRET", "sk_live_abcdefghij1234"), ("SECRET", "0123"), ("PERSON", "ANA PEREIRA"), ("PERSON", "Pereira"), ("DATE_OF_BIRTH", "1990-02-03"), ("DATE_OF_BIRTH", "02/03/1990"),
    ("IBAN_CODE", "GB82 WEST 1234 5698 7654 32"), ("RECORD_ID", "cus_ab12CD"), ("ADDRESS", "12 Foo Avenue"), ("EMPLOYER", "Acme Ltd"), ("ID_NUMBER", "AB-12"), ("LOCATION", "Paris"),
]


def test_stand_ins_keep_their_form(spark):
    values = spark.createDataFrame([("s", e, o) for e, o in ORIGINALS], "scope string, entity string, original string")
    made = {(r.entity, r.original): r.stand_in for r in draw.stand_ins(values.union(values), "seed").collect()}
    assert len(made) == len(ORIGINALS) and all(new and new != old for (_, old), new in made.items())
    assert made["EMAIL_ADDRESS", "billing@x.org"].startswith("billing@example.")
    assert made["PHONE_NUMBER", "+1 (458) 555-2333"][:4] == "+1 (" and ") 555-01" in made["PHONE_NUMBER", "+1 (458) 555-2333"]
    assert made["PHONE_NUMBER", "+44 20 7946 0958"].startswith("+44 ")
    assert made["IP_ADDRESS", "1.2.3.4"].startswith("203.0.113.") and made["IP_ADDRESS", "2001:4860::1"].startswith("2001:db8::")
    assert made["SECRET", "sk_live_abcdefghij1234"].startswith("sk_live_") and len(made["SECRET", "0123"]) == 4
    assert made["PERSON", "ANA PEREIRA"].isupper() and " " in made["PERSON", "ANA PEREIRA"] and " " not in made["PERSON", "Pereira"]
    assert made["RECORD_ID", "cus_ab12CD"].startswith("cus_") and made["ADDRESS", "12 Foo Avenue"].endswith("Avenue") and made["EMPLOYER", "Acme Ltd"].endswith("Ltd")
    row = one(spark, checks.iban(F.lit(made["IBAN_CODE", ORIGINALS[15][1]])), checks.card(F.lit(made["CREDIT_CARD", ORIGINALS[4][1]])), checks.ssn(F.lit(made["US_SSN", ORIGINALS[7][1]])), checks.itin(F.lit(made["US_ITIN", ORIGINALS[8][1]])))
    assert all(row)
    again = {(r.entity, r.original): r.stand_in for r in draw.stand_ins(values.repartition(3), "seed").collect()}
    other = {(r.entity, r.original): r.stand_in for r in draw.stand_ins(values, "other").collect()}
    assert again == made and other != made


def test_masked_tail_follows_its_number(spark):
    assert one(spark, draw.masked_tail(F.lit("***-**-7784"), F.lit("123-45-6019")))[0] == "***-**-6019"


@pytest.mark.parametrize(
    ("key", "entity"),
    [("firstName", "FIRST_NAME"), ("customer_email", "EMAIL_ADDRESS"), ("num_family_names", None), ("billing.address.city", "LOCATION"), ("created_at", None), ("homePhone", "PHONE_NUMBER"), ("email_count", None), ("date-of-birth", "DATE_OF_BIRTH"), ("Straße", "ADDRESS"), ("", None)],
)
def test_key_hints(spark, key, entity):
    assert one(spark, keys.hint(F.lit(key)))[0] == entity


def test_values_fit_their_keys(spark):
    cases = [("FIRST_NAME", "match", False), ("FIRST_NAME", "Ana", True), ("LAST_NAME", "0.86", False), ("SECRET", "{{token}}", False), ("SECRET", "hunter2", True), ("EMAIL_ADDRESS", "none", False), ("AGE", "41", True), ("DATE_OF_BIRTH", "NO_MATCH", False)]
    assert list(one(spark, *(keys.fits(F.lit(e), F.lit(v)) for e, v, _ in cases))) == [want for *_, want in cases]


def test_batches_are_searched_in_portions():
    import pyarrow as pa

    from veilspark.functions import scan

    column = pa.array([None, "", "x" * (scan.BYTES + 1), *["é" * 1000] * 3000, None])
    parts = list(scan.portions(column))
    assert [p.start for p in parts] == [0, *[p.stop for p in parts[:-1]]] and parts[-1].stop == len(column)
    for p in parts:
        size = sum(len((x or "").encode()) for x in column[p].to_pylist())
        assert p.stop - p.start <= scan.ROWS and (size <= scan.BYTES or p.stop - p.start == 1)
    assert list(scan.portions(pa.array([], pa.string()))) == []
