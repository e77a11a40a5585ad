"""Operators over planted rows: each query runs one operator on a few rows that stand here, and its SQL twin states what must come out."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checks, draw, identifiers, keys
from veilspark.functions import text as T
from veilspark.operators import associate, detect, distinct, fields, people, readers, review, structured, verify
from veilspark.sources import csvsource, formats, jsonsource, leaves, xmlsource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = "veil"


def _values(columns: Sequence[str], rows: Sequence[tuple]) -> str:
    def one(x) -> str:
        if x is None:
            return "cast(null as varchar)"
        return "'" + str(x).lower().replace("'", "''") + "'" if isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def _case(name: str, columns: str, want: Sequence[tuple]):
    """Registers a query (spark) -> rows, all of whose columns are compared as strings."""
    names = columns.split()

    def keep(f: Callable[[SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, sf: f(spark).select(*(F.col(c).cast("string").alias(c) for c in names))
        ORACLE_SQL[name] = _values(names, want)
        return f

    return keep


def _of(name: str, pairs: Sequence[tuple], f: Callable[[Column], Column]) -> None:
    """A query that gives a column function of each planted value."""
    _case(name, "value result", pairs)(lambda spark: spark.createDataFrame([(v,) for v, _ in pairs], "value string").select("value", f(F.col("value")).alias("result")))


def _spans_of(name: str, texts: Sequence[str], want: Sequence[tuple], f: Callable[[Column], Column]) -> None:
    """A query of the (row, entity, value) spans that a reader finds in planted texts; their places are checked against the texts."""

    @_case(name, "row entity value in_place", [(*w, True) for w in want])
    def query(spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(list(enumerate(texts)), "row int, text string").select("row", "text", F.explode(f(F.col("text"))).alias("s"))
        return rows.select("row", "s.entity", "s.value", (F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) == F.col("s.value")).alias("in_place"))


# ---- keys and small texts

_of("keys_words", [("billingZipCode", "billing zip code"), ("XMLHttpID", "xml http id"), ("straße-nr.2", "strasse nr 2"), ("", "")], lambda v: F.array_join(keys.words(v), " "))
_of("keys_folded", [("Señor Núñez", "senor nunez"), ("Łódź", "lodz"), ("Groß", "gross")], keys.plain)
_of("keys_hinted", [("first_name", "FIRST_NAME"), ("customerEmail", "EMAIL_ADDRESS"), ("num_phones", None), ("email_verified", None), ("billing_zip_code", "POSTAL_CODE"), ("plan", None), ("dob", "DATE_OF_BIRTH")], keys.hint)
_of("keys_structural", [("created_at", True), ("requestId", True), ("email", False)], keys.structural)
_of("keys_person_prefix", [("applicant_email", "applicant"), ("spouse_name", "spouse"), ("email", None)], keys.person_prefix)
_of("keys_date_part", [("birth_year", "year"), ("exp_month", "month"), ("fiscal_year", None)], keys.date_part)
_of("values_placeholder", [("{{token}}", True), ("${NAME}", True), ("<email>", True), ("N/A", True), ("***", True), ("Ana", False)], keys.placeholder)
_of("values_common", [("no match", True), ("Passed", True), ("Lisbon", False)], keys.common)
_of("text_visible", [("a​n­a", "ana"), ("An**n**a", "Anna"), ("plain", "plain")], T.visible)
_of("text_note_split", [("128 -- gate code", "128/gate code"), ("plain", "plain/-")], lambda v: F.concat_ws("/", T.value_and_note(v)["value"], F.coalesce(T.value_and_note(v)["note"], F.lit("-"))))
_of("text_emphasis_masked", [("**bold** x", "  bold   x"), ("a_b", "a_b")], T.emphasis_masked)
_of("text_sentence_index", [("One. Two! Three", 2), ("none", 0)], lambda v: T.sentence_index(v, F.length(v)))
_of("text_paragraph_index", [("a\n\nb\n\nc", 2), ("a\nb", 0)], lambda v: T.paragraph_index(v, F.length(v)))
_of("text_free", [("please call me back", True), ("pro", False), ("王小明", True)], T.free_text)
_of("text_secret_like", [("hunter2x!", True), ("/usr/bin1", False), ("abc1", False), ("{{secret1}}", False)], T.secret_like)
_of("text_no_ones", [("req_8812", True), ("v1.22.3", True), ("report.pdf", True), ("cus_991", False)], T.no_ones)
_of("text_company", [("Fenwick GmbH", True), ("St. Mary Hospital", True), ("Ana Costa", False)], T.company)
_of("text_role_mailbox", [("billing@x.org", True), ("ana@x.org", False)], draw.role_mailbox)


@_case("text_machine_address", "value result", [("from node ", True), ("her laptop ", False)])
def text_machine_address(spark):
    rows = spark.createDataFrame([("from node ",), ("her laptop ",)], "value string")
    return rows.select("value", T.machine_address(F.concat("value", F.lit("10.1.2.3")), F.length("value"), F.lit("10.1.2.3")).alias("result"))


# ---- checks

_of("check_iban", [("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False), ("DE89370400440532013000", True), ("ZZ89370400440532013000", False)], checks.iban)
_of("check_ssn", [("536-90-4399", True), ("000-12-3456", False), ("666-12-3456", False), ("900-12-3456", False), ("123-00-4567", False), ("123-45-6789", False)], checks.ssn)
_of("check_itin", [("912-70-1234", True), ("912-93-1234", False)], checks.itin)
_of("check_epoch", [("1700000000000", True), ("4222222222222", False)], checks.epoch_milliseconds)
_of("check_verhoeff", [("2363", True), ("2364", False)], checks.verhoeff)
_of("check_card", [("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False)], checks.card)
_of("check_shared_ip", [("127.0.0.1", True), ("8.8.8.8", True), ("24.5.6.7", False)], checks.shared_ip)
_of("check_icao", [("L898902C3", 6), ("740812", 2), ("120415", 9)], checks.icao)

# Valid numbers are those that public registers print as examples; each one's neighbour fails.
_REGISTERED = [
    ("CPF", "529.982.247-25", True), ("CPF", "529.982.247-26", False), ("CNPJ", "11.222.333/0001-81", True), ("CNPJ", "11.222.333/0001-82", False), ("DNI", "12345678Z", True), ("DNI", "12345678A", False), ("NIE", "X1234567L", True),
    ("BSN", "111222333", True), ("BSN", "111222334", False), ("PESEL", "44051401359", True), ("PESEL", "44051401358", False), ("NHS_NUMBER", "943 476 5919", True), ("NHS_NUMBER", "943 476 5918", False), ("SIN", "046 454 286", True),
    ("TCKN", "10000000146", True), ("TCKN", "10000000147", False), ("VIN", "1M8GDM9AXKP042788", True), ("VIN", "1M8GDM9A1KP042788", False), ("NPI", "1234567893", True), ("NPI", "1234567894", False), ("ABN", "51 824 753 556", True),
    ("ABN", "51 824 753 557", False), ("ROUTING", "021000021", True), ("ROUTING", "021000022", False), ("IMEI", "49-015420-323751-8", True), ("EAN", "4006381333931", True), ("EAN", "4006381333932", False), ("NRIC", "S1234567D", True),
    ("EGN", "7523169263", True), ("EGN", "7523169264", False), ("CNP", "1800101221144", True), ("OIB", "33392005961", True), ("OIB", "33392005962", False), ("NIP", "526-104-08-28", True), ("NIP", "526-104-08-29", False),
    ("REGON", "123456785", True), ("SIREN", "732 829 320", True), ("SIRET", "732 829 320 00074", True), ("LEI", "5493001KJTIIGC8Y1R12", True), ("LEI", "5493001KJTIIGC8Y1R13", False), ("HETU", "131052-308T", True), ("HETU", "131052-308U", False),
    ("ESTONIAN_ID", "37605030299", True), ("JMBG", "0101006500006", True), ("JMBG", "0101006500007", False), ("ISRAELI_ID", "123456782", True), ("STEUER_ID", "86095742719", True), ("TFN", "123 456 782", True), ("TFN", "123 456 783", False),
]


@_case("registry_examples", "kind value valid", _REGISTERED)
def registry_examples(spark):
    rows, out = spark.createDataFrame([(k, v) for k, v, _ in _REGISTERED], "kind string, value string"), F.lit(None).cast("boolean")
    for spec in identifiers.REGISTRY:
        if any(k == spec.kind for k, _, _ in _REGISTERED):
            out = F.when(F.col("kind") == spec.kind, identifiers.valid(spec, F.col("value"))).otherwise(out)
    return rows.select("kind", "value", out.alias("valid"))


# Sample numbers of public descriptions of these formats.
_NATIONAL = [
    ("UY_CI", "1.234.567-2"), ("DO_CEDULA", "001-1391820-5"), ("EC_CI", "1714307103"), ("PE_CUI", "10117410-2"), ("BC_PHN", "9698 658 215"), ("LU_MATRICULE", "1893120105732"), ("DE_DOCUMENT", "T220001293"), ("KVNR",
    "A123456780"), ("RVNR", "15 070649 C 103"), ("CH_AHV", "756.9217.0769.85"), ("AT_SVNR", "1237 010180"), ("RODNE_CISLO", "710319/2745"), ("AMKA", "01013099997"), ("PPS", "6433435F"), ("KENNITALA", "450401-3150"),
    ("LV_PERSONAS_KODS", "161175-19997"), ("FR_NIF", "30 23 217 600 053"), ("BE_EID", "591-1917064-58"), ("GB_UTR", "19558 39661"), ("GB_UPN", "B801200005001"), ("HU_ADOAZONOSITO", "8071592153"), ("UA_RNTRC",
    "1759013776"), ("HKID", "A123456(3)"), ("NZ_IRD", "49-091-850"), ("NZ_IRD", "136-410-132"), ("DE_VAT_ID", "DE136695976"), ("ORGANISATIONSNUMMER", "123456-7897"), ("GSTIN", "27AAPFU0939F1ZV"), ("PARTITA_IVA",
    "00743110157"), ("KR_BRN", "116-82-00276"), ("ZA_INCOME_TAX_NUMBER", "0001339050"), ("SG_UEN", "00192200M"), ("ACN", "004 085 616"), ("CO_NIT", "213.123.432-1"), ("VE_RIF", "V-11470283-4"), ("GT_NIT", "576937-K"),
    ("GT_NIT", "7108-0"), ("UY_RUT", "21-100342-001-7"), ("PY_RUC", "80028061-0"), ("DO_RNC", "1-01-85004-3"), ("AR_CBU", "28505909 40090418135201"), ("CA_BN", "123026635"), ("PE_RUC", "20512333797"), ("NO_KONTONUMMER",
    "8601.11.17947"), ("BG_VAT", "BG175074752"), ("CZ_ICO", "25123891"), ("EE_KMKR", "EE100931558"), ("HU_ANUM", "HU12892312"), ("LT_PVM", "LT119511515"), ("LV_PVN", "LV40003521600"), ("RO_CUI", "RO18547290"),
    ("SI_DDV", "SI50223054"), ("SK_DPH", "SK2022749619"), ("UA_EDRPOU", "32855961"), ("MD_IDNO", "1008600038413"), ("ME_PIB", "02655284"), ("RS_PIB", "101134702"), ("MK_EDB", "4030000375897"), ("EE_REGISTRIKOOD",
    "12345678"), ("RU_OGRN", "1022200525819"), ("RU_INN", "7707083893"), ("TR_VKN", "4540536920"), ("SI_MATICNA", "9331310"), ("AT_UID", "ATU13585627"), ("BE_VAT", "BE0403019261"), ("CH_UID", "CHE-100.155.212"),
    ("DK_CVR", "13585628"), ("CY_VAT", "CY10259033P"), ("ES_CIF", "J99216582"), ("FI_YTUNNUS", "2077474-0"), ("FR_TVA", "FR 40 303 265 045"), ("GB_VAT", "GB 980 7806 84"), ("GR_AFM", "EL 094259216"), ("IE_VAT",
    "IE6433435OA"), ("LU_TVA", "15027442"), ("MT_VAT", "1167-9112"), ("NL_BTW", "NL4495445B01"), ("NO_ORGNR", "988 077 917"), ("PT_NIF", "501964843"), ("SE_VAT", "SE123456789701"), ("EU_CREDITOR_ID",
    "ES23ZZZ47690558N"), ("CN_USCC", "91110000600037341L"), ("TW_UBN", "00501503"), ("ID_NPWP", "01.312.166.0-091.000"), ("VN_MST", "0100233488"), ("JP_CORPORATE_NUMBER", "5835678256246"), ("GH_TIN", "C0000803561"),
    ("MA_ICE", "001561191000066"), ("MZ_NUIT", "400339910"), ("IL_COMPANY_NUMBER", "516179157"), ("CZ_BANK_ACCOUNT", "34278-0727558021/0100"), ("ES_NIF_KLM", "K0867756N"),
]


def _beside(value: str) -> str:
    """A sample number with one digit changed: the third."""
    at = [i for i, c in enumerate(value) if c.isdigit()][2]
    return value[:at] + str((int(value[at]) + 1) % 10) + value[at + 1 :]


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, value) with whether the value passes."""
    places = F.expr(f"map({', '.join(f'{k.kind!r}, {i}' for i, k in enumerate(identifiers.REGISTRY))})")
    return rows.select("kind", "value", identifiers.passes(F.element_at(places, F.col("kind")), F.col("value")).alias("valid"))


@_case("registry_national", "kind value valid", [(k, v, True) for k, v in _NATIONAL])
def registry_national(spark):
    return _checked(spark.createDataFrame(_NATIONAL, "kind string, value string"))


@_case("registry_national_beside", "kind value valid", [(k, _beside(v), False) for k, v in _NATIONAL])
def registry_national_beside(spark):
    return _checked(spark.createDataFrame([(k, _beside(v)) for k, v in _NATIONAL], "kind string, value string"))


# ---- detection

_BANK = [
    ("Mail ann@x.org or call +1 (458) 555-2333", [("EMAIL_ADDRESS", "ann@x.org"), ("PHONE_NUMBER", "+1 (458) 555-2333")]),
    ("card 4111-1111-1111-1111, not 4111-1111-1111-1112", [("CREDIT_CARD", "4111-1111-1111-1111")]),
    ("ip 8.8.8.8 and 24.5.6.7, 2001:db9:0:1:2:3:4:5", [("IP_ADDRESS", "24.5.6.7"), ("IP_ADDRESS", "2001:db9:0:1:2:3:4:5")]),
    ("See RFC 4716, America/Chicago, https://x.org/458-555-2333", []),
    ("Mr. John Smith was born 1990-02-03; the old stone house there was built 1990-02-04", [("PERSON", "John Smith"), ("DATE_OF_BIRTH", "1990-02-03")]),
    ('token = "abcdef0123456789", password: {{pw}}', [("SECRET", "abcdef0123456789")]),
    ("ssn 536-90-4399; order 123456789; ssn 536904399", [("US_SSN", "536-90-4399"), ("US_SSN", "536904399")]),
    ("IBAN GB82 WEST 1234 5698 7654 32", [("IBAN_CODE", "GB82 WEST 1234 5698 7654 32")]),
    ("at 221 Baker Street, PO Box 12", [("ADDRESS", "221 Baker Street"), ("ADDRESS", "PO Box 12")]),
    ("/home/apereira/x and /Users/Shared/y", [("USERNAME", "apereira")]),
    ("Dear Ana, you are aged 41, card ending in 4242, cvv: 123", [("PERSON", "Ana"), ("AGE", "41"), ("LAST_DIGITS", "4242"), ("SECRET", "123")]),
    ("From: Ana Pereira <a", [("PERSON", "Ana Pereira")]),
    ("customer id C-88123 paid, see cus_9f31ab; order id 99123", [("RECORD_ID", "C-88123"), ("RECORD_ID", "cus_9f31ab")]),
    ("", []),
]


@_case("bank_examples", "row entity value", [(i, e, v) for i, (_, found) in enumerate(_BANK) for e, v in found])
def bank_examples(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_BANK)], "row int, text string")
    return detect.detect(rows).select("row", F.explode("spans").alias("s")).select("row", "s.entity", "s.value")


@_case("keyed_values", "key text entity", [("first_name", "Ana", "FIRST_NAME"), ("first_name", "match", None), ("created_at", "2165551234", None), ("note", "write to a@b.co", "EMAIL_ADDRESS")])
def keyed_values(spark):
    rows = [("first_name", "Ana"), ("first_name", "match"), ("created_at", "2165551234"), ("note", "write to a@b.co")]
    found = detect.detect_leaves(spark.createDataFrame(rows, "key string, text string"))
    return found.select("key", "text", F.get("spans", F.lit(0))["entity"].alias("entity"))


@_case("named_identifiers", "row value", [(0, "111222333")])
def named_identifiers(spark):
    rows = spark.createDataFrame([(0, "Mijn BSN is 111222333"), (1, "number 111222333 here")], "row int, text string")
    found = detect.find_identifiers(rows).select("row", F.explode("spans").alias("s")).where("s.score = 1.0")
    return found.select("row", "s.value").distinct()


# ---- readers

_spans_of("reader_labelled", ["Email: a@b.co\n- **Phone**: 555 1234 99", "| City | Porto |", "Total: 12"], [(0, "EMAIL_ADDRESS", "a@b.co"), (0, "PHONE_NUMBER", "555 1234 99"), (1, "LOCATION", "Porto")], readers.labelled)
_spans_of("reader_pairs", ['{"email": "a@b.co", plan: \'pro\'}', "DB_PASSWORD=s3cretx\nMODE=dev"], [(0, "EMAIL_ADDRESS", "a@b.co"), (1, "SECRET", "s3cretx")], readers.pairs)
_spans_of("reader_cookies", ["Cookie: theme=darkmode; session_id=abc123def; lang=en-US-x"], [(0, "SECRET", "abc123def")], readers.cookies)
_spans_of("reader_connections", ["Server=x;User Id=svc_ann;Password=p4ss!x;", "postgres://ann:s3cret@db/x"], [(0, "SECRET", "p4ss!x"), (0, "USERNAME", "svc_ann"), (1, "SECRET", "s3cret")], readers.connection_strings)
_of("reader_links", [("https://x.org/users/apereira?email=a%40b.co&page=2#token=abcdef99", "path:users:apereira|query:email:a@b.co|fragment:token:abcdef99"), ("https://x.org/about", "")], lambda v: F.array_join(F.transform(F.filter(readers.components(v), lambda c: readers.personal(c).isNotNull()), lambda c: F.concat_ws(":", c["part"], c["name"], c["value"])), "|"))
_of("reader_mrz", [("L898902C36UTO7408122F1204159ZE184226B<<<<<10", "L898902C3"), ("L898902C36UTO7408122F1204159ZE184226B<<<<<11", None)], lambda v: readers.mrz(v)["number"])
_of("reader_dates", [("3 March 1990", "1990-03-03"), ("5. März 2001", "2001-03-05"), ("le 14 juillet 1789", "1789-07-14"), ("31 February 1990", None)], readers.written_date)
_of("reader_layout", [("12 Main St, Apt 4, Austin, TX 78701, USA", "street unit place postcode country")], lambda v: F.array_join(F.transform(readers.address_layout(v), lambda p: p["role"]), " "))
_of("reader_east_asian", [("王小明", True), ("김철수", True), ("小明", False)], readers.han_or_hangul_name)


@_case("windows_first_wins", "leaf_id token label", [(1, 1, "A"), (1, 2, "B")])
def windows_first_wins(spark):
    return readers.first_window_wins(spark.createDataFrame([(1, 1, 0, "A"), (1, 1, 96, "X"), (1, 2, 96, "B")], "leaf_id int, token int, first int, label string"))


@_case("quality_metrics", "label n caught", [("A", 2, 1), ("B", 1, 1)])
def quality_metrics(spark):
    truth = spark.createDataFrame([(1, 0, 5, "A"), (1, 9, 12, "A"), (2, 0, 3, "B")], "leaf_id int, start int, end int, label string")
    return readers.quality(truth, spark.createDataFrame([(1, 0, 6), (1, 10, 12), (2, 0, 3)], "leaf_id int, start int, end int"))


# ---- association and people


@_case("record_owners", "leaf_id owner", [(1, "ann"), (2, "bob"), (3, "ann"), (4, None)])
def record_owners(spark):
    rows = spark.createDataFrame([(1, [10]), (2, [10, 11]), (3, [10, 12]), (4, [])], "leaf_id long, record_ids array<long>")
    return associate.owners(rows, spark.createDataFrame([(10, "ann"), (11, "bob")], "record_id long, person string"))


@_case("record_persons", "record_id prefix person", [(1, "applicant", "1/applicant"), (1, "spouse", "1/spouse"), (2, "", "2")])
def record_persons(spark):
    rows = [(1, "applicant_name", "A"), (1, "spouse_name", "B"), (1, "applicant_email", "a"), (2, "home_phone", "1"), (2, "name", "C")]
    return associate.flat_persons(spark.createDataFrame(rows, "record_id long, key string, text string"))


@_case("record_addresses", "record_id qualifier street city postcode", [(1, "billing", None, "Rome", "00100"), (1, "", None, "Bari", None)])
def record_addresses(spark):
    return associate.addresses(spark.createDataFrame([(1, 1, "billing_city", "Rome"), (1, 2, "billing_zip", "00100"), (1, 3, "city", "Bari")], "record_id long, leaf_id long, key string, text string"))


@_case("nearest_scopes", "ask_id value unclear_owner", [(1, "v", False), (2, None, True)])
def nearest_scopes(spark):
    asks = spark.createDataFrame([(1, ["s1", "p1", "d"]), (2, ["s2", "p2", "d"]), (3, ["x"])], "ask_id long, scopes array<string>")
    return associate.nearest(asks, spark.createDataFrame([("p1", "v"), ("d", "w"), ("d", "u")], "scope string, value string"))


_NAMES = [("Robert Mitchell", "robert mitchell"), ("Bob Mitchell", "robert mitchell"), ("R. Mitchell", "robert mitchell"), ("Mitchell", "robert mitchell"), ("Mitchell, Robert", "robert mitchell"), ("Ms Okafor", "okafor"), ("Mr Mateus Okafor", "mateus okafor"), ("Ana Pereira", "ana pereira"), ("Rui Pereira", "rui pereira"), ("Pereira", "pereira")]


@_case("people_resolved", "name person", _NAMES)
def people_resolved(spark):
    return people.resolve(spark.createDataFrame([("s", n) for n, _ in _NAMES], "scope string, name string"))


@_case("people_shared_given", "scope first", [("s", "ana")])
def people_shared_given(spark):
    return people.shared_given_names(spark.createDataFrame([("s", "Ana Pereira"), ("s", "Ana Costa"), ("s", "Rui Costa")], "scope string, name string"))


@_case("people_by_email", "name email", [("Ana Pereira", "apereira@x.org"), ("Rui Costa", "rui.costa7@x.org")])
def people_by_email(spark):
    names = spark.createDataFrame([("s", "Ana Pereira"), ("s", "Rui Costa")], "scope string, name string")
    return people.spelled_by_email(names, spark.createDataFrame([("s", "apereira@x.org"), ("s", "rui.costa7@x.org"), ("s", "q@x.org")], "scope string, email string"))


_of("people_natural_order", [("Okafor, Ama", "Ama Okafor"), ("Ama Okafor", "Ama Okafor")], people.natural_order)
_of("people_title_sex", [("Mrs. Costa", "f"), ("Herr Braun", "m"), ("Dr. Costa", None)], people.sex)


@_case("fields_carried", "text entity score", [("Ana", "PERSON", 0.9), ("Bo", "PERSON", 0.9), ("Cy", "PERSON", 0.8), ("pass", None, None)])
def fields_carried(spark):
    rows = [("p", "Ana", "PERSON", 0.9), ("p", "Bo", "PERSON", 0.9), ("p", "Cy", None, None), ("p", "pass", None, None), ("p", "Di", "PERSON", 0.9)]
    return fields.carried(spark.createDataFrame(rows, "field string, text string, entity string, score double")).where("text <> 'Di'")


@_case("fields_people", "field share", [("name", 0.5)])
def fields_people(spark):
    rows = spark.createDataFrame([("name", x) for x in ("Ana", "Bo", "Cy", "zz")] + [("plan", x) for x in ("pro", "free", "Ana")], "field string, text string")
    return fields.people_columns(rows, spark.createDataFrame([("Ana",), ("Bo",)], "text string"))


@_case("fields_identifiers", "field kind n_distinct", [("n", "CPF", 4)])
def fields_identifiers(spark):
    rows = [("n", v) for v in ("529.982.247-25", "111.444.777-35", "123.456.789-09", "987.654.321-00")] + [("m", str(v)) for v in range(5)]
    return fields.identifier_columns(spark.createDataFrame(rows, "field string, text string"))


# ---- checks of the output, review

_ORIGINALS = [("s", "PERSON", "Odalys Ferriter"), ("s", "PHONE_NUMBER", "+1 458-555-2333"), ("s", "DATE_OF_BIRTH", "1990-02-03"), ("s", "ADDRESS", "Flat 4, 128 North Old Mill Race Lane")]
_OUTPUTS = [("s", 1, "oferriter and Ferriter, call 1 (458) 555 2333, born 3 February 1990"), ("s", 2, "clean text 12345678"), ("t", 3, "Odalys Ferriter"), ("s", 4, "flat 4 128 north OLD mill race lane")]


@_case("leaks_found", "leaf_id form value", [(1, "joined", "oferriter"), (1, "part", "Ferriter"), (1, "digits", "1 (458) 555 2333"), (1, "date", "3 February 1990"), (4, "whole", "flat 4 128 north OLD mill race lane")])
def leaks_found(spark):
    return verify.leaks(spark.createDataFrame(_OUTPUTS, "scope string, leaf_id long, text string"), spark.createDataFrame(_ORIGINALS, "scope string, entity string, original string"))


@_case("leaks_budget", "start suspect", [(i, i >= 256) for i in range(260)])
def leaks_budget(spark):
    rows = [(1, i, i + 1, "o", "part", 800) for i in range(260)]
    return verify.within_budget(spark.createDataFrame(rows, "leaf_id int, start int, end int, original string, form string, text_length int"))


@_case("residue_found", "leaf_id part", [(1, "ferriter")])
def residue_found(spark):
    names = spark.createDataFrame([("s", "Odalys Ferriter"), ("s", "Mark Stone")], "scope string, name string")
    texts = spark.createDataFrame([("s", 1, "a Ferriter, a stone"), ("t", 2, "Ferriter")], "scope string, leaf_id long, text string")
    return verify.residue(texts, names, spark.createDataFrame([("stone",)], "word string"))


@_case("suspects_self_checking", "entity start", [("CREDIT_CARD", 5), ("US_SSN", 49)])
def suspects_self_checking(spark):
    rows = spark.createDataFrame([(1, "card 4111 1111 1111 1111, order 536-90-4399, ssn 536-90-4399")], "leaf_id long, text string")
    return verify.self_checking(rows, spark.createDataFrame([], "leaf_id long, start int, end int"))


@_case("choices_applied", "leaf_id output", [(1, "Eve is"), (2, "Hi, Ana"), (3, "x")])
def choices_applied(spark):
    docs = spark.createDataFrame([(1, "Ana is"), (2, "Hi, Ana"), (3, "x")], "leaf_id long, text string")
    edits = spark.createDataFrame([(1, 0, 3, "PERSON", "Ana", "Zoe"), (2, 4, 7, "PERSON", "Ana", "Zoe")], "leaf_id long, start int, end int, entity string, original string, new string")
    choices = spark.createDataFrame([("PERSON", "Ana", None, None, "replace", "Eve"), (None, None, 2, 4, "keep", None)], "entity string, original string, leaf_id long, start int, action string, text string")
    return review.apply_choices(docs, edits, choices)


_of("choices_refused", [("", "empty"), ("Ana Costa", "holds_original"), ("Zoe Pereira", "name_word"), ("Zoe", None)], lambda v: review.refused(v, F.lit("PERSON"), F.lit("Ana"), F.array(F.lit("Ana Pereira"))))
_of("choices_kind_guessed", [("a@b.co", "EMAIL_ADDRESS"), ("10.0.0.1", "IP_ADDRESS"), ("536-90-4399", "US_SSN"), ("4111 1111 1111 1111", "CREDIT_CARD"), ("+1 458 555 2333", "PHONE_NUMBER"), ("Ana Costa", "PERSON"), ("AB-12345", "ID_NUMBER")], review.guess_kind)

# ---- stand-ins: what a stand-in keeps of its original


def _kept(name: str, entity: str, originals: Sequence[str], good: Callable[[Column, Column], Column]) -> None:
    """A query of whether stand-ins of a kind differ from their originals and are good beside them."""

    @_case(name, "original changed good", [(o, True, True) for o in originals])
    def query(spark: SparkSession) -> DataFrame:
        rows = draw.stand_ins(spark.createDataFrame([("dataset", entity, o) for o in originals], "scope string, entity string, original string"), SEED, [entity])
        o, s = F.col("original"), F.col("stand_in")
        return rows.select("original", (o != s).alias("changed"), good(o, s).alias("good"))


_shape = lambda v: F.regexp_replace(F.regexp_replace(v, "[0-9]", "0"), "[A-Z]", "A")
_kept("standin_ssn", "US_SSN", ["536-90-4399", "536904399"], lambda o, s: checks.ssn(s) & (_shape(o) == _shape(s)))
_kept("standin_itin", "US_ITIN", ["912-70-1234"], lambda o, s: checks.itin(s) & (_shape(o) == _shape(s)))
_kept("standin_iban", "IBAN_CODE", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], lambda o, s: checks.iban(s) & (F.substring(o, 1, 2) == F.substring(s, 1, 2)) & (F.length(o) == F.length(s)))
_kept("standin_birth_date", "DATE_OF_BIRTH", ["1990-02-03", "07/24/1985"], lambda o, s: (_shape(o) == _shape(s)) & F.abs(F.regexp_extract(o, r"(\d{4})", 1).cast("int") - F.regexp_extract(s, r"(\d{4})", 1).cast("int")).between(1, 8))
_kept("standin_address", "ADDRESS", ["221 Baker Street", "9 Elm Ave"], lambda o, s: (F.length(F.regexp_extract(o, "^([0-9]+)", 1)) == F.length(F.regexp_extract(s, "^([0-9]+)", 1))) & (F.substring_index(o, " ", -1) == F.substring_index(s, " ", -1)))
_kept("standin_employer", "EMPLOYER", ["Acme Widgets GmbH", "Foo Ltd"], lambda o, s: F.substring_index(o, " ", -1) == F.substring_index(s, " ", -1))
_kept("standin_record_id", "RECORD_ID", ["cus_Ab12cd", "MBR-00912"], lambda o, s: _shape(F.regexp_replace(o, "[a-z]", "a")) == _shape(F.regexp_replace(s, "[a-z]", "a")))
_kept("standin_username", "USERNAME", ["apereira", "bob.smith"], lambda o, s: s.rlike("^[a-z]+[0-9]{3}$"))
_kept("standin_place", "LOCATION", ["Lisbon", "Porto"], lambda o, s: s.isin(*[p[0] for p in draw.PLACES]))
_kept("standin_unknown_kind", "DEVICE", ["A1-77"], lambda o, s: _shape(o) == _shape(s))
_kept("standin_phone_abroad", "PHONE_NUMBER", ["+351 912 345 678", "(458) 555-2333"], lambda o, s: (_shape(o) == _shape(s)) & (~o.startswith("+") | (F.substring(o, 1, 4) == F.substring(s, 1, 4))))
_of("standin_age", [("41", "38"), ("7", "4")], lambda v: draw.age(v, F.lit(3)))
_of("standin_expiry_shape", [("04/27", "00/00"), ("11/2029", "00/0000")], lambda v: F.regexp_replace(draw.expiry(v, SEED, "dataset"), "[0-9]", "0"))
_of("standin_initials", [("A.P.", "Z.C."), ("AP", "ZC")], lambda v: draw.initials(v, F.lit("Zoe Costa")))
_of("standin_masked_tail", [("***-**-7784", "***-**-1234"), ("xx84", "xx34")], lambda v: draw.masked_tail(v, F.lit("987-65-1234")))
_of("standin_numeric", [("9007199254740993", True), ("120", True)], lambda v: draw.numeric(v, SEED, "dataset").rlike("^[1-9][0-9]*$") & (F.length(draw.numeric(v, SEED, "dataset")) == F.length(v)))
_of("standin_key_digits", [("user_12345678_x", True), ("plain_key", False)], lambda v: draw.key_digits(v, SEED, "dataset") != v)
_of("same_number", [("2.12e9", "2120000000"), ("2120000000", "2120000000"), ("1.50", "1.5")], draw.same_number)
_of("standin_coordinates", [("48.8566", 4), ("48", 0)], lambda v: F.length(F.regexp_extract(draw.coordinates(v, v, v, SEED, "dataset")["latitude"], r"\.([0-9]+)$", 1)))
_of("standin_poured", [("+1 (458) 555", "+9 (876) 543"), ("no digits", "no digits")], lambda v: draw.pour(v, F.lit("9876543210")))
_of("mrz_rewritten", [("L898902C36UTO7408122F1204159ZE184226B<<<<<10", True)], lambda v: readers.mrz(readers.mrz_rewritten(v, SEED, "dataset")).isNotNull() & (readers.mrz_rewritten(v, SEED, "dataset") != v))


@_case("standins_apart", "entity originals stand_ins", [(e, 3000, 3000) for e in ("PERSON", "PHONE_NUMBER", "IP_ADDRESS", "EMAIL_ADDRESS")])
def standins_apart(spark):
    """Three thousand values of kinds whose plain draws are fewer: all keep stand-ins of their own."""
    made = spark.range(3000).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("PERSON", "PHONE_NUMBER", "IP_ADDRESS", "EMAIL_ADDRESS"))), F.array(
        F.concat(F.lit("Person N"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")), F.concat(F.lit("+1 (458) 222-"), F.lpad(F.col("id").cast("string"), 4, "0")),
        F.concat_ws(".", F.lit("24"), F.lit("5"), (F.col("id") / 256).cast("int").cast("string"), (F.col("id") % 256).cast("string")), F.concat(F.lit("u"), F.col("id").cast("string"), F.lit("@corp.example"))))).alias("entity", "original"))
    drawn = distinct.met(distinct.stand_ins(made.select(F.lit("dataset").alias("scope"), "entity", "original"), SEED))
    return drawn.groupBy("entity").agg(F.count_distinct("original").alias("originals"), F.count_distinct("stand_in").alias("stand_ins"))


# ---- formats

_of("format_by_name", [("a/b.JSON", "json"), ("x.ndjson", "jsonl"), ("t.tsv", "csv"), ("e.eml", "text"), ("p.exe", "unknown"), ("noending", None)], formats.classify)


def _python(name: str, pairs: Sequence[tuple], f: Callable[[str], str]) -> None:
    """A query of a per-document reader or writer over planted texts."""

    def read(v):
        return F.udf(f, "string")(v)

    _of(name, pairs, read)


_python("format_sniffed", [('{"a": 1}', "json"), ('{"a":1}\n{"a":2}', "jsonl"), ("<a>x</a>", "xml"), ("a;b\n1;2\n3;4", "csv"), ("just words", "text"), ("", "text")], formats.sniff_text)
_python("csv_parsed", [('a,"b ""q""",c\n1,"x\ny",3\n', 'a|b "q"|c/1|x\ny|3'), ("p;q\n", "p;q")], lambda t: "/".join("|".join(r) for r in csvsource.parse(t)))
_python("csv_dialect", [("a;b\n1;2\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a,b\n1,2\n", ",")], lambda t: csvsource.sniff(t)[0])
_python("csv_headed", [("name,email\nAna,a@b.co", "True"), ("Ana,a@b.co\nBo,b@b.co", "False"), ("n,x\n1,2", "True")], lambda t: str(csvsource.header(csvsource.parse(t), leaves.hinted)))
_python("csv_written", [("a,b;c\n", '"a";"b;c"'), ("x,y\n", '"x";"y"')], lambda t: ";".join(csvsource.quoted(c, ";", '"', True) for c in csvsource.parse(t)[0]))
_python("xml_leaves", [('<a k="v"><b>t</b><!--c--></a>', "attribute:k:v|text:b:t|comment::c"), ("<a", "refused"), ("<!DOCTYPE a><a/>", "refused")], lambda t: _refusing(lambda: "|".join(f"{x.kind}:{x.key}:{x.text}" for x in xmlsource.leaves(t)), xmlsource.BadXML))
_python("xml_written", [('<a k="Ana"><n> Ana </n>Anabel</a>', '<a k="Zo&amp;e"><n> Zo&amp;e </n>Anabel</a>')], lambda t: xmlsource.written(t, {"Ana": "Zo&e"}))
_python("json_leaves", [('{"a": 9007199254740993.0, "a": ["x"]}', "key:a|number:9007199254740993.0|key:a|value:x"), ("{", "refused"), ("[" * 70 + "]" * 70, "refused")], lambda t: _refusing(lambda: "|".join(f"{x.kind}:{x.text}" for x in jsonsource.leaves(t)), jsonsource.BadJSON))
_python("jsonl_records", [('{"a":"x"}\n\n{"a":{"b":"y"}}\n', "[0].a:1|[2].a.b:2,3")], lambda t: "|".join(f"{x.path}:{','.join(map(str, x.records))}" for x in jsonsource.line_leaves(t) if x.kind == "value"))
_python("json_patched", [('{"a" : "x", "n":1.50}', '{"a" : "y\\"", "n":1.50}')], lambda t: jsonsource.patched(t, [(x.start, x.end, x.kind, 'y"') for x in jsonsource.leaves(t) if x.text == "x"]))
_python("json_in_prose", [('see {"email": "a@b.co"} and {x} or [1, 2]', '{"email": "a@b.co"}|[1, 2]')], lambda t: "|".join(t[a:b] for a, b in jsonsource.regions(t)))
_python("nested_records", [(json.dumps({"p": '{"n":"Ann"}', "q": '{"n":"Bob"}'}), "Ann:1,2|Bob:1,3")], lambda t: "|".join(f"{x[5]}:{','.join(map(str, x[6]))}" for x in leaves.of(t, "json") if x[0] == "value"))


def _refusing(f: Callable[[], str], error: type[Exception]) -> str:
    try:
        return f()
    except error:
        return "refused"


_FILES = [
    ("json", "json", '{"id": 7, "name": "Ana Pereira", "email": "ana@corp.example", "plan": "pro", "total": 12.50}'),
    ("csv", "csv", "name;email;plan\nAna Pereira;ana@corp.example;pro\nRui Costa;rui@corp.example;free\n"),
    ("xml", "xml", '<c email="ana@corp.example"><FirstName>Ana</FirstName><LastName>Pereira</LastName><plan>pro</plan></c>'),
    ("text", "text", "Write to ana@corp.example about the pro plan."),
    ("jsonl", "jsonl", '{"name": "Ana Pereira"}\n{"plan": "pro"}\n'),
    ("broken", "json", '{"name": '),
]


@_case("files_pseudonymised", "doc_id hidden kept problem", [("broken", None, None, True), *((x, True, True, False) for x in ("csv", "json", "jsonl", "text", "xml"))])
def files_pseudonymised(spark):
    """Whole files: nothing personal is left, what is not personal stays, a file that cannot be read gives a problem and no output."""
    docs = spark.createDataFrame(_FILES, "doc_id string, kind string, text string")
    out = structured.pseudonymise_documents(docs, SEED, kind="kind")
    return out.select("doc_id", (~F.col("output").rlike("Pereira|Costa|corp[.]example")).alias("hidden"), F.col("output").contains("pro").alias("kept"), F.col("problem").isNotNull().alias("problem"))
