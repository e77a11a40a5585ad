import json

import pytest

from veilspark import api
from veilspark.operators import structured

CUSTOMERS = [
    {"id": 7, "name": "Ana Pereira", "email": "ana.pereira@corp.example", "phone": "+1 (458) 555-2333", "plan": "pro", "contact": {"firstName": "Ana", "lastName": "Pereira", "username": "apereira"}},
    {"id": 8, "name": "Rui Costa", "email": "rui@corp.example", "phone": "+1 (458) 555-9871", "plan": "free", "note": "Dear Rui, write to ana.pereira@corp.example"},
]
DOCS = [
    ("j", json.dumps(CUSTOMERS, indent=1), "json"),
    ("c", "name;email;phone\r\nAna Pereira;ana.pereira@corp.example;+1 (458) 555-2333\r\nRui Costa;rui@corp.example;+1 (458) 555-9871\r\n", "csv"),
    ("x", '<c><customer email="ana.pereira@corp.example"><FirstName>Ana</FirstName><LastName>Pereira</LastName><plan>pro</plan></customer></c>', "xml"),
    ("t", "Mail ana.pereira@corp.example today.", "text"),
    ("n", '{"ssn": 536904399, "total": 12.50, "age": 31, "customer": {"pin": 123456}}', "json"),
    ("p", '{"applicant_name": "Ana Pereira", "applicant_email": "a@corp.example", "spouse_name": "Rui Costa", "spouse_email": "r@corp.example"}', "json"),
    ("f", '<form><field><name>email</name><value>ana.pereira@corp.example</value></field><field><name>ssn</name><value>536-90-4399</value></field><field><name>plan</name><value>pro</value></field></form>', "xml"),
    ("g", '[{"label": "Phone", "answer": "458 555 2333"}, {"key": "password", "value": "hunter2x"}, {"name": "ssn", "key": "email", "value": "two labels"}]', "json"),
    ("h", "<note><!--ana.pereira@corp.example--><![CDATA[ana.pereira@corp.example]]> ana.per<b>eira</b>&#64;corp.example <who>Ana</who></note>", "xml"),
    ("bad", "{", "json"),
    ("empty", "", "text"),
    ("null", None, "text"),
]
MANY = [(f"m{i}", json.dumps({"name": f"Person{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}x Name{'abcdefghij'[i // 100]}y"}), "json") for i in range(1000)]


@pytest.fixture(scope="module")
def out(spark):
    docs = spark.createDataFrame(DOCS + MANY, "doc_id string, text string, kind string")
    return {r.doc_id: r for r in structured.pseudonymise_documents(docs, "seed", kind="kind").collect()}


def test_formats_keep_their_structure_and_people_their_persona(out):
    got = json.loads(out["j"].output)
    assert [(r["id"], r["plan"]) for r in got] == [(7, "pro"), (8, "free")] and list(got[0]) == list(CUSTOMERS[0])
    ana, rui = got
    first, last = ana["name"].split(" ")
    assert ana["contact"]["firstName"] == first and ana["contact"]["lastName"] == last and last.lower() in ana["contact"]["username"]
    assert ana["email"].startswith(f"{first}.{last}.".lower()) and ana["name"] != rui["name"] and ana["phone"] != rui["phone"] != CUSTOMERS[1]["phone"]
    rows = [r.split(";") for r in out["c"].output.split("\r\n")]
    assert rows[0] == ["name", "email", "phone"] and rows[1][0] == ana["name"] and rows[1][1] == ana["email"] and rows[2][0] == rui["name"]
    assert f"<FirstName>{first}</FirstName><LastName>{last}</LastName><plan>pro</plan>" in out["x"].output
    whole = "".join(out[x].output for x in "jcxtp")
    assert "Pereira" not in whole and "corp.example" not in whole and "555-2333" not in whole
    assert out["bad"].output is None and out["bad"].problem and out["empty"].output == "" == out["null"].output


def test_labels_name_the_fields_beside_them(out):
    form = out["f"].output
    assert "ana.pereira" not in form and "536-90-4399" not in form and "<name>email</name>" in form and "<value>pro</value>" in form
    got = json.loads(out["g"].output)
    assert got[0]["answer"] != "458 555 2333" and got[0]["label"] == "Phone" and got[1]["value"] != "hunter2x" and got[2]["key"] == "email" and got[2]["value"] == "two labels"


def test_xml_is_changed_at_its_places(out):
    note = out["h"].output
    new = note.split("<!--")[1].split("-->")[0]
    assert "pereira" not in note and note == f"<note><!--{new}--><![CDATA[{new}]]> {new}<b></b> <who>Ana</who></note>"


def test_numbers_stay_numbers(out):
    got = json.loads(out["n"].output)
    assert got["total"] == 12.5 and isinstance(got["ssn"], int) and got["ssn"] != 536904399 and len(str(got["ssn"])) == 9 and '"total": 12.50' in out["n"].output


def test_two_people_of_one_record(out):
    got = json.loads(out["p"].output)
    for who in ("applicant", "spouse"):
        assert got[f"{who}_email"].startswith(got[f"{who}_name"].lower().replace(" ", "."))


def test_many_people_stay_apart(out):
    assert len({json.loads(out[x].output)["name"] for x, _, _ in MANY}) == 1000


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"email": "ana@corp.example"}')
    (tmp_path / "b").write_text("just a@corp.example here")
    (tmp_path / "c.bin").write_bytes(b"\x00" * 50)
    got = {r.path.rsplit("/", 1)[1]: r for r in api.pseudonymise_files(spark, str(tmp_path), "s").collect()}
    assert "corp.example" not in got["a.json"].output + got["b"].output and got["c.bin"].output is None and got["c.bin"].problem
