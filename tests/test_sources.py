import re

import pytest
from pyspark.sql import functions as F

from veilspark.sources import csvsource, formats, jsonsource, leaves, xmlsource


def test_json_is_lossless():
    text = '{ "name" : "Ana", "n":1.50,"a":[{"x":"y"},true,null,-2e3], "name":"dup","e":{},"l":[] }\n'
    found = jsonsource.leaves(text)
    assert [(f.path, f.kind, f.text) for f in found if f.kind != "key"] == [("$.name", "value", "Ana"), ("$.n", "number", "1.50"), ("$.a[0].x", "value", "y"), ("$.a[3]", "number", "-2e3"), ("$.name", "value", "dup")]
    assert jsonsource.patched(text, []) == text
    ana = next(f for f in found if f.text == "Ana")
    assert jsonsource.patched(text, [(ana.start, ana.end, "value", 'Zo"ë')]) == text.replace('"Ana"', '"Zo\\"ë"')
    assert [f.records for f in found if f.text == "y"] == [(1, 2)]
    with pytest.raises(jsonsource.BadJSON):
        jsonsource.spelled("number", "01")


@pytest.mark.parametrize("text", ['{"a":1,}', "[1 2]", '{"a"}', '{"a":1} x', "[" * 70 + "]" * 70, "", "{", '"\n"', "01"])
def test_bad_json_is_refused(text):
    with pytest.raises(jsonsource.BadJSON):
        jsonsource.leaves(text)


def test_json_lines_and_nested_documents():
    assert [(f[1], f[5]) for f in leaves.of('{"a":"x"}\n\n{"a":"y"}\n', "jsonl") if f[0] == "value"] == [("[0].a", "x"), ("[2].a", "y")]
    assert [(f[1], f[2], f[5]) for f in leaves.of('{"k":"{\\"email\\":\\"a@b.c\\"}"}', "json") if f[0] == "value"] == [("$.k~.email", "email", "a@b.c")]
    assert [(f[0], f[5]) for f in leaves.of('curl -d {"user":"bob"} x', "text")] == [("prose", "curl -d "), ("key", "user"), ("value", "bob"), ("prose", " x")]


def test_csv_dialects():
    assert csvsource.sniff("id;note\n1;x\n2;c\n") == (";", '"') and csvsource.sniff('a,b\n"x,y",2\n') == (",", '"') and csvsource.sniff("a\tb\n1\t2\n")[0] == "\t"
    assert csvsource.sniff("id,note\n1,it's\n2,'tis\n") == (",", '"')
    rows = [["a", 'b "q" \n x', "c"], ["1", "2"], ["", ""]]
    assert csvsource.parse('a,"b ""q"" \n x",c\r\n1,2\n,\n') == rows
    assert csvsource.parse(csvsource.written(rows, ";"), ";") == rows
    with pytest.raises(csvsource.BadCSV):
        csvsource.parse('a,"b')
    hinted = lambda c: c == "email"
    assert csvsource.header([["id", "email"], ["1", "a@b.c"]], hinted) and not csvsource.header([["1", "a@b.c"], ["2", "d@e.f"]], hinted)


def test_csv_formulas(spark):
    cells = ["=1+1", "+1", "-2.5", "@x", "-x", "plain", "＝1"]
    row = spark.range(1).select(*(csvsource.neutralised(F.lit(c)).alias(f"c{i}") for i, c in enumerate(cells))).first()
    assert list(row) == ["'=1+1", "+1", "-2.5", "'@x", "'-x", "plain", "'＝1"]


def test_xml():
    text = '<r xmlns:a="u"><a:p id="7">Ana <n>x</n></a:p><!-- hi --><?pi some?></r>'
    assert [(f.path, f.kind, f.text) for f in xmlsource.leaves(text)] == [("/r/a:p/@id", "attribute", "7"), ("/r/a:p", "text", "Ana"), ("/r/a:p/n", "text", "x"), ("/r/#comment", "comment", "hi"), ("/r/?pi", "instruction", "some")]
    assert xmlsource.written("<a k='Ana'>Ana<n>Anat</n></a>", {"Ana": "Z<e"}) == "<a k='Z&lt;e'>Z&lt;e<n>Anat</n></a>"
    for bad in ('<!DOCTYPE r [<!ENTITY x "y">]><r>&x;</r>', "<r>", "<a>" * 70 + "</a>" * 70):
        with pytest.raises(xmlsource.BadXML):
            xmlsource.leaves(bad)


def masked(source, value, new):
    changes = [(i, m.start(), m.end(), new) for i, f in enumerate(xmlsource.leaves(source)) for m in re.finditer(re.escape(value), f.text)]
    return xmlsource.patched(source, changes)


def test_xml_values_are_changed_where_they_stand():
    mail = "ana@x.org"
    for source, want in (
        ("<a><![CDATA[ana@x.org]]></a>", "<a><![CDATA[N]]></a>"),
        ("<a>ana&#64;x.org</a>", "<a>N</a>"),
        ("<a>to ana&#x40;x.org!</a>", "<a>to N!</a>"),
        ("<a>ana@<b/>x.org</a>", "<a>N<b/></a>"),
        ("<a>an<b>a@x</b>.o<i>rg</i> x</a>", "<a>N<b></b><i></i> x</a>"),
        ("<a>ana<!--c-->@x.org</a>", "<a>N<!--c--></a>"),
        ("<a><!--ana@x.org--></a>", "<a><!--N--></a>"),
        ("<a>ana@x<![CDATA[.org]]>\r\n</a>", "<a>N<![CDATA[]]>\r\n</a>"),
        ("<a k='ana@x.org' l=\"ana&#64;x.org\"/>", "<a k='N' l=\"N\"/>"),
        ("<a><?p ana@x.org?></a>", "<a><?p N?></a>"),
        ("<?xml version='1.0'?>\n<a>ana@x.org<b>ana@x.org</b></a>\n", "<?xml version='1.0'?>\n<a>N<b>N</b></a>\n"),
    ):
        assert masked(source, mail, "N") == want, source
    assert masked("<a>ana@x.org<br/>x</a>", mail, "N") == "<a>N<br/>x</a>"
    assert [f.text for f in xmlsource.leaves("<a>Ana<br/>Costa</a>")] == ["Ana\nCosta"]
    # by place, not by value; stand-ins are not replaced again
    source = "<r><name>Ana</name><status>Ana</status><other>Rui</other></r>"
    at = {f.path: i for i, f in enumerate(xmlsource.leaves(source))}
    assert xmlsource.patched(source, [(at["/r/name"], 0, 3, "Bo"), (at["/r/other"], 0, 3, "Ana")]) == "<r><name>Bo</name><status>Ana</status><other>Ana</other></r>"
    for how, source, want in (
        ("text", "<a>x</a>", "<a>&lt;&amp;&gt;\"]]&gt;&#13;--?&gt;</a>"), ("attribute", "<a k='x'/>", "<a k='&lt;&amp;&gt;&quot;]]&gt;&#13;--?&gt;'/>"),
        ("cdata", "<a><![CDATA[x]]></a>", "<a><![CDATA[<&>\"]]]]><![CDATA[>\r--?>]]></a>"), ("comment", "<a><!--x--></a>", "<a><!--<&>\"]]>\r- -?>--></a>"), ("pi", "<a><?p x?></a>", "<a><?p <&>\"]]>\r--? >?></a>"),
    ):
        out = masked(source, "x", "<&>\"]]>\r--?>")
        assert out == want, how
        xmlsource.leaves(out)
    for bad in ([(5, 0, 1, "x")], [(0, 0, 99, "x")], [(0, 0, 2, "x"), (0, 1, 3, "y")]):
        with pytest.raises(xmlsource.BadXML):
            xmlsource.patched("<a>Ana</a>", bad)


def test_xml_against_another_reader():
    """Texts agree with those of the standard library's tree, and writing each leaf as it is changes nothing that a reader sees."""
    import random
    from xml.etree import ElementTree

    rng = random.Random(5)
    texts = ["a", " ", "&amp;", "&#233;", "x y", "<![CDATA[<k>]]>", "<!--c-->", "\n", "&lt;", "é"]

    def element(depth):
        name, inner = rng.choice(["b", "n", "p", "i", "q2"]), ""
        for _ in range(rng.randrange(5)):
            inner += element(depth + 1) if rng.random() < 0.4 and depth < 4 else rng.choice(texts)
        return f"<{name} k='{rng.choice(['v', '&quot;', ''])}'>{inner}</{name}>" if rng.random() < 0.5 else f"<{name}>{inner}</{name}>"

    for _ in range(400):
        source = element(0)
        found = xmlsource.leaves(source)
        tree = ElementTree.fromstring(source)
        squeezed = lambda t: "".join(t.split())
        assert squeezed("".join(f.text for f in found if f.kind == "text")) == squeezed("".join(tree.itertext()))
        for f in found:
            for at, n, a, width, _ in f.segments:
                assert n != width or f.text[at : at + n].replace("\r", "\n") == source[a : a + width].replace("\r", "\n") or source[a] == "&"
        again = xmlsource.patched(source, [(i, 0, len(f.text), f.text) for i, f in enumerate(found) if f.text])
        assert squeezed("".join(ElementTree.fromstring(again).itertext())) == squeezed("".join(tree.itertext()))


def test_json_lines_end_at_line_feeds_only(spark):
    text = '{"a": "x\u2028y\x85z"}\r\n\n{"a": "b"}'
    assert [(f.path, f.text, text[f.start : f.end]) for f in jsonsource.line_leaves(text) if f.kind == "value"] == [("[0].a", "x\u2028y\x85z", '"x\u2028y\x85z"'), ("[2].a", "b", '"b"')]
    assert formats.sniff_text(text) == "jsonl"


def test_sniff_and_leaves_table(spark):
    kinds = {"": "text", '{"a":1}': "json", '{"a":1}\n{"b":2}': "jsonl", "<a/>": "xml", "a,b\n1,2\n3,4": "csv", "hello, you": "text", "{broken": "text"}
    assert {t: formats.sniff_text(t) for t in kinds} == kinds
    docs = spark.createDataFrame([("1", '{"email":"a@b.c"}', None), ("2", "{bad", "json"), ("3", None, None), ("4", "name;age\nAna;3\nBo;4\n", "csv")], "doc_id string, text string, kind string")
    got = leaves.leaves(docs, kind="kind").collect()
    assert [(r.key, r.text) for r in got if r.doc_id == "1" and r.kind == "value"] == [("email", "a@b.c")]
    assert [r.kind for r in got if r.doc_id == "2"] == ["problem"] and not [r for r in got if r.doc_id == "3"]
    assert [(r.key, r.text, r.record_ids) for r in got if r.doc_id == "4"] == [("name", "Ana", [0]), ("age", "3", [0]), ("name", "Bo", [1]), ("age", "4", [1])]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"email":"a@b.c"}')
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "e.txt").write_bytes(b"")
    (tmp_path / "f").write_text("k,v\n1,2\n3,4\n")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.refused, r.text) for r in formats.read(spark, str(tmp_path)).collect()}
    assert got["a.json"] == ("json", None, '{"email":"a@b.c"}') and got["b.bin"][:2] == ("unknown", "unknown_format") and got["c.txt"] == ("text", None, "hello")
    assert got["d.txt"][1] == "not_utf8" and got["f"][0] == "csv" and got.get("e.txt", ("text", "empty_file"))[1] == "empty_file"
