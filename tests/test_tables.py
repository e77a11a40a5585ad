import pytest

from veilspark import api


def test_table_functions(spark):
    api.register_functions(spark)
    spark.createDataFrame([(1, "write ana@x.org or bo@y.org"), (2, None), (3, "nothing")], "id int, text string").createOrReplaceTempView("texts")
    rows = spark.sql("select t.id, s.* from texts t, lateral pii_spans(t.text) s order by id, start").collect()
    assert [tuple(r) for r in rows] == [(1, 6, 15, "EMAIL_ADDRESS", "ana@x.org"), (1, 19, 27, "EMAIL_ADDRESS", "bo@y.org")]
    spark.createDataFrame([(1, '{"a": {"b": "x"}, "n": 1}', None), (2, "<a k='v'>t</a>", "xml"), (3, "{bad", "json"), (4, None, None)], "id int, doc string, format string").createOrReplaceTempView("docs")
    rows = spark.sql("select d.id, l.kind, l.path, l.text from docs d, lateral pii_leaves(d.doc, d.format) l where l.kind <> 'key' order by id, leaf").collect()
    assert [tuple(r) for r in rows][:4] == [(1, "value", "$.a.b", "x"), (1, "number", "$.n", "1"), (2, "attribute", "/a/@k", "v"), (2, "text", "/a", "t")] and rows[4].kind == "problem" and len(rows) == 5
    with pytest.raises(Exception, match="is a string"):
        spark.sql("select * from pii_spans(1)").collect()
