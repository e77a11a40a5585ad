"""What grows with the input is neither broadcast nor one task's work."""

from pyspark.sql import functions as F

from veilspark.functions import draw, keys
from veilspark.operators import associate, detect, distinct, pseudonymise, readers, records, structured
from veilspark.plans import portable
from veilspark.sources import leaves
from veilspark.sources.scratch import Scratch


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _documents(spark, n=40):
    return spark.range(n).coalesce(1).select(F.col("id").cast("string").alias("doc_id"), F.format_string('{"name": "N%d"}', "id").alias("text"), F.lit("json").alias("kind"))


def _parts(df):
    return df.rdd.getNumPartitions()


def test_leaves_and_values_of_documents_are_not_broadcast(spark):
    found = leaves.leaves(_documents(spark), kind="kind")
    assert "Broadcast" not in _plan(detect.detect_leaves(found))
    changed = found.select("doc_id", "leaf_id", "kind", "path", "start", "end", "text", F.lit("x").alias("new"), F.expr("array(named_struct('start', 0, 'end', 1, 'new', 'x'))").alias("edits"))
    assert "Broadcast" not in _plan(structured.rewritten(_documents(spark), changed, found.select("doc_id", "problem"), kind="kind"))
    owners = associate.owners(found.select("leaf_id", "record_ids"), spark.range(40).select(F.col("id").alias("record_id"), F.lit("N").alias("person")))
    assert "Broadcast" not in _plan(owners)


def test_documents_of_one_small_file_are_read_by_many_tasks(spark):
    assert _parts(leaves.leaves(_documents(spark), kind="kind")) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_drawing_is_dealt_to_many_tasks_after_all_shuffles(spark):
    values = spark.range(300).coalesce(1).select(F.lit("dataset").alias("scope"), F.lit("CREDIT_CARD").alias("entity"), F.format_string("4000%012d", "id").alias("original"))
    for drawn in (draw.stand_ins(values, "seed", ["CREDIT_CARD"]), distinct.stand_ins(values, "seed")):
        assert drawn.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_drawn_value_is_made_once(spark):
    told = spark.range(1).select(draw.once(F.uuid(), lambda v: F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: v)))).alias("n"))
    assert told.first().n == 1
    card = spark.range(1).select(draw.card(F.lit("4000-0000-0000-0002"), "seed", "dataset").alias("c"))
    assert _plan(card).count("sha2(") <= 4


def test_matches_and_cookies_search_a_text_no_more_often_than_they_must(spark):
    rows = spark.createDataFrame([("Cookie: a=1; session_id=abcdef; token=xyz123\nsession_id=outside1 sid=abcdefg\nset-cookie:sid=abcdefg; auth=abcdefg",)], "line string")
    spans = rows.select(readers.cookies(F.col("line")).alias("s"))
    assert _plan(spans).count("regexp_extract_all(") == 1
    assert [s.value for s in spans.first().s] == ["abcdef", "xyz123", "abcdefg"]


def test_labels_are_told_once_and_before_rows_are_shuffled(spark):
    assert _plan(spark.createDataFrame([("billingEmail",)], "k string").select(keys.hint(F.col("k")).alias("h"))).count("translate(") == 1
    plan = _plan(structured.labelled(leaves.leaves(_documents(spark), kind="kind")))
    after = plan[: plan.index("Exchange hashpartitioning(doc_id")]
    assert "Window" in after and "translate(" not in after and 0 < plan.count("translate(") <= 6


def test_texts_of_one_small_file_are_searched_by_many_tasks(spark, monkeypatch):
    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: plans.update({name: _plan(df)}) or save(self, df, name))
    docs = spark.range(20).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.format_string("Mail u%d@corp.ex<b>am</b>ple", "id")).otherwise("none").alias("text"))
    out = pseudonymise.pseudonymise(docs, "seed").collect()
    assert len(out) == 20 and all(("corp" in r.output, r.n_spans) == (False, r.doc_id % 2 == 0) for r in out)
    search, _, dealing = plans["spans"].partition("Exchange hashpartitioning(key")
    assert "ArrowEvalPython" in search and dealing and "ArrowEvalPython" not in dealing


def test_values_of_several_kinds_are_found_in_one_search_each(spark):
    rows = spark.createDataFrame([("a@b.co, +1 (458) 555-2333 and c@d.example a@b.co",), ("+1 (458) 555-2333",), ("none@here",), ("+1 (1)",), ("",), (None,)], "text string")
    found = portable.values(rows, ("EMAIL_ADDRESS", "PHONE_NUMBER"))
    assert _plan(found).count("regexp_extract_all(") == 2
    assert found.count() == 3 and {tuple(r) for r in found.collect()} == {("EMAIL_ADDRESS", "a@b.co"), ("EMAIL_ADDRESS", "c@d.example"), ("PHONE_NUMBER", "+1 (458) 555-2333")}


def test_texts_without_a_named_number_are_not_searched_for_record_ids():
    import regex

    pattern, need, _ = records.IDS[0]
    for text in ("customer id: AB-1234", 'userNo"="x9yz"', "patient ref # 77777", "Guest_ID  7abcd", "account number: \"ab_12345\""):
        assert regex.search(pattern, text) and regex.search(need, text)
    assert not regex.search(need, "Nobody did refer to the idea of a number, and the customer id is unknown.")
