from pyspark.sql import functions as F

from veilspark import api
from veilspark.operators import detect
from veilspark.streaming import live


def files(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00", "mail a@b.co"), (2, "2024-01-01 00:02:00", "a@b.co and 24.5.6.7"), (3, "2024-01-01 00:20:00", "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def test_windows_of_a_stream(spark, tmp_path):
    spans = live.detected(files(spark, tmp_path), bank=detect.BANK[:5])
    query = live.windowed(spans, "ts").writeStream.format("memory").queryName("seen").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.entity, r.n) for r in spark.sql("select * from seen").collect()} == {("EMAIL_ADDRESS", 2), ("IP_ADDRESS", 1)}


def test_pseudonymised_stream_agrees_with_batch(spark, tmp_path):
    query = live.pseudonymised(files(spark, tmp_path), f"{tmp_path}/out", "seed", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    live_rows = {r.doc_id: r.output for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert live_rows == {r.doc_id: r.output for r in api.pseudonymise.pseudonymise(spark.read.parquet(f"{tmp_path}/in"), "seed", apart=False).collect()}


def test_user_patterns_and_views(spark):
    docs = spark.createDataFrame([(1, "badge QX-77 and a@b.co")], "doc_id long, text string")
    bank = api.with_patterns(api.Pattern("ID_NUMBER", r"\bQX-\d+\b", 1.0))
    out = api.pseudonymise.pseudonymise(docs, "s", bank=bank).first()
    assert dict(out.counts) == {"EMAIL_ADDRESS": 1, "ID_NUMBER": 1} and "QX-77" not in out.output
    api.register_views(spark, docs)
    assert [tuple(r) for r in spark.sql("select entity, n from pii_counts").collect()] == [("EMAIL_ADDRESS", 1)]


def test_masked_columns_still_join(spark):
    df = spark.createDataFrame([("a1",), ("a1",), ("b2",), (None,)], "k string")
    out = [r.k for r in api.mask_column(df, "k", "s").collect()]
    assert out[0] == out[1] != out[2] and out[3] is None and "a1" not in out


def test_catalogue_has_twins():
    import __spark_entry__
    from veilspark.plans import catalog

    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.ORACLE_SQL) >= 45
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
