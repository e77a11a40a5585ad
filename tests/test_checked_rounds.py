from pyspark.sql import functions as F

from veilspark.operators import checked, verify


def cutter(spark, path):
    return lambda df, name: (df.write.mode("overwrite").parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]


ROWS = [(1, "Mr. Odalys Ferriter called; ferriter again, user oferriter"), (2, "call +1 (458) 555-2333 or 458.555.2333"), (3, None), (4, "ferriter"), *((i, f"nothing here {i}") for i in range(10, 200))]


def test_rounds_read_what_changed(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    done = checked.rounds(docs, "s", cutter(spark, tmp_path))
    out = {r.leaf_id: r.text for r in done.outputs.collect()}
    assert len(out) == len(ROWS) and out[3] == "" and out[10] == "nothing here 10"
    assert not any(x in " ".join(out.values()).lower() for x in ("ferriter", "odalys", "555-2333", "555.2333"))
    assert done.log[0].read <= 4 and done.log[0].changed >= 2 and all(b.read <= a.changed for a, b in zip(done.log, done.log[1:])) and done.log[-1].leaks == 0
    assert done.suspects.count() == 0


def test_originals_that_a_round_adds_are_hunted_everywhere(spark, tmp_path):
    docs = spark.createDataFrame(ROWS + [(5, "Zarathustra sings"), (6, "so did zarathustra")], "doc_id long, text string")
    add = lambda leaks, turn: leaks.limit(1).select(F.lit("dataset").alias("scope"), F.lit("PERSON").alias("entity"), F.lit("Zarathustra").alias("original"), F.lit("Bo").alias("stand_in"))
    done = checked.rounds(docs, "s", cutter(spark, tmp_path), more=add)
    out = {r.leaf_id: r.text for r in done.outputs.collect()}
    assert out[5] == "Bo sings" and out[6] == "so did Bo" and out[11] == "nothing here 11"


def test_the_index_names_every_text_that_leaks(spark):
    texts = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Ana-Maria Costa", "ANÁ-MARIA COSTA!", "acosta", "costa", "+1 458-555 2333", "4585552333", "1 458 555 2333 x", "b@x.org", "none", ""])], "scope string, leaf_id int, text string")
    originals = spark.createDataFrame([("d", "PERSON", "Ana-Maria Costa"), ("d", "PHONE_NUMBER", "+1 (458) 555-2333"), ("d", "EMAIL_ADDRESS", "b@x.org")], "scope string, entity string, original string")
    named = {r.leaf_id for r in checked.named(checked.index(texts), originals).collect()}
    leaking = {r.leaf_id for r in verify.leaks(texts, originals).select("leaf_id").distinct().collect()}
    assert leaking <= named and leaking >= {0, 1, 3, 4, 7} and not named & {8, 9}


def test_empty_table(spark, tmp_path):
    done = checked.rounds(spark.createDataFrame([], "doc_id long, text string"), "s", cutter(spark, tmp_path))
    assert done.outputs.count() == 0 and done.suspects.count() == 0 and done.log[0].read == 0
