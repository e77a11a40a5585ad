from pyspark.sql import functions as F

from veilspark.functions import draw, text
from veilspark.operators import checked


def row(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_text(spark):
    lit = F.lit
    assert row(spark, text.visible(lit("Od​al**ys** and <b>Ana</b>r x")), text.visible_offsets(lit("a­b"))) == ["Odalys** and <b>Anar x", [0, 2]]
    assert row(spark, text.value_and_note(lit("128 -- gate code")))[0] == ("128", "gate code") and row(spark, text.value_and_note(lit("a-b")))[0] == ("a-b", None)
    assert row(spark, text.emphasis_masked(lit("**Name:** Ana _x_")))[0] == "  Name:   Ana  x " and row(spark, text.sentence_index(lit("A. B! C"), lit(6)), text.paragraph_index(lit("a\n\nb"), lit(4))) == [2, 1]
    assert row(spark, *(text.secret_like(lit(x)) for x in ("hunter2", "password", "/usr/bin/x1", "{{token}}", "aB3$xyz"))) == [True, False, False, False, True]
    assert row(spark, *(text.no_ones(lit(x)) for x in ("req_8f2", "1.2.3", "main.py", "cus_8f2"))) == [True, True, True, False]
    assert row(spark, text.machine_address(lit("gateway=10.0.0.3"), lit(8), lit("10.0.0.3")), text.machine_address(lit("from 10.0.0.3"), lit(5), lit("10.0.0.3"))) == [True, False]
    assert row(spark, text.cased_like(lit("Zoe"), lit("ANA")), text.cased_like(lit("Zoe"), lit("ana")), text.cased_like(lit("Zoe"), lit("Ana"))) == ["ZOE", "zoe", "Zoe"]
    assert row(spark, text.company(lit("Acme GmbH")), text.company(lit("Ana Pereira")), text.free_text(lit("one two three")), text.free_text(lit("王")), text.free_text(lit("one"))) == [True, False, True, True, False]


def test_more_draws(spark):
    c = row(spark, draw.coordinates(F.lit("52.5200"), F.lit("13.4"), F.lit("Berlin"), "s", "d"), draw.expiry(F.lit("09/27"), "s", "d"), draw.numeric(F.lit("-120.50"), "s", "d"), draw.initials(F.lit("A. P."), F.lit("Zuri Thorne")), draw.key_digits(F.lit("user_1234567_x"), "s", "d"), draw.key_digits(F.lit("user"), "s", "d"))
    assert len(c[0].latitude.split(".")[1]) == 4 and len(c[0].longitude.split(".")[1]) == 1
    assert 1 <= int(c[1][:2]) <= 12 and c[1][2] == "/" and c[1][3:] != "27" and len(c[1]) == 5
    assert c[2][0] == "-" and c[2][1] != "0" and len(c[2]) == 7 and c[2][4] == "." and c[3] == "Z. T."
    assert c[4].startswith("user_") and c[4].endswith("_x") and len(c[4]) == 14 and "1234567" not in c[4] and c[5] == "user"
    assert row(spark, *(draw.same_number(F.lit(x)) for x in ("2.12e9", "2120000000", "1.50", "1.5"))) == ["2120000000", "2120000000", "1.5", "1.5"]


def test_rounds_replace_what_leaks(spark, tmp_path):
    cut = lambda df, name: (df.write.mode("overwrite").parquet(f"{tmp_path}/{name}"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    rows = [(1, "Mr. Odalys Ferriter called; ferriter again, user oferriter"), (2, "call +1 (458) 555-2333 or 458.555.2333"), (3, "nothing here")]
    out, suspects, turns = checked.pseudonymise_checked(spark.createDataFrame(rows, "doc_id long, text string"), "s", cut)
    got = {r.doc_id: r.output for r in out.collect()}
    assert not any(x in " ".join(got.values()).lower() for x in ("ferriter", "odalys", "555-2333", "555.2333")) and got[3] == "nothing here"
    assert suspects.count() == 0 and 1 <= turns <= 3
