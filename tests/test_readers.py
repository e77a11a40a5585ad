import pytest
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.operators import readers


def spans(spark, reader, text):
    return [(s.entity, s.value, text[s.start : s.end] == s.value) for s in spark.createDataFrame([(text,)], "t string").select(reader(F.col("t")).alias("s")).first().s]


def test_links(spark):
    url = "https://bob:pw@x.org/users/odalys/edit?email=a%40b.co&page=2&access_token=abcdef123#state=z&sig=qwertyui"
    row = spark.createDataFrame([(url,)], "u string").select(readers.components(F.col("u")).alias("c")).select("c", F.transform("c", readers.personal).alias("p")).first()
    got = {(c.part, c.name, c.value): p for c, p in zip(row.c, row.p)}
    assert got == {
        ("user", "", "bob:pw"): "USERNAME", ("path", "", "users"): None, ("path", "users", "odalys"): "USERNAME", ("path", "odalys", "edit"): None,
        ("query", "email", "a@b.co"): "EMAIL_ADDRESS", ("query", "page", "2"): None, ("query", "access_token", "abcdef123"): "SECRET", ("fragment", "state", "z"): got["fragment", "state", "z"], ("fragment", "sig", "qwertyui"): "SECRET",
    }
    pages = spark.createDataFrame([("https://x.org/users/sign_in",), ("https://x.org/~odalys",), ("https://x.org/@odalys",)], "u string")
    assert [[p for p in r.p if p] for r in pages.select(F.transform(readers.components(F.col("u")), readers.personal).alias("p")).collect()] == [[], ["USERNAME"], ["USERNAME"]]


def test_labelled_lines_and_tables(spark):
    text = "First name: Ana\nStatus: active\n**Email:** a@b.co\n| Phone | +1 458 555 2333 |\n| Plan | pro |\nSurname: match\n"
    assert spans(spark, readers.labelled, text) == [("FIRST_NAME", "Ana", True), ("EMAIL_ADDRESS", "a@b.co", True), ("PHONE_NUMBER", "+1 458 555 2333", True)]


def test_pairs_cookies_and_connections(spark):
    text = "{name: 'Ana', \"plan\": \"pro\", password => 'hunter2'}\nexport API_KEY=abcd1234\nDEBUG=true\n"
    assert spans(spark, readers.pairs, text) == [("PERSON", "Ana", True), ("SECRET", "hunter2", True), ("SECRET", "abcd1234", True)]
    assert spans(spark, readers.cookies, "Cookie: theme=darkmode; sessionid=abc123def; lang=english") == [("SECRET", "abc123def", True)]
    text = "Server=db;User Id=sa;Password=p@ss!x; postgres://app:s3cret@db/x"
    assert spans(spark, readers.connection_strings, text) == [("SECRET", "p@ss!x", True), ("USERNAME", "sa", True), ("SECRET", "s3cret", True)]


def test_machine_readable_zone(spark):
    line = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    df = spark.createDataFrame([(line,), (line[:-1] + "1",)], "l string")
    good, bad = df.select(readers.mrz(F.col("l")).alias("m"), readers.mrz_rewritten(F.col("l"), "s", "d").alias("n")).collect()
    assert (good.m.number, good.m.country, good.m.birth, good.m.expiry) == ("L898902C3", "UTO", "740812", "120415") and bad.m is None
    again = spark.createDataFrame([(good.n,)], "l string").select(readers.mrz(F.col("l")).alias("m")).first().m
    assert len(good.n) == 44 and again is not None and again.number != "L898902C3" and again.expiry == "120415" and again.sex == "F"
    assert spark.range(1).select(checks.icao(F.lit("740812"))).first()[0] == 2


@pytest.mark.parametrize(("text", "day"), [("3 February 1990", "1990-02-03"), ("February 3, 1990", "1990-02-03"), ("3. März 1990", "1990-03-03"), ("3 de agosto de 1990", "1990-08-03"), ("12 août 2001", "2001-08-12"), ("30 February 1990", None), ("some day", None)])
def test_written_dates(spark, text, day):
    assert str(spark.range(1).select(readers.written_date(F.lit(text))).first()[0]) == str(day)


def test_addresses_languages_and_names(spark):
    got = spark.range(1).select(readers.address_layout(F.lit("Apt 4, 12 Main Street, Springfield, IL 62701, USA"))).first()[0]
    assert [p.role for p in got] == ["unit", "street", "place", "postcode", "country"]
    texts = {"The cat is in the house and the dog was with it": "en", "Der Hund und die Katze sind nicht mit dem Mann in der Stadt": "de", "Le chat est dans une maison et les chiens": "fr", "El perro que vive con los gatos es del vecino": "es", "xyzzy": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.g for r in df.select("t", readers.language(F.col("t")).alias("g")).collect()} == texts
    row = spark.range(1).select(*(readers.han_or_hangul_name(F.lit(x)).alias(f"c{i}") for i, x in enumerate(["王小明", "김민수", "北京市", "Wang"]))).first()
    assert list(row) == [True, True, False, False]


def test_windows(spark):
    tokens = spark.range(1).select(readers.windows(F.sequence(F.lit(1), F.lit(300)), 128, 96)).first()[0]
    assert [(w.first, len(w.tokens)) for w in tokens] == [(0, 128), (96, 128), (192, 108)]
    assert [(w.first, list(w.tokens)) for w in spark.range(1).select(readers.windows(F.array(F.lit(7)))).first()[0]] == [(0, [7])]
    read = spark.createDataFrame([(1, 100, 0, "A"), (1, 100, 96, "B"), (1, 101, 96, "C")], "leaf_id long, token int, first int, label string")
    assert {(r.token, r.label) for r in readers.first_window_wins(read).collect()} == {(100, "A"), (101, "C")}


def test_quality(spark):
    truth = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "A"), (2, 0, 3, "B")], "leaf_id long, start int, end int, label string")
    found = spark.createDataFrame([(1, 0, 6), (1, 0, 5), (1, 11, 15)], "leaf_id long, start int, end int")
    assert {r.label: (r.n, r.caught, r.recall) for r in readers.quality(truth, found).collect()} == {"A": (2, 1, 0.5), "B": (1, 0, 0.0)}
