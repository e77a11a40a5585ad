import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import maps
from veilspark.operators import pseudonymise

BITS = ["a", "Z", "é", "7", " ", "*", "**", "<b>", "</b>", "<p>", "&#64;", "&amp;", "&eacute;", "&nope;", "\u200b", "\u00ad", "\u00a0", "\u2063", "https://x.y/%C3%A9%41", "%ff", "\U0001f600"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14))
def test_maps_lead_there_and_back(bits):
    """Brute force: each read character stands in what was written there, and places come back."""
    text = "".join(bits)
    got = maps.reading(text, maps.LAYERS)
    if got is None:
        return
    seen, at, start, end = got
    assert at[-1] == len(seen) and len(at) == len(start) + 1 == len(end) + 1
    done = 0
    for i, c in enumerate(seen):
        (a,), (b,) = maps.written_places(at, start, end, [i], [i + 1])
        assert done <= a < b  # in order, none twice
        done = b
        raw = text[a:b]
        assert c == raw or (c, raw) == (" ", "\u00a0") or raw.startswith(("&", "%"))
        assert list(maps.read_places(at, start, end, [a])) == [i]
    whole = maps.read_places(at, start, end, np.arange(len(text) + 1))
    assert (np.diff(whole) >= 0).all() and whole[-1] == len(seen)


def test_readings(spark):
    cases = [
        ("plain", None),
        (None, None),
        ("", None),
        ("<b>Odal</b>ys", "Odalys"),
        ("a\u200bna&#64;x<i>y</i>.org", "ana@xy.org"),
        ("&lt;b&gt;x &unknown; &#xE9;", "<b>x &unknown; é"),
        ("**** 1234 ~~old~~ 2 * 3", "**** 1234 old 2 * 3"),
        ("see https://x.org/u%C3%A9%40y 100%25", "see https://x.org/ué@y 100%25"),
        ("\u200b\u00ad", ""),
    ]
    df = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "i int, text string").select("i", maps.read(F.col("text"), maps.LAYERS).alias("seen"))
    assert [r.seen and r.seen.text for r in df.orderBy("i").collect()] == [want for _, want in cases]


def test_values_are_written_as_they_were(spark):
    cases = [
        ("Odal</b>ys", "Maren", "Maren</b>"),
        ("Ingvar* **Peltomaa", "Maren Holt", "Maren* **Holt"),
        ('Ana <span class="a b">Costa', "Bo Li", 'Bo <span class="a b">Li'),
        ("Ana <b>Costa</b> Silva", "Bo Li", "Bo Li<b></b>"),
        ("a\u200bna@x.org", "bo@y.org", "bo@y.org"),
        ("ana&#64;x.org", "A&B", "A&amp;B"),
        ("ana%40x.org", "bo@y.org", "bo%40y.org"),
    ]
    df = spark.createDataFrame(cases, "raw string, new string, want string")
    rows = df.select("want", maps.written_like(F.col("new"), F.col("raw"), maps.LAYERS).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_disguised_values_are_replaced_where_they_stand(spark):
    docs = [(1, "Write to ana.silva@mail.exam<b>ple</b>.org, or <b>ana</b>.sil\u00adva@mail.example.org now"), (2, "plain ana.silva@mail.example.org"), (3, None), (4, "no\u200bthing"), (5, "see ana.silva&#64;mail.example.org &amp; more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: r for r in pseudonymise.pseudonymise(df, "s", through=maps.LAYERS).collect()}
    new = out[2].output.removeprefix("plain ")
    assert new != "ana.silva@mail.example.org"
    assert out[1].output == f"Write to {new}<b></b>, or <b>{new}</b> now"
    assert [out[1].output[m.start : m.end] for m in out[1].marks] == [new + "<b></b>", new + "</b>"]
    assert (out[3].output, out[4].output, out[5].output) == ("", "no\u200bthing", f"see {new} &amp; more")
    assert {m.original for r in out.values() for m in r.marks} == {"ana.silva@mail.example.org"}
