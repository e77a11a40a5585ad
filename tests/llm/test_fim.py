import hashlib
import random
import re

from pyspark.sql import functions as F

from veilspark.llm import fim


def brute(doc_id, text, rate, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digits = hashlib.sha256(b"7:" + ("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "\n", "é", "😀", "\r", "<", ">", "S", " ", "\x00", " ", "<P", "\x0b"]) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(None, None), (None, "x\ny"), (5, ""), (7, "\n"), (8, "\n\n"), (9, "no line end"), (9, "no line end"), (-4, "a<S>b\n"), (2**62, "long\n" * 5000), (11, "w" * 50_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    for rate, spm in ((100, 50), (60, 0), (100, 100)):
        found = fim.transform(docs, rate=rate, spm=spm).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
        got = sorted(((r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored)) for r in found.collect()), key=repr)
        assert got == sorted(((i, brute(i, t, rate, spm)) for i, t in rows), key=repr)
    assert {x[1][1] for x in got} == {"plain", "spm"}


def test_steps_of_long_texts(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(fim, "CHUNK_BYTES", 7)
    for _ in range(300):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randrange(60)))
        ends = [0] + [m.end() for m in re.finditer(fim.LINES, text)]
        assert fim.offsets(text) == ends


def test_empty_table(spark):
    found = fim.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and found.count() == 0
