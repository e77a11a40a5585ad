import hashlib
import random
import zlib

from pyspark.sql import functions as F

from veilspark.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests):
    """The root of a list of digests, and for each its steps (before, after)."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            steps[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
            at[k] = i // 16
        level = [sha(*run) for run in runs]
    return level[0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r, sha(*map(framed, r))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        found[g] = climb([h for _, h in groups[g]])
    root, above = climb([found[g][0] for g in names])
    return [(r[0], h, found[g][0], root, steps + above[k]) for k, g in enumerate(names) for (r, h), steps in zip(groups[g], found[g][1])]


def told(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in df.collect()), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, h string, g int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA).repartition(3)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(500), rng.choice(["hot", "hot", "a", "Z", "é", "", None]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice(["Ab", "", None, "é\n"])) for _ in range(700)]
    rows += [rows[0]] * 40 + [(None, "hot", None, None, None), (1, "lone", "en", 0, "X")]
    df = merkle.manifest(table(spark, rows), also={"low": F.lower("text")})
    assert told(df) == sorted(brute(rows), key=repr)
    wrong = df.select((merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).alias("x"), (merkle.folded(F.sha2(F.lit("other").cast("binary"), 256), F.col("proof")) == F.col("root")).alias("y")).where("x or y")
    assert wrong.count() == 0


def test_small_shapes(spark):
    for n, sources in ((1, 1), (2, 1), (16, 1), (17, 1), (20, 20), (257, 1), (35, 2)):
        rows = [(i, f"s{i % sources}", "en", i, f"text {i}") for i in range(n)]
        assert told(merkle.manifest(table(spark, rows))) == sorted(brute(rows), key=repr), (n, sources)


def test_empty_table(spark):
    assert merkle.manifest(table(spark, [])).count() == 0


def test_query_tells_tampered_rows(spark, tmp_path):
    from veilspark.llm import queries

    rows = [(i, "s", "en", 1, t) for i, t in enumerate(["Upper", "lower", None, "ÄÖ", "X"] * 20)]
    table(spark, rows).select("doc_id", "source", "lang", "n_chars", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_merkle(spark, str(tmp_path)).collect():
        text = rows[r.doc_id][4]
        hit = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text is not None and any("A" <= c <= "Z" for c in text)
        assert r.verified is (not hit) and (r.folded_root == r.root) is r.verified
