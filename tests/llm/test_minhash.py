import itertools

from veilspark.llm.minhash import near_duplicates, needed

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def brute(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return {i: (len(x), find(i), find(i) == i) for i, x in sets}


def corpus():
    import random

    rng = random.Random(7)
    rows, i = [], 0
    for _ in range(6):
        base = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(rng.choice([5, 40, 90, 200]))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
            rows.append((i, " ".join(words)))
            i += 1
    passage = " ".join(WORDS * 2)
    rows += [(i + j, f"{passage} own{j} " + " ".join(f"w{j}x{x}" for x in range(30))) for j in range(12)]
    return rows + [(900, ""), (901, None), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (906, "é" * 5000)]


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_matches_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sig string, n int")
    assert found(near_duplicates(docs)) == brute(rows)


def test_long_lists_by_blocks(spark, monkeypatch):
    from veilspark.llm import minhash

    monkeypatch.setattr(minhash, "SHORT", 2)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "DENSE", 2)
    rows = corpus()
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, "A b c d e f")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (4, 2, 1, False)], key=str)


def test_needed_is_safe():
    assert needed(64, 0.75) < 48 and needed(64, 1.0) == 64


def test_blocks_by_values(spark, monkeypatch):
    from veilspark.llm import minhash

    monkeypatch.setattr(minhash, "SHORT", 2)
    monkeypatch.setattr(minhash, "ITEMS", 150)
    rows = corpus()
    assert found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
