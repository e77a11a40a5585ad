import numpy as np

from veilspark.llm import subspace


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, float) / max(map(abs, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, _ in rows}
    count = [0] * len(good)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(good):
        for b, (j, y) in enumerate(good):
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                count[a] += 1
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    found = {i: n for (i, _), n in zip(good, count)}
    return {i: (found.get(i, 0), find(i), find(i) == i) for i, _ in rows}


def corpus(dim, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.normal(size=dim)
        rows += [(centre + rng.normal(size=dim) * s).tolist() for s in rng.uniform(0, 0.6, size=25)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def found(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_matches_all_pairs_in_small_cells(spark, monkeypatch):
    for name, value in (("CELL", 40), ("CHUNK", 16), ("OTHERS", 50), ("TILE", 8)):
        monkeypatch.setattr(subspace, name, value)
    rows = corpus(40)
    assert found(subspace.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1001, []), (1002, [0.0] * 5), (1003, [1.0, None, 0.0, 0.0, 0.0]), (1004, [nan] * 5), (1005, [inf, 0.0, 0.0, 0.0, 0.0]), (1006, [1e-200, 0.0, 0.0, 0.0, 0.0]), (1007, [1e200, 0.0, 0.0, 0.0, 0.0]), (1008, [1.0]), (1009, [2.0])]
    rows = corpus(5)[:40] + odd
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string")
    assert found(subspace.near_vectors(docs)) == brute(rows)


def test_null_repeated_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    got = sorted(map(tuple, subspace.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.1]), (2, [0.0, 1.0])], schema)).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True), (2, 0, 2, True)], key=str)
    assert subspace.near_vectors(spark.createDataFrame([], schema)).count() == 0
