import itertools

import numpy as np

from veilspark.llm import packing


def test_boundaries_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(25):
        lengths = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        counts = rng.integers(1, 30, len(lengths))
        for buckets in (1, 2, 3, 5, 20):
            def cost(edges):
                return sum(c * min(e for e in edges if e >= n) for n, c in zip(lengths, counts))

            best = min(cost({*some, lengths[-1]}) for k in range(buckets) for some in itertools.combinations(lengths, k))
            edges = packing.boundaries(lengths, counts, buckets)
            assert len(edges) <= buckets and edges == sorted(edges) and edges[-1] == lengths[-1] and cost(edges) == best


def check(rows, docs, buckets, budget):
    got = packing.bucket_batches(docs, buckets, budget).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, len((t or "").encode().split())) for i, t in rows), key=str)
    slots = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens
        slots.setdefault((r.bucket, r.bucket_tokens, r.batch), []).append(r.slot)
    for (bucket, tokens, batch), found in slots.items():
        fits = max(1, budget // max(tokens, 1))
        assert sorted(found) == list(range(len(found))) and len(found) <= fits
        assert len(found) == fits or (bucket, tokens, batch + 1) not in slots  # all but the last are full
    return got


def test_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(["w"] * int(n))) for i, n in enumerate(rng.geometric(0.02, 500))]
    rows += [(None, None), (3, ""), (3, ""), (900, " \n\x0b "), (901, "w " * 20_000), (902, "a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    got = check(rows, docs, 6, 400)
    assert max(r.bucket for r in got) == 5
    order = sorted(((r.bucket, r.batch, r.slot, r.n_tokens, r.doc_id) for r in got), key=lambda x: x[:3])
    for a, b in zip(order, order[1:]):
        assert a[0] < b[0] or a[3] <= b[3]


def test_empty(spark):
    assert packing.bucket_batches(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lengths_are_not_rounded(spark):
    rows = [(i, "w " * n) for i, n in enumerate([1500, 1501, 1503, 1510, 3001, 3003])]
    got = packing.bucket_batches(spark.createDataFrame(rows, "doc_id long, text string"), 3, 10_000).collect()
    assert {r.doc_id: r.bucket_tokens for r in got} == {0: 1503, 1: 1503, 2: 1503, 3: 1510, 4: 3003, 5: 3003}


def test_many_lengths():
    rng = np.random.default_rng(8)
    lengths, counts = np.arange(1, 401), rng.integers(1, 1000, 400)
    cost = {0: 0.0}  # plain dynamic programming, all starts tried
    total = np.concatenate([[0], np.cumsum(counts)])
    for _ in range(6):
        cost = {j: min([cost[i] + (total[j] - total[i]) * int(lengths[j - 1]) for i in cost if i < j] + [cost.get(j, np.inf)]) for j in range(401)}
    edges = packing.boundaries(lengths, counts, 6)
    assert len(edges) <= 6 and cost[400] == sum(c * min(e for e in edges if e >= n) for n, c in zip(lengths, counts))
    assert len(packing.boundaries(np.arange(1, 20_001), rng.integers(1, 9, 20_000), 16)) == 16
