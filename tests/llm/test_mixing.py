import random
import struct

import pytest
import xxhash

from veilspark.llm import mixing


def chance(*keys):
    """As the engine's 64-bit hash: each key seeds the next."""
    h = 42
    for k in keys:
        if k is None:
            continue
        data = k if isinstance(k, bytes) else k.encode() if isinstance(k, str) else struct.pack("<q" if isinstance(k, Long) else "<i", k)
        h = xxhash.xxh64_intdigest(data, h)
    return (h >> 11) / 2**53


class Long(int):
    pass


def targets(sizes, share=1.5, most=2.0):
    """Shares by weight, round by round, as the words say it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in stopped]
        kept, weights = total - sum(most * sizes[s] for s in stopped), sum(weight[s] for s in rest)
        level = kept / weights if rest else 0
        over = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in stopped else kept * weight[s] / weights for s in names}
        stopped |= over


def trade(a, b, u):
    """Words go from one (size, mass) to the other."""
    up, down = min(a[0] - a[1], b[1]), min(a[1], b[0] - b[1])
    if u * (up + down) < down:
        return (a[0], float(a[0]) if a[0] - a[1] <= b[1] else a[1] + b[1]), (b[0], 0.0 if b[1] <= a[0] - a[1] else b[1] - (a[0] - a[1]))
    return (a[0], 0.0 if a[1] <= b[0] - b[1] else a[1] - (b[0] - b[1])), (b[0], float(b[0]) if b[0] - b[1] <= a[1] else b[1] + a[1])


def brute(rows, seed=13):
    docs = {}
    for i, s, t in rows:
        docs.setdefault(s, []).append((i, len((t or "").encode().split())))
    sizes = {s: sum(n for _, n in d) for s, d in docs.items()}
    wanted, out = targets(sizes), []
    for s, d in docs.items():
        p = wanted[s] / sizes[s] if sizes[s] else 0.0
        whole = int(p // 1)
        d.sort(key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        items, up, level = [(k, k, n, (p - whole) * n) for k, (_, n) in enumerate(d)], {}, 0  # rank, document, size, mass

        def chain(found, level):
            carry = None
            for rank, k, n, mass in found:
                pair = [(k, n, mass)]
                if 0 < mass < n and carry:
                    a, b = trade(carry[1:], (n, mass), chance(seed, s, level, Long(rank)))
                    pair, carry = [(carry[0], *a), (k, *b)], None
                for k2, n2, m2 in pair:
                    if 0 < m2 < n2:
                        carry = (k2, n2, m2)
                    else:
                        up[k2] = int(m2 > 0 and m2 >= n2)
            return carry

        waits = {k for k, *_ in items if k < 128 or k % (1 << (k.bit_length() - 7)) == 0}
        last, items = [x for x in items if x[0] in waits], [x for x in items if x[0] not in waits]
        while items:
            blocks = {}
            for x in items:
                blocks.setdefault(x[0] // mixing.FAN, []).append(x)
            items = [(block, *carry) for block, found in sorted(blocks.items()) if (carry := chain(found, level))]
            if max(blocks) == 0:
                break
            level += 1
        last = sorted([*last, *((-1, *x[1:]) for x in items)], key=lambda x: (-x[2], x[0]))
        carry = chain(last, -1)
        if carry:
            up[carry[0]] = int(2 * carry[2] >= carry[1])
        out += [(i, s, n, sizes[s], wanted[s], (whole + up[k]) * n) for k, (i, n) in enumerate(d)]
    return out


def told(df):
    return sorted(((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in df.collect()), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "b", "c", "é", None]), " ".join(["w"] * int(rng.paretovariate(1.1)))) for i in range(9000)]
    rows += [(i, "z-empty", None) for i in range(5)] + [(7, "dup", "a b c")] * 300 + [(None, "dup", "\x0b a\x00b \t"), (1, "one", "a b c d e"), (2, "a-small", "a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, target string")
    got = told(mixing.mix(docs))
    assert got == sorted(brute(rows), key=repr)
    assert got == told(mixing.mix(docs.repartition(7)))
    total, taken, longest = {}, {}, {}
    for _, s, n, size, target, k in got:
        assert k <= 2 * n and (not n or k % n == 0)
        total[s], taken[s], longest[s] = (size, target), taken.get(s, 0) + k, max(n, longest.get(s, 0))
    assert all(abs(taken[s] - t) <= longest[s] / 2 for s, (_, t) in total.items())
    assert max(abs(taken[s] - total[s][1]) / total[s][1] for s in ("hot", "b", "c", "é", None)) < 0.05
    assert sum(t for _, t in total.values()) == pytest.approx(1.5 * sum(n for n, _ in total.values()))


def test_expectations_stay(spark):
    rows = [(i, s, " ".join(["w"] * (i % 7 + 1))) for s in "abc" for i in range(40)]
    docs, seen = spark.createDataFrame(rows, "doc_id long, source string, text string"), {}
    for seed in range(12):
        for i, s, n, size, target, k in told(mixing.mix(docs, seed=seed)):
            seen.setdefault((s, n), []).append(k / n - target / size)
    assert all(abs(sum(x) / len(x)) < 0.25 for x in seen.values())


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    blank = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert told(mixing.mix(blank)) == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
