import random

from veilspark.operators import entities
from veilspark.operators.components import components


def cutter(spark, path):
    return lambda df, name: (df.write.mode("overwrite").parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]


def test_components_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(200, x) for x in range(201, 230)] + [(7, 7), (None, 3), (4, None)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for x in root if find(x) != x}
    got = components(spark.createDataFrame(edges, "a int, b int"), cutter(spark, tmp_path)).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a int, b int"), cutter(spark, f"{tmp_path}/e")).count() == 0


ROWS = [
    (1, "Ana Pereira", "ana@x.org", None, None), (2, None, "ANA@x.org ", "+1 (458) 555-2333", None), (3, None, None, "458 555 2333", "@anap"), (4, "A. Pereira", None, None, "anap"),
    (5, "Ms Pereira", None, None, None), (6, "Robert Costa", None, None, None), (7, "Bob Costa", None, None, None), (8, "Mrs Costa", None, None, None), (9, "Costa", None, None, None),
    (10, "Rui Lima", "office@x.org", "5550001111", None), (11, "Eva Lima", "shared@x.org", "5550001111", None), (12, "Zoe Reis", "shared@x.org", None, None), (13, "Lima", None, None, None), (14, "E. Lima", None, None, None),
    (15, None, None, None, None), (16, "info desk", "info@x.org", None, None), (17, None, "info@x.org", None, None), (18, "Mr Robert Costa", None, None, None),
]


def test_people(spark, tmp_path):
    rows = [("d", *r) for r in ROWS] + [("other", 100, "Pereira", "ana@x.org", None, None)]
    out = entities.resolve(spark.createDataFrame(rows, "scope string, mention int, name string, email string, phone string, handle string").repartition(3), cutter(spark, tmp_path))
    got = {r.mention: (r.person, r.full) for r in out.collect()}
    assert len(got) == len(rows)
    assert {got[i] for i in (1, 2, 3, 4, 5)} == {(1, "ana pereira")}
    assert {got[i] for i in (6, 7, 9, 18)} == {(6, "robert costa")} and got[8] == (8, None)  # Robert is a Mr by one mention
    assert got[10][0] == 10 and got[11][0] == 11 and got[12][0] == 12  # a phone and a mailbox that two full names share say nothing
    assert got[13] == (13, None) and got[14] == got[11]
    assert got[15] == (15, None) and got[16][0] == 16 and got[17][0] == 17 and got[100] == (100, None)
