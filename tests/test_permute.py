"""Permutations are bijections without fixed points, on the whole of small domains, and keep what they promise."""

import ipaddress
import random

from pyspark.sql import functions as F

from veilspark.functions import checks, permute
from veilspark.operators import distinct
from veilspark.sources.scratch import Scratch

KEY = permute.key("s", "d", "K")


def through(values, f, secret=KEY):
    return {v: f(v, secret) for v in values}


def test_whole_domains():
    for values in ([f"{i:03d}" for i in range(1000)], [f"x-{a}{b}{i}" for a in "abcxyz" for b in "ABZ" for i in range(10)], list("0123456789"), [f"{i:02d}" for i in range(100)]):
        made = through(values, permute.shaped)
        assert len(set(made.values())) == len(values) and all(k != v for k, v in made.items())
    assert set(through([f"{i:03d}" for i in range(1000)], permute.shaped).values()) == {f"{i:03d}" for i in range(1000)}
    assert through(["", "-", "é#"], permute.shaped) == {"": "", "-": "-", "é#": "é#"}


def test_keys_and_long_values():
    values = ["a1" * 200, "a1" * 199 + "b1"]
    one = through(values, permute.shaped)
    other = through(values, permute.shaped, permute.key("t", "d", "K"))
    assert len(set(one.values()) | set(other.values())) == 4 and all(len(v) == 400 and v.islower() for v in one.values())


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def test_forms(spark):
    rng = random.Random(1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    cards = list({f"4{digits(3)} {digits(4)} {digits(4)} {digits(4)}" for _ in range(300)} | {f"4111 1111 111{i} 11{i}{j}" for i in range(10) for j in range(10)})
    made = through(cards, permute.card)
    assert len(set(made.values())) == len(cards) and all(v[:4] == k[:4] and len(v) == len(k) and v != k and (luhn(v) - luhn(k)) % 10 == 0 for k, v in made.items())
    phones = list({f"+1 ({rng.randrange(2, 10)}{digits(2)}) {rng.randrange(2, 10)}{digits(2)}-{digits(4)}" for _ in range(300)} | {f"+49 30 {digits(n)}" for n in (1, 2, 4, 8) for _ in range(40)})
    made = through(phones, permute.phone)
    assert len(set(made.values())) == len(phones) and all(k != v and len(k) == len(v) for k, v in made.items())
    assert all(v[4] in "23456789" and v[9] in "23456789" for k, v in made.items() if k.startswith("+1"))
    socials = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 2, 9999)] + ["666-12-1234", "000-00-0000"]
    made = through(socials, permute.ssn)
    fine = lambda v: 1 <= int(v[:3]) <= 899 and v[:3] != "666" and v[4:6] != "00" and v[7:] != "0000"
    assert len(set(made.values())) == len(socials) and all(fine(v) for k, v in made.items() if fine(k))
    addresses = [str(ipaddress.ip_address(rng.randrange(1 << 32))) for _ in range(800)]
    addresses = [a for a in set(addresses) if ipaddress.ip_address(a).is_global]
    made = through(addresses, permute.ipv4)
    assert len(set(made.values())) == len(addresses) and all(int(v.split(".")[0]) not in (0, 10, 127) and int(v.split(".")[0]) < 224 for v in made.values())
    accounts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    made = through(accounts, permute.iban)
    good = spark.createDataFrame([(v,) for v in made.values()], "v string").where(checks.iban(F.col("v"))).count()
    assert good == 3 and all(k[:2] == v[:2] and len(k) == len(v) for k, v in made.items())


def test_streams_and_batches_agree(spark, tmp_path):
    from veilspark.sources.scratch import Scratch

    rows = [("d", kind, f"{kind} {i}" if kind in ("PERSON", "EMPLOYER") else f"10{i:05d}") for kind in ("PERSON", "EMPLOYER", "RECORD_ID", "SECRET", "ID_NUMBER", "USERNAME") for i in range(400)]
    rows += [("d", "PERSON", "person  7"), ("d", "PERSON", "PERSON 7"), ("d", "RECORD_ID", "cus_1"), ("d", "RECORD_ID", "-"), ("d", "EMAIL_ADDRESS", "Info@x.org"), ("d", "EMAIL_ADDRESS", "info@y.org")]
    values = spark.createDataFrame(rows, "scope string, entity string, original string")
    whole = distinct.stand_ins(values, "s")
    one = {(r.entity, r.original): r.stand_in for r in whole.collect()}
    parts = [distinct.stand_ins(values.where(F.crc32(F.col("original").cast("binary")) % 3 == i), "s") for i in range(3)]
    assert one == {(r.entity, r.original): r.stand_in for p in parts for r in p.collect()}
    out = {(r.entity, r.original): r.stand_in for r in distinct.settled(distinct.met(whole), values, "s", Scratch(spark)).collect()}
    assert set(out) == set(one)
    originals = {o.lower() for _, _, o in rows}
    assert not {v.lower() for v in out.values()} & (originals - {"-"})
    same = {}
    for (kind, original), new in out.items():
        same.setdefault((kind, new.lower()), set()).add(" ".join(original.split()).lower())
    assert all(len(x) == 1 for x in same.values())


def test_equal_draws_are_told_apart(spark):
    rows = [("d", "PERSON", f"Name {i}", "Avery Bo") for i in range(4)] + [("d", "PERSON", "name 1", "AVERY BO")]
    out = distinct.met(spark.createDataFrame(rows, "scope string, entity string, original string, stand_in string")).collect()
    assert len({r.stand_in.lower() for r in out}) == 4 and len(out) == 5


def test_only_hashes_of_all_values_are_shuffled(spark, tmp_path):
    """What is written beside the stand-ins names the few values that met or clash, however many there are."""
    scratch = Scratch(spark)
    rows = [("d", "PERSON", f"Name {i}", "Avery Bo" if i < 3 else f"Other {i}") for i in range(500)]
    drawn = scratch.save(spark.createDataFrame(rows, "scope string, entity string, original string, stand_in string"), "drawn")
    apart = distinct.met(drawn, scratch)
    assert apart.select("stand_in").distinct().count() == 500
    read = lambda name: spark.read.parquet(f"{scratch.root}/{name}").count()
    assert (read("met-places"), read("met-told")) == (1, 2)
    taken = spark.createDataFrame([("d", "PERSON", "OTHER 7"), ("d", "PERSON", "Name 1")], "scope string, entity string, original string")
    out = distinct.settled(apart, taken, "s", scratch).select("stand_in").collect()
    assert len(out) == 500 and "other 7" not in {r.stand_in.lower() for r in out}
    assert read("both-0") == 1 and read("both-0-places") == 1
