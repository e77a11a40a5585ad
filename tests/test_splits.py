import json
import random

import pytest

from veilspark.sources import csvsource, splits


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def told(df):
    return [r.cells for r in sorted(df.collect(), key=lambda r: (r.path, r.row))], sorted((r.path, r.row) for r in df.select("path", "row").collect())


def test_csv_by_ranges_equals_whole(spark, small_ranges, tmp_path):
    rng = random.Random(7)
    cells = ["a", "", 'say "hi"', "one\ntwo", 'x,"y"\n\n,z', "é😀", "\r\n in", "5\" pipe", " ", '"', '""', "long\n" * 400, "w" * 1500]
    rows = [[rng.choice(cells[:11] if rng.random() < 0.97 else cells) for _ in range(rng.randrange(1, 5))] for _ in range(900)]
    text = csvsource.written(rows, ",", '"', "\r\n") + 'un"quoted,"closed"tail\nlast,no line end'
    (tmp_path / "a.csv").write_text(text, newline="")
    want = csvsource.parse(text)
    got = splits.csv_rows(spark, str(tmp_path / "a.csv"), ",", '"')
    assert splits.lines(spark, str(tmp_path / "a.csv")).select("block").distinct().count() > 20
    found, places = told(got)
    assert found == want and [r for _, r in places] == list(range(len(want)))


def test_one_record_over_many_ranges(spark, small_ranges, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"' + "line\n" * 3000 + '"\n2,b\n')
    found, _ = told(splits.csv_rows(spark, str(tmp_path / "a.csv"), ",", '"'))
    assert found == [["k", "v"], ["1", "line\n" * 3000], ["2", "b"]]


def test_open_quotes_blank_lines_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿k;v\n\n1;"x\ny"\n')
    (tmp_path / "b.csv").write_text('k;v\n1;"never closed\n2;z\n')
    (tmp_path / "c.csv").write_text("")
    found, _ = told(splits.csv_rows(spark, str(tmp_path), ";", '"'))
    assert found == [["k", "v"], [""], ["1", "x\ny"], ["k", "v"], None]
    leaves = splits.csv_leaves(spark, str(tmp_path), ";", '"').orderBy("doc_id", "leaf_id").collect()
    assert [(r.key, r.text, r.kind, r.record_ids) for r in leaves] == [("k", "", "value", [0]), ("k", "1", "value", [1]), ("v", "x\ny", "value", [1]), ("", "", "problem", [0])]


def test_states_compose(spark, tmp_path):
    rows = [("p", 10 * i, a, b) for i, (a, b) in enumerate([(False, True), (True, False), (True, False), (True, True), (False, True), (True, False), (False, False), (False, True)])]
    want, state = [], False
    for _, _, a, b in rows:
        want.append(state)
        state = b if state else a
    # ranges whose lines have just those maps
    text = {(False, True): "x", (True, False): 'a,"b', (True, True): '"a","', (False, False): 'a"'}
    lines = spark.createDataFrame([(p, k, i, text[a, b]) for i, (p, k, a, b) in enumerate(rows)], "path string, block long, at long, value string")
    for (a, b), t in text.items():
        assert (splits.ends_inside(t, False, ",", '"'), splits.ends_inside(t, True, ",", '"')) == (a, b), t
    assert [r.inside for r in splits.csv_states(lines.repartition(3, "block"), ",", '"').orderBy("block").collect()] == want


def test_json_lines_by_ranges(spark, small_ranges, tmp_path):
    rows = [{"id": i, "name": f"n {i}", "x": {"y": [i, "z"]}} for i in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n{bad\n")
    found = splits.json_lines(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r.text for r in found.where("key = 'name' and kind = 'value'").collect()) == sorted(r["name"] for r in rows)
    assert found.where("kind <> 'problem'").select("doc_id").distinct().count() == 300 and found.where("kind = 'problem'").count() == 1
