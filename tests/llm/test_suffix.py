import random

import numpy as np
import pytest

from veilspark.llm import suffix


def brute(rows, length, keep_first):
    """The bytes that stay, by looking every string up; in order of (id, position), null ids first, and of equal rows one is judged."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    data = [(t or "").encode() for _, t in rows]
    places: dict[bytes, list] = {}
    for i in order:
        for p in range(len(data[i]) - length + 1):
            places.setdefault(data[i][p : p + length], []).append((i, p))
    out = []
    for i, text in enumerate(data):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            met = places[text[p : p + length]]
            if (met[0] != (i, p)) if keep_first else len(met) > 1:
                gone[p : p + length] = True
        out.append(gone)
    return data, out


def corpus(rng, alphabet="abcdefghij é"):
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(rng.randrange(30, 160)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [word(rng.randrange(50))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a:] if rng.random() < 0.3 else p, word(rng.randrange(60))]
        rows.append((i, "".join(parts)))
    rows += [(200, "xy " * 60 + "tail"), (201, "head" + "xy " * 40), (100, "x" * 300), (101, "ab" * 200), (102, rows[3][1]), (103, rows[3][1]), (104, None), (105, ""), (106, passages[0])]
    rng.shuffle(rows)
    return rows


def spans_of(gone):
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def test_all_copies_go(spark):
    rows = corpus(random.Random(4))
    got = suffix.remove_repeats(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, digest string"), 40).collect()
    data, gone = brute(rows, 40, False)
    want = {i: (len(d), spans_of(g), bytes(np.frombuffer(d, np.uint8)[~g])) for (i, _), d, g in zip(rows, data, gone)}
    assert {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got} == want


def test_first_copy_stays(spark):
    rows = corpus(random.Random(9), "abcdefghij ")
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, keep_first=True).collect()
    data, gone = brute(rows, 40, True)
    want = {i: bytes(np.frombuffer(d, np.uint8)[~g]) for (i, _), d, g in zip(rows, data, gone)}
    assert {r.doc_id: bytes(r.kept) for r in got} == want


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 100)
    rows = corpus(random.Random(5))
    (_, h, first, last), (_, h2, first2, last2) = (_flat(rows, 40), (monkeypatch.setattr(suffix, "PIECE", 1 << 22), _flat(rows, 40))[1])
    covered = lambda a, b: sorted(x for s, e in zip(a, b) for x in range(s, e + 1))
    assert covered(first, last) == covered(first2, last2)


def _flat(rows, length):
    run = suffix._runs(length)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([(t or "").encode() for _, t in rows]), pa.array([b""] * len(rows))], names=["doc_id", "text", "digest"])
    runs = []
    for out in run([batch]):
        for i, blocks, own in zip(*(out.column(c).to_pylist() for c in ("doc_id", "blocks", "own"))):
            runs += [(i, r["h"], r["s"], r["e"]) for b in blocks for r in b["runs"]] + [(i, 0, r["s"], r["e"]) for r in own]
    return tuple(zip(*[(i * 10**6, h, i * 10**6 + s, i * 10**6 + e) for i, h, s, e in runs]))


def test_deduplicate_keeps_columns_and_characters(spark):
    passage = " ".join(f"é{i}ß" for i in range(40))
    rows = [(2, f"one {passage} end", "l"), (1, f"two {passage}", None), (3, None, "l"), (3, None, "l")]
    got = {(r.doc_id, r.digest): r.text for r in suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, digest string"), 100).collect()}
    assert got == {(1, None): f"two {passage}", (2, "l"): "one end", (3, "l"): None}


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_previous_factors_by_brute_force():
    rng = random.Random(3)
    segments = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    for length in (1, 2, 5, 9, 12):
        number, offset, earlier, later = suffix.previous_factors(segments, length)
        starts = [segments[i][o : o + length] for i, o in zip(number, offset)]
        assert len(starts) == sum(max(0, len(s) - length + 1) for s in segments)
        common = lambda x, y: next((i for i in range(length) if x[i] != y[i]), length)
        for k, x in enumerate(starts):
            assert earlier[k] == max((common(x, y) for y in starts[:k]), default=0)
            assert later[k] == max((common(x, y) for y in starts[k + 1 :]), default=0)


def test_no_start_is_long_enough():
    assert [len(x) for x in suffix.previous_factors([b"abc", b""], 5)] == [0, 0, 0, 0]


def test_passages_and_repeats_by_brute_force(spark):
    rows = corpus(random.Random(21)) + [(107, "é" * 15 + "q" * 20), (108, "é" * 15 + "q" * 20), (109, "0123456789" * 3), (110, "0123456789" * 3)]
    got = suffix.passages_and_repeats(spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, digest string, n int"), 60, 25).collect()
    data, gone = brute(rows, 60, False)
    _, shorter = brute(rows, 25, False)
    want = {i: (len(d), spans_of(g), bytes(np.frombuffer(d, np.uint8)[~g]), spans_of(s)) for (i, _), d, g, s in zip(rows, data, gone, shorter)}
    pairs = lambda spans: [(s.start, s.end) for s in spans or ()]
    assert {r.doc_id: (r.n_bytes, pairs(r.spans), bytes(r.kept), pairs(r.passages)) for r in got} == want
    assert suffix.passages_and_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_rows_that_repeat_an_id(spark):
    rows = [(1, "p" * 50 + "tail"), (1, "p" * 50 + "tail"), (None, "zz"), (2, None), (3, "x" + "abcdefgh" * 4 + "y"), (4, "w" + "abcdefgh" * 4 + "v")]
    got = suffix.passages_and_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 20).collect()
    assert sorted((str(r.doc_id), len(r.kept), len(r.passages or ())) for r in got) == [("1", 0, 1), ("1", 0, 1), ("2", 0, 0), ("3", 34, 1), ("4", 34, 1), ("None", 2, 0)]


@pytest.mark.parametrize("keep_first", [False, True])
def test_hot_anchors_by_brute_force(spark, monkeypatch, keep_first):
    monkeypatch.setattr(suffix, "HOT", 1)
    rows = corpus(random.Random(11), "abcdefghij ")
    passage = "".join(random.Random(12).choice("klmnop") for _ in range(150))
    rows += [(300 + i, f"{i * 7919:09d}{passage}{i * 104729:09d}") for i in range(40)] + [(300, f"{0:09d}{passage}{0:09d}")] * 2
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, keep_first=keep_first).collect()
    data, gone = brute(rows, 40, keep_first)
    want = {}
    for (i, _), d, g in zip(rows, data, gone):
        want.setdefault(i, bytes(np.frombuffer(d, np.uint8)[~g]))  # of equal rows the first is judged
    assert {r.doc_id: bytes(r.kept) for r in got} == want


def test_no_task_takes_all_of_a_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 8)
    passage = "".join(random.Random(13).choice("klmnop") for _ in range(150))
    rows = [(i, f"{i * 7919:040d}{passage}{i * 104729:040d}") for i in range(60)]
    wide = []
    monkeypatch.setattr(suffix, "_hot", lambda cut, *rest, hot=suffix._hot: wide.append(cut.count()) or hot(cut, *rest))
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, keep_first=True).collect()
    data, gone = brute(rows, 40, True)
    assert {r.doc_id: bytes(r.kept) for r in got} == {i: bytes(np.frombuffer(d, np.uint8)[~g]) for (i, _), d, g in zip(rows, data, gone)}
    assert wide and wide[0] >= 60
