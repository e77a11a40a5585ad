"""Planted passages of a little over fifty words that repeat across documents: how many are caught, and how many clean documents are left alone."""

import random

import pytest

import corpus_pipeline
from veilspark.llm import queries

LETTERS = "etaoinshrdlu"


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, planted = [], {}
    for i in range(400):
        docs.append(words(rng.randrange(40, 400)))
    ids = list(range(400))
    rng.shuffle(ids)
    while len(ids) > 200:  # half of the documents stay clean
        passage = words(rng.randrange(51, 60))
        for i in [ids.pop() for _ in range(rng.randrange(2, 6))]:
            at = rng.randrange(len(docs[i]))
            docs[i][at:at] = passage
            planted[i] = passage
    return [(i, " ".join(d), "en", f"s{i % 3}", len(" ".join(d))) for i, d in enumerate(docs)], planted


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, planted = corpus(3)
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, rows, planted


def test_the_query_tells_them(spark, made):
    path, rows, planted = made
    got = {r.doc_id: r.n_passages for r in queries.op2_suffix_array(spark, path).collect()}
    long_enough = [i for i, p in planted.items() if len(" ".join(p)) >= 250]
    assert len(long_enough) > 0.9 * len(planted)
    assert sum(got[i] > 0 for i in long_enough) == len(long_enough)
    clean = [i for i, *_ in rows if i not in planted]
    assert sum(got[i] == 0 for i in clean) == len(clean)


def test_the_stage_removes_later_copies(spark, made):
    path, rows, planted = made
    out = {r.doc_id: r.text for r in corpus_pipeline.unrepeated(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    before, seen, caught, all_later = {i: t for i, t, *_ in rows}, set(), 0, 0
    for i in sorted(planted):
        passage = " ".join(planted[i])
        if passage in seen and len(passage) >= 250:
            all_later += 1
            caught += passage not in out[i] and len(out[i]) <= len(before[i]) - 240
        seen.add(passage)
    assert all_later > 80 and caught == all_later
    assert all(out[i] == before[i] for i, *_ in rows if i not in planted)
