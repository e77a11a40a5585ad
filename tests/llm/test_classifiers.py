import random
import zlib

import numpy as np
import pytest

from veilspark.llm import quality, toxicity

NICE = "river stone morning garden letter window silver candle harbour meadow".split()
FOUL = "zorgul zorgath zorgish idiot".split()


def tables(spark, seed=1, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(NICE) + rng.choice(["", "s", "ly"]) for _ in range(rng.randrange(20, 80))]
        bad, junk = i % 5 == 0, i % 7 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(FOUL) + rng.choice(["", "a", "en"])
            words.append(rng.choice(FOUL))
        if junk:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(bad)))
    docs += [(9000, None), (9001, ""), (9002, " \n"), (None, "river stone"), (9003, "morning " * 30_000), (1, docs[1][1])]
    labels += [(None, 1, 0), (9000, None, None)]
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "threshold"), [(quality, "quality", 0.5), (toxicity, "toxic", 0.7)])
def test_learns_and_holds_out(spark, module, label, threshold):
    docs, labels = tables(spark)
    model = module.train(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == 406 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = {r.doc_id: r[label] for r in labels.collect() if r.doc_id is not None and r[label] is not None}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) >= 0.95
    again = module.train(docs.repartition(5), labels.repartition(3))
    assert [r.score for r in module.score(docs, again).collect()] == pytest.approx([r.score for r in got])


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_held_out_rows_do_not_matter(spark, module):
    docs, labels = tables(spark)
    name = "quality" if module is quality else "toxic"
    flipped = labels.selectExpr("doc_id", *(f"if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - {c}, {c}) as {c}" for c in ("quality", "toxic")))
    one, two = (sorted((str(r.doc_id), r.score) for r in module.score(docs, module.train(docs, x, name)).collect()) for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("module", [quality, toxicity])
def test_empty_tables(spark, module):
    docs, labels = tables(spark, n=20)
    model = module.train(docs, labels.limit(0))
    assert module.score(docs, model).count() == 26 and module.score(docs.limit(0), model).count() == 0


def test_additive_model_finds_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9 and {(f, g) for f, g, _ in model.pairs} >= {(0, 1)}


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    cast = np.stack([vote(0.9), vote(0.8), vote(0.75), *[vote(0.55)] * 3], axis=1)  # the last three are one voter's copies
    model = toxicity.fit_label_model(cast, 0.3)
    right = model.table[:, 2, 1]
    assert right[0] > right[1] > right[3] and model.weight[3] < 0.6 * model.weight[0]
    assert np.mean((model.posterior(cast) > 0.5) == y) > 0.88


def test_keep(spark):
    docs, labels = tables(spark)
    model = quality.train(docs, labels)
    kept, scored = quality.keep(docs, model), quality.score(docs, model).where("predicted = 1")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scored.collect())
