import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from veilspark.llm import bpe

RANKS = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(1)
    fixed = ["", "a" * 700, "ab" * 400, "!" * 333, " " * 90 + "x", "日本語テスト" * 40, "\n\n\t x  y", "<|endoftext|>", "aab" * 50, "the" * 60, "it's we'll I'M", "é ñ ß 😀" * 9]
    return fixed + ["".join(rng.choice("abcdeiost 01.'\n") for _ in range(rng.randrange(2000))) for _ in range(20)] + ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(500))]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def test_ids_are_the_tokenizers(encoder):
    made = list(encoder.encode(texts()))
    for text, ids in zip(texts(), made):
        assert ids.tolist() == THEIRS.encode_ordinary(text)
    assert encoder.decode(pa.array([x.tolist() for x in made], pa.list_(pa.int32()))).to_pylist() == [t.encode() for t in texts()]


def test_both_queries_agree(encoder):
    words = [w.encode() for t in texts() for w in THEIRS._pat_str and encoder.pattern.findall(t)]
    words = sorted({w for w in words if len(w) <= 40}, key=len)
    assert list(encoder._encode(words, bpe.MERGE)) == list(encoder._encode(words, bpe.MERGE_LONG))


def test_small_vocabulary_where_order_matters():
    """Merges whose result has a lower rank than its parts: the leftmost lowest pair goes first at every step."""
    ranks = {bytes([i]): i + 100 for i in range(256)} | {b"bc": 5, b"ab": 20, b"abc": 1, b"cd": 30, b"abcd": 40, b"aa": 50, b"aaa": 2}
    ours, theirs = bpe.Encoder(ranks, r".+"), tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    words = [w for w in words if w.encode() not in ranks]
    assert [ids.tolist() for ids in ours.encode(words)] == [theirs.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("query", [bpe.MERGE, bpe.MERGE_LONG])
def test_pairs_made_in_one_step(query):
    """What two contractions of one step make together may have a lower rank than the pair itself."""
    base = {bytes([i]): i + 100 for i in range(256)}
    rng = random.Random(6)
    vocabularies = [base | {b"ab": 50, b"abab": 3, b"ababa": 2, b"ba": 60, b"aba": 70}]
    for _ in range(25):  # pieces joined at random, ranks shuffled, so that inversions of all kinds come up
        tokens = [b"a", b"b", b"c"]
        for _ in range(12):
            tokens.append(rng.choice(tokens) + rng.choice(tokens))
        more = sorted({t for t in tokens if 1 < len(t) < 9})
        vocabularies.append(base | dict(zip(more, rng.sample(range(99), len(more)))))
    for ranks in vocabularies:
        ours, theirs = bpe.Encoder(ranks, r".+"), tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
        words = ["ab" * n for n in (1, 10, 33, 34, 40, 50)] + ["a" * n for n in (2, 3, 70, 71)] + ["".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 90))) for _ in range(25)]
        words = [w for w in words if w.encode() not in ranks]
        got = [np.frombuffer(x, np.int32).tolist() for x in ours._encode([w.encode() for w in words], query)]
        assert got == [theirs.encode_ordinary(w) for w in words]


def test_generations_of_known_words(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    for _ in range(3):
        for text in texts()[-8:]:
            assert [i.tolist() for i in encoder.encode([text])] == [THEIRS.encode_ordinary(text)]


def test_columns(spark):
    docs = spark.createDataFrame([(1, "hello world", 7), (1, "hello world", 8), (2, None, 9), (None, "x " * 30_000, 1)], "doc_id long, text string, ids int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True).collect()
    assert [list(r.ids) for r in got] == [THEIRS.encode_ordinary(t) for t in ("hello world", "hello world", "", "x " * 30_000)]
    assert bytes(got[3].decoded) == b"x " * 30_000
    ids = spark.createDataFrame([(1, list(got[0].ids)), (2, []), (3, None), (4, [None, 10**6]), (1, list(got[3].ids))], "doc_id long, ids array<int>")
    assert [(r.doc_id, None if r.decoded is None else bytes(r.decoded)) for r in bpe.decode(ids, path).collect()] == [(1, b"hello world"), (2, b""), (3, None), (4, b""), (1, b"x " * 30_000)]
    assert bpe.encode(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
