import random

import pytest

from veilspark.llm import pii


def shown(text):
    return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, text.encode())]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("é jane at mail dot example dot com.", "email", "jane at mail dot example dot com"),
        ("call plus one four one five five five five one two three four ok", "phone", "plus one four one five five five five one two three four"),
        ("x jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("ip one two seven dot zero dot zero dot one", "ip", "one two seven dot zero dot zero dot one"),
        ("jo​hn@example.com", "email", "jo​hn@example.com"),
    ],
)
def test_disguises(text, kind, span):
    assert (kind, span) in shown(text)


def test_plain_rules():
    text = "a.b@c-d.org 10.0.0.3 10.0.0.300, 4111 1111 1111 1111, 4111-1111-1111-1112 or +1 (458) 555-2333"
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.plain(text)] == [("email", "a.b@c-d.org"), ("ip", "10.0.0.3"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (458) 555-2333")]


def test_clean_text_stays():
    text = "One of the three at home. Two dots, nine lives and a point."
    assert shown(text) == [] and pii.masked(text, text.encode()) == text


def test_find_and_mask(spark):
    rows = [(1, "mail a@b.co", "k"), (1, "mail a@b.co", None), (2, None, "k"), (3, "", "k"), (None, "b" * 200_000 + " a (at) b.com", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, tuple(tuple(x) for x in r.spans)) for r in pii.find(docs).collect()}
    assert got == {(1, (("email", 5, 11),)), (2, ()), (3, ()), (None, (("email", 200_001, 200_013),))}
    assert [r.text for r in pii.mask(docs).collect()][:3] == ["mail <EMAIL>", "mail <EMAIL>", None]
    assert pii.find(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("call plus 49 30 12345678", "phone", "plus 49 30 12345678"),
        ("4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
        ("max klammeraffe mail.example.de", "email", "max klammeraffe mail.example.de"),
        ("max\nat\nexample.com", "email", "max\nat\nexample.com"),
        ("max ät example.com", "email", "max ät example.com"),
        ("10.0.0.² or so", "ip", "10.0.0.²"),
        ("10.0.0.f\u0131ve", "ip", "10.0.0.f\u0131ve"),
    ],
)
def test_disguises_do_not_depend_on_other_characters(text, kind, span):
    assert (kind, span) in shown(text)
    assert (kind, span) in shown(text + " – ") and (kind, span) in shown("(at) " + text)


def test_gate_loses_nothing():
    rng = random.Random(6)
    words = [*pii._DIGITS, *"plus PLUS Plus at AT arroba arobase ät klammeraffe dot punkt punto point po\u0131nt F\u0130VE 4 49 30 12345678 4111 1111 111 10 127 1. .1 max example example.com mail. @ . ( ) [ ] < > { } . ² ﹢ ａ \u200b".split()]
    hidden = 0
    for _ in range(30_000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "", ".", "\n", "-", "  "]) for _ in range(rng.randrange(1, 9)))
        text = rng.choice([text, text.upper(), text.title()])
        want = pii.rewritten(text)
        assert pii.disguised(text, text.encode()) == want, text
        hidden += bool(want)
    assert hidden > 100


def test_parts_of_many_zeros():
    text = "0" * 5000 + ".1.0.00255 and 1.1.1.256"
    assert pii.plain(text) == [(0, 1, 5010)]
