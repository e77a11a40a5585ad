import itertools

import pytest

from veilspark.llm import license


def test_finds_notices():
    text = "x y. Licensed under the Apache License, Version 2.0. foo This work is licensed under the GNU General Public License, \nversion 3. Released under the MIT Licence. All rights reserved."
    got = license.scan(text)
    assert [g[2] for g in got] == ["Apache-2.0-notice", "GPL-3.0-notice", "MIT-notice", "all-rights-reserved"]
    assert [text[a:b] for a, b, *_ in got][2] == "Released under the MIT Licence"


def test_finds_changed_texts_whole_and_only_once():
    words = license.TEMPLATES["MIT"].split()
    changed = " ".join(w for i, w in enumerate(words) if i % 13 != 5)
    got = license.scan("b " * 3000 + changed + " and more " * 20)
    assert [g[2] for g in got] == ["MIT"] and 0.85 < got[0][3] < 1


def test_clean_texts():
    assert license.scan("He asked for permission and reserved a table; the license plate was old.") == [] == license.scan("")


def longest(a, b):
    for k in range(min(len(a), len(b)), -1, -1):
        if any(tuple(b[j] for j in y) == x for x in set(itertools.combinations(a, k)) for y in itertools.combinations(range(len(b)), k)):
            return k


def test_alignment_is_common_and_ascending():
    import random

    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(8))] for _ in range(2))
        pairs = license.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(pairs) == longest(a, b)  # all words unique: the alignment is a longest one


def test_columns(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.", "x"), (1, None, "x"), (None, "", "y")], "doc_id long, text string, notices string")
    assert [(r.doc_id, [x.license for x in r.notices]) for r in license.licenses(docs).collect()] == [(1, ["all-rights-reserved"]), (1, []), (None, [])]


@pytest.mark.parametrize("times", [1, 2, 3])
@pytest.mark.parametrize("name", sorted(license.TEMPLATES))
def test_repeated_notices_are_all_found(name, times):
    notice = license.TEMPLATES[name]
    text = "some words before. " + f"{notice} " * times + "and some other words after"
    got = license.scan(text)
    assert [g[2:] for g in got] == [(name, 1.0)] * times
    assert all(license.words_of(text[a:b])[0][0] == license.templates()[name][0] for a, b, *_ in got)


BSD_TAIL = f"1. {license.BSD_SOURCE}. 2. {license.BSD_BINARY}. "


def test_members_of_a_family():
    for version, name in (("2", "GPL-2.0"), ("3", "GPL-3.0")):
        for mark in (";", ","):
            text = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."
            assert [g[2] for g in license.scan("x " * 50 + text + " y" * 50)] == [name]
    lesser = license.TEMPLATES["LGPL-2.1"]
    assert [g[2] for g in license.scan(lesser)] == ["LGPL-2.1"] and [g[2] for g in license.scan(lesser.replace("2.1", "3"))] == ["LGPL-3.0"] and [g[2] for g in license.scan(license.TEMPLATES["AGPL-3.0"])] == ["AGPL-3.0"]
    assert [g[2] for g in license.scan("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0. Licensed under CC BY-ND 4.0.")] == ["CC-BY-NC-4.0-notice", "CC-BY-4.0-notice"]


def test_bsd_goes_by_its_conditions():
    opening = license.TEMPLATES["BSD"] + ": "
    two, three = opening + BSD_TAIL, opening + BSD_TAIL + f"3. {license.BSD_NAMES}."
    for text, name in ((opening, "BSD"), (two, "BSD-2-Clause"), (three, "BSD-3-Clause")):
        got = license.scan("foo bar " * 20 + text + " THIS SOFTWARE IS PROVIDED" * 3)
        assert [g[2] for g in got] == [name]
    both = license.scan(two + " end of it " * 60 + three)
    assert [g[2] for g in both] == ["BSD-2-Clause", "BSD-3-Clause"]
    assert three[: license.scan(three)[0][1]].rstrip(".").endswith("written permission")


def test_many_notices_take_time_in_proportion():
    import time

    took = []
    for n in (1000, 4000):
        text = "Released under the MIT License. Some other words stand here between. " * n
        began = time.perf_counter()
        assert len(license.scan(text)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_whole_scan_against_brute_force():
    """Exact copies of templates among other words: the stretches are those where the words stand."""
    import random

    rng = random.Random(4)
    names = [n for n in license.TEMPLATES if n not in ("BSD", "Apache-2.0", "MIT", "ISC", "MPL-2.0")]
    filler = ["alpha", "beta", "gamma", "version", "the", "of", "license"]
    for _ in range(60):
        words, want = [], []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(filler) for _ in range(rng.randrange(30, 60))]
            name = rng.choice(names)
            template = license.templates()[name]
            want.append((name, len(words), len(words) + len(template) - 1))
            words += template
        words += [rng.choice(filler) for _ in range(40)]
        text, at = " ".join(words), [0]
        for w in words:
            at.append(at[-1] + len(w) + 1)
        got = license.scan(text)
        assert [g[2] for g in got] == [n for n, _, _ in want]
        assert all(g[0] <= at[a] + 1 and g[1] >= at[b] and g[3] == 1 for g, (_, a, b) in zip(got, want))


def test_empty_table(spark):
    assert license.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
