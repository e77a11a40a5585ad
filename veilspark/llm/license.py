"""License notices in texts, by patience alignment against templates.

Words that stand once in a text's passage and once in a template anchor the alignment; the longest increasing subsequence of the anchors is kept,
common words next to anchors extend it, and the gaps between anchors are aligned in the same way. A template's coverage is the
share of its words that are aligned. Passages are taken around a few words of which every template has
one, as wide as the template, over the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import rows_of, texts

COVERAGE = 0.8

# Notices and openings of public licences.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
# Words, in a row, without which a notice of one family is not that member of it.
DECIDING = {
    "GPL-3.0": ("gnu general public", "version 3"), "GPL-3.0-notice": ("gnu general public", "version 3"), "GPL-2.0": ("gnu general public", "version 2"), "GPL-2.0-notice": ("gnu general public", "version 2"),
    "LGPL-2.1": ("lesser", "version 2.1"), "LGPL-3.0": ("lesser", "version 3"), "AGPL-3.0": ("affero", "version 3"),
    "CC-BY-NC-4.0-notice": ("cc by-nc 4.0",), "CC-BY-4.0-notice": ("cc by 4.0",), "CC-BY-SA-4.0-notice": ("cc by-sa 4.0",),
}
# The conditions that follow the opening of a BSD licence.
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
#: Words after the opening in which its conditions stand.
CONDITIONS = 160
_WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: Each template has one of these words, and passages are taken around them.
TRIGGERS = frozenset(("license", "licensed", "licenses", "permission", "redistribution", "redistribute", "reserved"))
_TRIGGER = re.compile(r"(?i)licen[cs]e|permission|redistribut|reserved")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(folded word, start, end) in order."""
    return [(m[0].casefold().replace("licence", "license"), m.start(), m.end()) for m in _WORD.finditer(text)]


@lru_cache(maxsize=1)
def templates() -> dict[str, list[str]]:
    return {name: [w for w, _, _ in words_of(text)] for name, text in TEMPLATES.items()}


def _longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
        back[i] = piles[k - 1] if k else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of equal words of ``a`` and ``b``, ascending in both."""
    pairs: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in place]
        chain = [anchors[k] for k in _longest_increasing([j for _, j in anchors])]
        pairs += chain
        if chain:
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            work += [(i + 1, x, j + 1, y) for (i, j), (x, y) in zip(edges, edges[1:])]
    return sorted(pairs)


def _dense(pairs: list[tuple[int, int]], size: int) -> tuple[float, int, int]:
    """(coverage, first word, last word) of the densest stretch of the pairs that is no longer than a template of ``size`` words allows."""
    span = size + max(2, size // 4)
    first, best = 0, (0, 0, 0)
    for k in range(len(pairs)):
        while pairs[k][0] - pairs[first][0] >= span:
            first += 1
        best = max(best, (k - first + 1, -first, k), key=lambda x: (x[0], x[1]))
    return best[0] / size, pairs[-best[1]][0], pairs[best[2]][0]


def _around(words: list[str], template: list[str], at: int) -> Iterator[tuple[float, int, int]]:
    """(coverage, first word, last word) of a template in the words around the trigger ``at``.

    Once in a window wide enough for any place of the trigger, then with the trigger held to each of its own places in the template, where
    the words next to it extend the alignment, so that another copy near by does not matter.
    """
    size = len(template)
    lo = max(0, at - size - 3)
    pairs = align(words[lo : at + size + 4], template)
    if pairs:  # words far from the bulk are chance
        yield _dense([(lo + i, j) for i, j in pairs], size)
    for j in (j for j, w in enumerate(template) if w == words[at]):
        for slack in (0, max(3, size // 4)):
            lo = max(0, at - j - slack)
            left = [(lo + x, y) for x, y in align(words[lo:at], template[:j])]
            right = [(at + 1 + x, j + 1 + y) for x, y in align(words[at + 1 : at + size - j + slack], template[j + 1 :])]
            yield _dense([*left, (at, j), *right], size)


@lru_cache(maxsize=1)
def _conditions() -> list[list[str]]:
    return [[w for w, _, _ in words_of(text)] for text in (BSD_SOURCE, BSD_BINARY, BSD_NAMES)]


def _member(name: str, words: list[str], first: int, last: int) -> tuple[str, int] | None:
    """(template, last word) of an aligned stretch once its deciding words are read; none if they are missing. The opening of a BSD licence goes by the conditions after it."""
    stretch = " " + " ".join(words[first : last + 1]) + " "
    if not all(f" {x} " in stretch for x in DECIDING.get(name, ())):
        return None
    if name != "BSD":
        return name, last
    after = words[last + 1 : last + 1 + CONDITIONS]
    met = [_dense(pairs, len(c)) if (pairs := align(after, c)) else (0, 0, 0) for c in _conditions()]
    held = [share >= COVERAGE for share, _, _ in met]
    if not held[0] or not held[1]:
        return name, last
    return ("BSD-3-Clause" if held[2] else "BSD-2-Clause"), last + 1 + max(end for (_, _, end), h in zip(met, held) if h)


def scan(text: str, coverage: float = COVERAGE) -> list[tuple[int, int, str, float]]:
    """(start, end, template, coverage) of the notices in a text, in order and without overlap; the one with most aligned words wins.

    Members of a family (GPL 2 and 3, the Creative Commons licences) are told by their deciding words, those of BSD by the conditions that follow the opening.
    """
    if not _TRIGGER.search(text):
        return []
    found = words_of(text)
    folded = [w for w, _, _ in found]
    hits = {}
    for at in (i for i, w in enumerate(folded) if w in TRIGGERS):
        for name, template in templates().items():
            if folded[at] in template:
                for share, first, last in _around(folded, template, at):
                    if share >= coverage and share >= hits.get((name, first, last), 0):
                        hits[name, first, last] = share
    out: list[tuple[int, int, str, float]] = []
    order = sorted(hits.items(), key=lambda x: (-x[1] * len(templates()[x[0][0]]), -x[1], x[0][2] - x[0][1], x[0][1], x[0][0]))
    starts, ends = [], []  # of what is taken: disjoint, so both ascend together
    for (name, first, last), share in order:
        k = bisect_left(ends, first)
        if k < len(starts) and starts[k] <= last:
            continue
        told = _member(name, folded, first, last)
        if told is None:
            continue
        end = max(last, min(told[1], starts[k] - 1) if k < len(starts) else told[1])
        starts.insert(k, first)
        ends.insert(k, end)
        out.append((found[first][1], found[end][2], told[0], round(share, 4)))
    return sorted(out)


_STRUCT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("coverage", pa.float64())]))


def licenses(docs: DataFrame, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, notices (array of start, end in code points, license, coverage), in order.

    Null and empty texts have none. Ids and rows may repeat; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in rows_of(batches):
            rows = [[{"start": a, "end": b, "license": n, "coverage": c} for a, b, n, c in scan(t.decode("utf-8", "replace"), coverage)] for t in chunk]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, _STRUCT)], names=["doc_id", "notices"])

    return texts(docs, text, doc_id).mapInArrow(run, "doc_id long, notices array<struct<start: int, end: int, license: string, coverage: double>>")
