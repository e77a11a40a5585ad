"""One vectorised pass over texts: the matches of many patterns, and folded n-grams of words.

Native columns would search a text up to three times for each pattern and build arrays element by element. Here a batch of texts goes through all
patterns at once; validation, scoring and everything after stay native columns over the few matches. Offsets are code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keys

MATCH = "array<struct<pattern: int, start: int, end: int, value: string, near: array<string>>>"
GRAM = "array<struct<start: int, end: int, value: string, folded: string>>"
#: Words before a match are looked for in so many characters.
WINDOW = 100
#: How many words, nearest first.
WORDS = 8
#: A batch is searched in portions of so many texts and bytes, so that what Python holds does not depend on the batch.
ROWS, BYTES = 512, 1 << 21
WORD = r"[\p{L}\p{N}]+(?:['’_.@+-]+[\p{L}\p{N}]+)*"


def portable(pattern: str) -> str:
    """A pattern with ASCII digits, as the JVM reads ``\\d``."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\d":
            out.append("0-9" if inside else "[0-9]")
            i += 2
            continue
        if two[:1] == "\\":
            out.append(two)
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return "".join(out)


def portions(column: pa.Array) -> Iterator[slice]:
    """Slices of a column of texts, of ``ROWS`` texts and ``BYTES`` bytes at most, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        to = max(at + 1, min(to, at + ROWS))
        yield slice(at, to)
        at = to


@lru_cache(maxsize=64)
def _compiled(patterns: tuple[tuple[str, str | None, bool], ...]):
    import regex

    return [(i, regex.compile(portable(p)), None if need is None else regex.compile(portable(need)), near) for i, (p, need, near) in enumerate(patterns)], regex.compile(r"\p{L}[\p{L}\p{M}]*")


def matches(text: Column, patterns: Sequence[tuple[str, str | None, bool]]) -> Column:
    """All matches of ``patterns`` (pattern, a cheaper one that each of its texts has, whether words before matter), by pattern, then place.

    ``near`` holds the last ``WORDS`` words within ``WINDOW`` characters before a match, lower-cased, nearest first. Null texts have none.
    """
    patterns = tuple(patterns)

    def found(column: pa.Array) -> pa.Array:
        compiled, word = _compiled(patterns)
        ends, fields = [0], ([], [], [], [], [])
        for t in column.to_pylist():
            if t:
                for i, pattern, need, near in compiled:
                    if need is not None and not need.search(t):
                        continue
                    for m in pattern.finditer(t):
                        a, b = m.span()
                        words = [w.lower() for w in word.findall(t, max(0, a - WINDOW), a)[: -WORDS - 1 : -1]] if near else []
                        for field, x in zip(fields, (i, a, b, m[0], words)):
                            field.append(x)
            ends.append(len(fields[0]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
        rows = pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds)], names=["pattern", "start", "end", "value", "near"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    @F.arrow_udf(MATCH)
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield from (found(column[part]) for part in portions(column))

    return search(text)


_FOLD = str.maketrans(keys._PLAIN | {"ß": "ss"})


def fold(text: str) -> str:
    """As ``keys.plain``."""
    return text.translate(_FOLD).lower()


def ngrams(text: Column, sizes: Sequence[int], firsts: Iterable[str] | None = None) -> Column:
    """The stretches of ``sizes`` words of a text, folded, with one space between their words; only those that open with one of ``firsts``, if given. Null texts have none."""
    sizes, firsts = tuple(sorted(sizes)), None if firsts is None else frozenset(firsts)

    def grams(column: pa.Array) -> pa.Array:
        import regex

        word = regex.compile(WORD)
        ends, starts, stops, values, folded = [0], [], [], [], []
        for t in column.to_pylist():
            found = [(m.start(), m.end(), fold(m[0])) for m in word.finditer(t)] if t else []
            for n in sizes:
                for i in range(len(found) - n + 1):
                    if firsts is not None and found[i][2] not in firsts:
                        continue
                    a, b = found[i][0], found[i + n - 1][1]
                    starts.append(a)
                    stops.append(b)
                    values.append(t[a:b])
                    folded.append(found[i][2] if n == 1 else " ".join([x[2] for x in found[i : i + n]]))
            ends.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(values, pa.string()), pa.array(folded, pa.string())], names=["start", "end", "value", "folded"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    @F.arrow_udf(GRAM)
    def cut(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield from (grams(column[part]) for part in portions(column))

    return cut(text)
