"""Texts as they are read, with maps of places between what is read and what is written.

A text is read through layers, one after the other: formatting against letters goes, references of HTML and escapes of links become the characters that they stand for, characters
that do not show go. Each layer moves the places of the one before, so the composed map tells for every read character where it was written. A map is kept as pieces: characters
``[at[i], at[i + 1])`` of the reading come from ``[start[i], end[i])`` of the text, one for one where both are of one length, else as a whole. Places are found in it by bisection in both
directions. Offsets are code points. Texts without any sign of a layer are not read a second time: they have a null reading.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import links, scan

READING = "struct<text: string, at: array<int>, start: array<int>, end: array<int>>"
PLACE = "array<struct<start: int, end: int, raw: string>>"
# Characters that do not show, the mark between joined pieces, and the tags that format words.
HIDDEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
JOINT = "\u2063"
TAGS = "b i u s em strong mark span small sup sub del ins font code".split()

_TAG = rf"</?(?:{'|'.join(TAGS)})(?:\s[^<>]*)?>"
_STARS = r"\*{1,3}|~~"
_LETTER = r"\p{L}"
#: Formatting that touches a letter; a run of stars beside a digit is a mask and stays.
MARKUP = rf"(?i:(?<={_LETTER})(?:{_STARS})(?![0-9*~])|(?<![0-9*~])(?:{_STARS})(?={_LETTER})|(?<={_LETTER}){_TAG}|{_TAG}(?={_LETTER})|{JOINT})"
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_ESCAPES = r"(?:%[0-9A-Fa-f]{2})+"
_LINK = r"(?:://|\bwww\.)[^\s<>\"']+"
#: What a text must show for a layer to matter.
SIGNS = {"markup": rf"[*~<{JOINT}]", "references": _REFERENCE, "escapes": _ESCAPES, "hidden": f"[{HIDDEN}\u00a0]"}
#: All layers, in the order in which they are undone.
LAYERS = tuple(SIGNS)
#: What no reader of plain text sees.
SHOWN = ("markup", "hidden")

Edit = tuple[int, int, str]


def _markup(text: str) -> Iterator[Edit]:
    import regex

    return ((*m.span(), "") for m in regex.finditer(MARKUP, text))


def _references(text: str) -> Iterator[Edit]:
    """References to one character each; unknown ones stay as they are written."""
    import html

    import regex

    for m in regex.finditer(_REFERENCE, text):
        c = html.unescape(m[0])
        if len(c) == 1 and c != "\ufffd":
            yield *m.span(), c


def _escapes(text: str) -> Iterator[Edit]:
    """Escapes inside links, a character at a time; bytes that are not UTF-8 stay as they are written."""
    import regex

    for link in regex.finditer(_LINK, text):
        for m in regex.finditer(_ESCAPES, text, pos=link.start(), endpos=link.end()):
            try:
                shown = bytes.fromhex(m[0].replace("%", "")).decode()
            except UnicodeDecodeError:
                continue
            at = m.start()
            for c in shown:
                to = at + 3 * len(c.encode())
                yield at, to, c
                at = to


def _hidden(text: str) -> Iterator[Edit]:
    import regex

    return ((*m.span(), "") for m in regex.finditer(f"[{HIDDEN}]+", text))


_READ = {"markup": _markup, "references": _references, "escapes": _escapes, "hidden": _hidden}


def reading(text: str, layers: Sequence[str] = SHOWN) -> tuple[str, np.ndarray, np.ndarray, np.ndarray] | None:
    """(text as read, at, start, end), or None where it is read as it is written. ``at`` ends with the length of the reading."""
    seen, lo, hi = text, np.arange(len(text), dtype=np.int32), np.arange(1, len(text) + 1, dtype=np.int32)
    for layer in layers:
        parts, los, his, done = [], [], [], 0
        for a, b, new in _READ[layer](seen):
            parts += (seen[done:a], new)
            los += (lo[done:a], np.full(len(new), lo[a], np.int32))
            his += (hi[done:a], np.full(len(new), hi[b - 1], np.int32))
            done = b
        if done:
            seen = "".join((*parts, seen[done:]))
            lo, hi = np.concatenate((*los, lo[done:])), np.concatenate((*his, hi[done:]))
    if "hidden" in layers:
        seen = seen.replace("\u00a0", " ")
    if seen == text:
        return None
    if not seen:
        none = np.zeros(0, np.int32)
        return seen, np.zeros(1, np.int32), none, none
    whole = hi - lo != 1
    cut = np.ones(len(lo), bool)
    cut[1:] = whole[1:] | whole[:-1] | (lo[1:] != hi[:-1])
    first = np.flatnonzero(cut).astype(np.int32)
    at = np.append(first, np.int32(len(lo)))
    return seen, at, lo[first], hi[at[1:] - 1]


def written_places(at, start, end, begins, stops) -> tuple[np.ndarray, np.ndarray]:
    """Places in the text of spans of the reading (not empty); a piece that stands for its characters as a whole is taken whole."""
    at, start, end = (np.asarray(x, np.int64) for x in (at, start, end))
    begins, last = np.asarray(begins, np.int64), np.asarray(stops, np.int64) - 1
    even = end - start == np.diff(at)
    i, j = np.searchsorted(at[:-1], begins, "right") - 1, np.searchsorted(at[:-1], last, "right") - 1
    return np.where(even[i], start[i] + begins - at[i], start[i]), np.where(even[j], start[j] + last - at[j] + 1, end[j])


def read_places(at, start, end, places) -> np.ndarray:
    """Where places of the text stand in the reading; one that does not show stands where the next character does that shows."""
    at, start, end, places = (np.asarray(x, np.int64) for x in (at, start, end, places))
    if not len(start):
        return np.zeros(len(places), np.int64)
    i = np.searchsorted(start, places, "right") - 1
    even, k = end - start == np.diff(at), np.maximum(i, 0)
    inside = np.where(even[k], at[k] + places - start[k], at[k])
    return np.where(i < 0, 0, np.where(places >= end[k], at[k + 1], inside))


def _ints(rows: list) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows])
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def read(text: Column, layers: Sequence[str] = SHOWN) -> Column:
    """A text as it is read and the map of its places; null where that is how it is written, and for null texts."""
    layers = tuple(x for x in LAYERS if x in layers)

    def made(column: pa.Array) -> pa.Array:
        none = ("", *(np.zeros(0, np.int32),) * 3)
        each = [None if t is None else reading(t, layers) for t in column.to_pylist()]
        texts, *maps = zip(*(m or none for m in each))
        fields = [pa.array(texts, pa.string()), *map(_ints, map(list, maps))]
        return pa.StructArray.from_arrays(fields, names=["text", "at", "start", "end"], mask=pa.array([m is None for m in each], pa.bool_()))

    @F.arrow_udf(READING)
    def through(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield from (made(column[part]) for part in scan.portions(column))

    signs = "|".join(SIGNS[x] for x in layers)
    return through(F.when(text.rlike(signs), text)) if layers else F.lit(None).cast(READING)


def places(text: Column, seen: Column, spans: Column) -> Column:
    """The places in the text of spans (start, end) of its reading, and what is written there; without a reading they are those of the spans, and ``raw`` is null."""

    def placed(texts: pa.Array, maps: pa.Array, begins: pa.Array, stops: pa.Array) -> pa.Array:
        starts, ends, raw = [], [], []
        for t, m, b, s in zip(texts.to_pylist(), maps.to_pylist(), begins.to_pylist(), stops.to_pylist()):
            a, z = (b or [], s or []) if m is None or not b else written_places(m["at"], m["start"], m["end"], b, s)
            starts.append(np.asarray(a, np.int32))
            ends.append(np.asarray(z, np.int32))
            raw += [None if m is None else t[i:j] for i, j in zip(a, z)]
        starts, ends = _ints(starts), _ints(ends)
        return pa.ListArray.from_arrays(starts.offsets, pa.StructArray.from_arrays([starts.values, ends.values, pa.array(raw, pa.string())], names=["start", "end", "raw"]))

    @F.arrow_udf(PLACE)
    def back(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from (placed(*(c[part] for c in columns)) for part in scan.portions(columns[0]))

    there = seen.isNotNull()
    bare = F.when(there, F.struct(seen["at"].alias("at"), seen["start"].alias("start"), seen["end"].alias("end")))
    return back(F.when(there, text), bare, spans["start"], spans["end"])


def _marks(text: Column, pattern: str) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), "")


def _word(raw: Column, new: Column) -> Column:
    """One word's formatting around a new word: what stands before its first letter or digit, then all the rest."""
    mark = rf"(?i:{_TAG})|{_STARS}|{JOINT}"
    lead = F.regexp_extract(raw, rf"^(?:{mark}|[^\p{{L}}\p{{N}}<])*", 0)
    return F.concat(_marks(lead, mark), new, _marks(F.substring(raw, F.length(lead) + 1, F.length(raw)), MARKUP))


def written_like(new: Column, raw: Column, layers: Sequence[str] = SHOWN) -> Column:
    """A new value as ``raw`` was written: its formatting word for word where both have as many words, else after the value; escaped where it was; nothing hidden."""
    made = new
    if "references" in layers:
        escaped = F.replace(F.replace(F.replace(made, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        made = F.when(raw.rlike(_REFERENCE), escaped).otherwise(made)
    if "escapes" in layers:
        made = F.when(raw.rlike(_ESCAPES), links.encoded_like(new, raw)).otherwise(made)
    if "markup" not in layers:
        return made
    old, fresh = F.split(raw, "[ \u00a0](?![^<>]*>)"), F.split(made, " ")
    each = F.array_join(F.zip_with(old, fresh, _word), " ")
    return F.when(~raw.rlike(SIGNS["markup"]), made).when((F.size(old) == F.size(fresh)) & (F.size(old) > 1), each).otherwise(_word(raw, made))
