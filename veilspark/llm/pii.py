"""Personal data in texts, also where it is disguised, with spans in the source's own characters.

Plain identifiers are found in the text as it is. Then three transducers rewrite it, each keeping for every character the source span that
it came from: look-alike letters and invisible characters; ``at`` and ``dot`` disguises; digits written as words. The
same patterns run over what they give, and a match that any rewriting touched is mapped back to the source.
Texts that cannot hold a disguise are told by cheap tests and skip this.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import rows_of, texts, tidy

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that fails at the start of a run of digits fails within it too, so the search need not start there.
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A text without this character has none of the kind.
_NEEDS = {"ip": ".", "phone": "+"}

# Letters of other scripts that look like Latin ones.
_LOOKS = dict(
    zip(
        "АВЕКМНОРСТУХЅІЈаеорсухѕіјԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναικρυ",
        "ABEKMHOPCTYXSIJaeopcyxsijdqwABEZHIKMNOPTYXovaikpu",
    )
)
_INVISIBLE = frozenset("­​‌‍⁠﻿")
# Digits as words.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits in a row, from which they are read as a number.
RUN = 3
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_DOT = r"(?:dot|punkt|punto|point)"
_SPELLED = re.compile(rf"(?i)\b(?:{_WORD})(?:[\s,-]+(?:{_DOT}\s+)?(?:{_WORD})){{{RUN - 1},}}\b")
_ONE = re.compile(rf"(?i)\b(?:({_WORD})|{_DOT})\b")
_LONE = re.compile(rf"(?i)(?<=[0-9.])[\x20-]?\b(?:{_WORD})\b|\b(?:{_WORD})\b(?=\.[0-9])")
_PLUS = re.compile(r"(?i)\bplus\s+(?=[0-9])")
_AT = r"(?:at|arroba|arobase|ät|klammeraffe)"
_BRACKETS = re.compile(rf"(?i)(?<!\s)\s*[\[({{<]\s*(?:({_AT}|@)|({_DOT}|\.))\s*[\])}}>]\s*")
_SPOKEN = re.compile(rf"(?i)(?<![\w.%+-])[\w.%+-]+\s+{_AT}\s+[\w-]+(?:\s+{_DOT}\s+[\w-]+)+")
_SPOKEN_MIXED = re.compile(rf"(?i)(?<![\w.%+-])[\w.%+-]+@[\w.-]+(?:\s+{_DOT}\s+[\w-]+)+|(?<![\w.%+-])[\w.%+-]+\s+{_AT}\s+[\w-]+(?:\.[\w-]+)+\b")
_NUMBERS_DOT = re.compile(rf"(?i)(?<=[0-9])\s+{_DOT}\s+(?=[0-9])")
_INNER = re.compile(rf"(?i)\s+(?:({_AT})|({_DOT}))\s+")

# What the first edit of each transducer needs, in a text folded by ``_low``; every match of a pattern above holds one of these.
_MARKED = re.compile(rf"[\[({{<]\s*(?:{_AT}|@|{_DOT}|\.)\s*[\])}}>]")
_SAID = re.compile(rf"\s{_DOT}\s|\s{_AT}\s+[\w-]+\.[\w-]")
_NUMBER = re.compile(rf"\b(?:{_WORD})(?:(?:[\s,-]+(?:{_DOT}\s+)?(?:{_WORD})){{{RUN - 1}}}|(?=\.[0-9]))|[0-9.][\x20-]?(?:{_WORD})\b|\bplus\s+[0-9]")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p) < 4 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in match.split(".")))
    digits = re.sub("[^0-9]", "", match)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, each found from its at sign, so that long runs of letters cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the identifiers in the text as it is, in that order."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for number, kind in enumerate(KINDS[1:], 1):
        if _NEEDS.get(kind, "") in text:
            out += [(m.start(), number, m.end()) for m in _PATTERNS[kind].finditer(text) if _valid(kind, m[0])]
    return sorted(out)


class Tape:
    """A text under rewriting: each character knows its source span and whether it was rewritten."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces text[a:b] by a string, for ascending (a, b, string)."""
        if not edits:
            return
        at, pieces, maps = 0, [], []
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            maps.append((self.start[at:a], self.end[at:a], self.changed[at:a]))
            maps.append((np.full(len(new), self.start[a]), np.full(len(new), self.end[b - 1]), np.ones(len(new), bool)))
            at = b
        pieces.append(self.text[at:])
        maps.append((self.start[at:], self.end[at:], self.changed[at:]))
        self.text = "".join(pieces)
        self.start, self.end, self.changed = (np.concatenate(x) for x in zip(*maps))


def _low(text: str) -> str:
    """In lower case, with the letters that patterns of any case take for an i; as many characters as before."""
    return text.lower() if text.isascii() else text.replace("\u0130", "i").replace("\u0131", "i").lower()


@lru_cache(maxsize=1 << 16)
def _looks(ch: str) -> str | None:
    if ch in _INVISIBLE:
        return ""
    if ch in _LOOKS:
        return _LOOKS[ch]
    plain_form = unicodedata.normalize("NFKC", ch)
    return plain_form if len(plain_form) == 1 and " " < plain_form < "\x7f" else None


def _fold_letters(tape: Tape) -> None:
    swaps = {ch: new for ch in set(tape.text) if ch > "\x7f" and (new := _looks(ch)) is not None}
    if swaps:
        tape.rewrite([(i, i + 1, swaps[ch]) for i, ch in enumerate(tape.text) if ch in swaps])


def _fold_signs(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETS.finditer(tape.text)])
    for whole in (_SPOKEN, _SPOKEN_MIXED):
        tape.rewrite([(m.start() + x.start(), m.start() + x.end(), "@" if x[1] else ".") for m in whole.finditer(tape.text) for x in _INNER.finditer(m[0])])


def _fold_digits(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), "".join(_DIGITS[_low(w[0])] if w[1] else "." for w in _ONE.finditer(m[0]))) for m in _SPELLED.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), ".") for m in _NUMBERS_DOT.finditer(tape.text)])
    tape.rewrite([(m.start() + x.start(), m.start() + x.end(), _DIGITS[_low(x[0])]) for m in _LONE.finditer(tape.text) for x in _ONE.finditer(m[0]) if x[1]])
    tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])


def may_hide(text: str) -> bool:
    """Whether any transducer may edit the text; where none edits it as it stands, none ever does."""
    if not text.isascii() and any(ch > "\x7f" and _looks(ch) is not None for ch in set(text)):
        return True
    low = _low(text)
    if any(c in low for c in "([{<") and _MARKED.search(low):
        return True
    return _SAID.search(low) is not None or _NUMBER.search(low) is not None


def rewritten(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the identifiers that only rewriting shows, in source characters."""
    tape = Tape(text)
    for fold in (_fold_letters, _fold_signs, _fold_digits):
        fold(tape)
    return sorted({(int(tape.start[a]), kind, int(tape.end[b - 1])) for a, kind, b in plain(tape.text) if tape.changed[a:b].any() or tape.end[b - 1] - tape.start[a] > b - a}) if tape.changed.any() or len(tape.text) < len(text) else []


def disguised(text: str, data: bytes) -> list[tuple[int, int, int]]:
    """What ``rewritten`` gives, after the cheap tests; ``data`` is the text as UTF-8."""
    return rewritten(text) if may_hide(text) else []


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = "array<struct<kind: string, start: int, end: int>>"


def _structs(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, chunk in rows_of(batches):
        rows = []
        for data in chunk:
            text = data.decode("utf-8", "replace")
            base = plain(text)
            rows.append((_structs(base), _structs(sorted({*base, *disguised(text, data)}))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r[0] for r in rows], _SPAN), pa.array([r[1] for r in rows], _SPAN)], names=["doc_id", "base", "spans"])


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, base, spans (arrays of kind, start, end in code points, by start, then kind).

    ``base`` are the plain identifiers, ``spans`` these and the disguised ones. Null and empty texts have none. Ids and rows may repeat, other columns
    are ignored.
    """
    return texts(docs, text, doc_id).mapInArrow(_found, f"doc_id long, base {_SCHEMA}, spans {_SCHEMA}")


def masked(text: str, data: bytes) -> str:
    """The text with each personal span, overlapping ones together, replaced by its first kind in capitals."""
    out, at = [], 0
    spans: list[list] = []
    for a, kind, b in sorted({*plain(text), *disguised(text, data)}):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b, kind])
    for a, b, kind in spans:
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text masked and all other columns as they are; null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else masked(t, t.encode()) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
