"""JSON and JSON Lines as leaves, losslessly: keys in order, repeated keys kept, numbers as they are spelled, and a writer that changes only edited tokens."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

DEPTH = 64
_TOKEN = re.compile(r'\s*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


class BadJSON(ValueError):
    """Not JSON, or nested too deeply."""


@dataclass(slots=True)
class Leaf:
    path: str
    key: str
    kind: str  # value, number or key
    start: int
    end: int
    text: str
    records: tuple[int, ...]


@dataclass(slots=True)
class _Open:
    """An object or list that is being read: ``path``, ``key`` and ``records`` are those of the leaf that comes next in it."""

    object: bool
    prefix: str
    path: str
    key: str
    records: tuple[int, ...]
    n: int = 0


_TOP = _Open(False, "$", "$", "", ())


def _string(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def leaves(text: str) -> list[Leaf]:
    """Strings, numbers and keys of a document in order, with where they stand. ``records`` are the objects around a leaf, outermost first."""
    out: list[Leaf] = []
    at, made = 0, 0
    stack: list[_Open] = []
    want = "value"

    def step() -> tuple[str, str, int, int]:
        nonlocal at
        m = _TOKEN.match(text, at)
        if not m:
            raise BadJSON(f"at {at}")
        at = m.end()
        i = m.lastindex
        return "psnw"[i - 1], m[i], m.start(i), at

    while want != "end":
        kind, token, a, b = step()
        top = stack[-1] if stack else _TOP
        if want == "key" or want == "key or }":
            if kind == "p" and token == "}" and want == "key or }":
                stack.pop()
                want = "comma" if stack else "end"
                continue
            if kind != "s":
                raise BadJSON(f"a key at {a}")
            top.key = _string(token)
            top.path = f"{top.prefix}.{top.key}"
            out.append(Leaf(top.path, top.key, "key", a, b, top.key, top.records))
            if step()[1] != ":":
                raise BadJSON(f"a colon at {at}")
            want = "value"
        elif want == "comma":
            if kind == "p" and token == ",":
                top.n += 1
                if not top.object:
                    top.path = f"{top.prefix}[{top.n}]"
                want = "key" if top.object else "value"
            elif kind == "p" and token == ("}" if top.object else "]"):
                stack.pop()
                want = "comma" if stack else "end"
            else:
                raise BadJSON(f"a comma at {a}")
        elif kind == "p" and token in "{[":
            if len(stack) >= DEPTH:
                raise BadJSON("too_deep")
            opened = token == "{"
            made += opened
            stack.append(_Open(opened, top.path, "" if opened else f"{top.path}[0]", "" if opened else top.key, (*top.records, made) if opened else top.records))
            want = "key or }" if opened else "value or ]"
        elif kind == "p" and token == "]" and want == "value or ]":
            stack.pop()
            want = "comma" if stack else "end"
        elif kind == "p":
            raise BadJSON(f"a value at {a}")
        else:
            if kind in "sn":
                out.append(Leaf(top.path, top.key, "value" if kind == "s" else "number", a, b, _string(token) if kind == "s" else token, top.records))
            want = "comma" if stack else "end"
    if text[at:].strip():
        raise BadJSON("text after the document")
    return out


def line_leaves(text: str) -> Iterator[Leaf]:
    """Leaves of JSON Lines; the path opens with the line's number, and places are those of the whole text."""
    at, shift = 0, 0
    for n, line in enumerate(text.split("\n")):  # nothing else ends a line: U+2028 and its like stand inside strings
        if line.strip():
            found = leaves(line)
            for f in found:
                yield Leaf(f"[{n}]{f.path[1:]}", f.key, f.kind, f.start + at, f.end + at, f.text, tuple(r + shift for r in f.records))
            shift += max((r for f in found for r in f.records), default=0)
        at += len(line) + 1


def spelled(leaf_kind: str, new: str) -> str:
    """A new value as a token: strings are escaped, numbers must stay numbers."""
    if leaf_kind == "number":
        if not re.fullmatch(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", new):
            raise BadJSON("not a number")
        return new
    return json.dumps(new, ensure_ascii=False)


def patched(text: str, edits: list[tuple[int, int, str, str]]) -> str:
    """The document with tokens (start, end, kind, new value) replaced and every other byte as it is."""
    out, at = [], 0
    for a, b, kind, new in sorted(edits):
        out += [text[at:a], spelled(kind, new)]
        at = b
    return "".join([*out, text[at:]])


_OPEN = re.compile(r"[{\[]")


def regions(text: str) -> list[tuple[int, int]]:
    """Places of JSON objects and lists that stand inside other text (at least one key or two items)."""
    decoder = json.JSONDecoder()
    out, at = [], 0
    while m := _OPEN.search(text, at):
        try:
            value, end = decoder.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            at = m.end()
            continue
        if isinstance(value, dict) and value or isinstance(value, list) and len(value) > 1:
            out.append((m.start(), end))
        at = end
    return out
