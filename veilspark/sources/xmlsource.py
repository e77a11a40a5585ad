"""XML as leaves with the places of their characters, and a writer that changes only those.

A pull lexer goes over the source and keeps, for each leaf, where its characters stand: runs of plain text, references (``&amp;``, ``&#64;``), CDATA, attribute values, comments and processing
instructions. A leaf's text is what a reader sees; a change of some of its characters goes back to exactly the source characters they came from, spelled as the place wants it. So a value
that markup, references or comments cut is found and replaced whole, equal values elsewhere stay, and everything else is as it was, byte for byte. Documents with a DOCTYPE are refused.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from xml.parsers import expat

DEPTH = 64


class BadXML(ValueError):
    """Not well-formed, too deep, or with a DOCTYPE."""


# Elements of HTML that format text, which may stand inside a word.
FORMATTING = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
#: Elements that part words.
BREAKS = {"br": "\n", "wbr": ""}

#: (place in the leaf's text, characters there, place in the source, characters there, how it is written). Equal numbers of both move one for one;
#: otherwise the source characters are a reference, which goes as a whole.
Segment = tuple[int, int, int, int, str]


@dataclass
class Leaf:
    path: str
    key: str
    kind: str  # text, attribute, comment or instruction
    text: str
    records: tuple[int, ...]
    segments: list[Segment] = field(default_factory=list, repr=False)


_TOKEN = re.compile(r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<target>[^\s?]+)\s*(?P<pi>.*?)\?>|</(?P<close>[^\s>]+)\s*>|<(?P<open>[^\s/>]+)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|(?P<text>[^<]+)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_REFERENCE = re.compile(r"&(#x?)?([^;]+);|\r\n?", re.S)
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _checked(data: str | bytes) -> str:
    """The text of a well-formed document."""
    deep = 0

    def start(*_) -> None:
        nonlocal deep
        deep += 1
        if deep > DEPTH:
            raise BadXML("too_deep")

    def end(*_) -> None:
        nonlocal deep
        deep -= 1

    def doctype(*_) -> None:
        raise BadXML("xml_doctype")

    parser = expat.ParserCreate("utf-8" if isinstance(data, str) else None)  # a str is decoded, whatever it declares
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, doctype
    try:
        parser.Parse(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data, True)
    except expat.ExpatError as e:
        raise BadXML(str(e)) from None
    if isinstance(data, str):
        return data
    declared = re.match(rb"\s*<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", data)
    wide = {b"\xff\xfe": "utf-16", b"\xfe\xff": "utf-16", b"\xef\xbb": "utf-8-sig"}.get(data[:2])
    return data.decode(wide or (declared[1].decode() if declared else "utf-8"))


class _Run:
    """Characters of a value, with where they came from."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.segments: list[Segment] = []
        self.n = 0
        #: Stretches of segments that formatting elements hold, with path, key and records of a leaf of their own.
        self.inner: list[tuple[int, int, str, str, tuple[int, ...]]] = []

    def own(self) -> bool:
        """Whether there is text outside formatting elements."""
        held = {i for a, b, *_ in self.inner for i in range(a, b)}
        return any(p.strip() for i, p in enumerate(self.parts) if i not in held)

    def take(self, other: _Run, path: str, key: str, records: tuple[int, ...]) -> None:
        """Appends the run of a formatting element that ended."""
        at = len(self.parts)
        for part, (_, _, source, width, how) in zip(other.parts, other.segments):
            self.add(part, source, width, how)
        if other.own() or not other.inner:
            self.inner.append((at, len(self.parts), path, key, records))
        else:
            self.inner += [(a + at, b + at, *rest) for a, b, *rest in other.inner]

    def found(self, path: str, key: str, records: tuple[int, ...]) -> Iterator[Leaf | None]:
        """One leaf if there is text outside formatting elements, else one for each of these."""
        if self.own() or not self.inner:
            yield self.leaf(path, key, "text", records)
            return
        for a, b, *rest in self.inner:
            part = _Run()
            for text, (_, _, source, width, how) in zip(self.parts[a:b], self.segments[a:b]):
                part.add(text, source, width, how)
            yield part.leaf(rest[0], rest[1], "text", rest[2])

    def add(self, text: str, at: int, width: int, how: str) -> None:
        if text:
            self.parts.append(text)
            self.segments.append((self.n, len(text), at, width, how))
            self.n += len(text)

    def read(self, source: str, a: int, b: int, how: str) -> None:
        """Source characters ``a`` to ``b``; references are resolved but in CDATA and the like, line ends are one character."""
        at = a
        for m in _REFERENCE.finditer(source, a, b):
            if m[0][0] == "&" and how not in ("text", "attribute"):
                continue
            self.add(source[at : m.start()], at, m.start() - at, how)
            code = "\n" if m[0][0] == "\r" else _NAMED[m[2]] if not m[1] else chr(int(m[2], 16 if m[1] == "#x" else 10))
            self.add(code, m.start(), m.end() - m.start(), how)
            at = m.end()
        self.add(source[at:b], at, b - at, how)

    def leaf(self, path: str, key: str, kind: str, records: tuple[int, ...]) -> Leaf | None:
        """The leaf without white space around it; none if nothing is left."""
        whole = "".join(self.parts)
        text = whole.strip() if kind in ("text", "comment") else whole
        if not text and kind == "text":
            return None
        lo = len(whole) - len(whole.lstrip()) if kind in ("text", "comment") else 0
        segments = []
        for at, n, start, width, how in self.segments:
            a, b = max(at, lo), min(at + n, lo + len(text))
            if a < b:
                segments.append((a - lo, b - a, start + a - at, b - a, how) if n == width else (at - lo, n, start, width, how))
        return Leaf(path, key, kind, text, records, segments)


@dataclass
class _Element:
    name: str
    record: int
    at: int  # leaves before it
    run: _Run = field(default_factory=_Run)
    runs: list[_Run] = field(default_factory=list)


def leaves(data: str | bytes) -> list[Leaf]:
    """Leaves in document order. Text that formatting elements cut is one leaf of the element around them; text between other elements is a leaf for each stretch.

    ``records`` are the elements around a leaf. White space around texts and comments is left out.
    """
    source = _checked(data)
    out: list[tuple[int, Leaf]] = []
    stack: list[_Element] = []
    made = 0

    def path(extra: str = "") -> str:
        return "/" + "/".join(f.name for f in stack) + extra

    def records() -> tuple[int, ...]:
        return tuple(f.record for f in stack)

    def put(leaf: Leaf | None) -> None:
        if leaf is not None:
            out.append((leaf.segments[0][2] if leaf.segments else m.start(), leaf))

    def shut() -> None:
        """Ends the innermost element: formatting without leaves of its own hands its text on, others give theirs."""
        done = stack[-1]
        at = path(), _local(done.name), records()
        stack.pop()
        if stack and _local(done.name).lower() in (*FORMATTING, *BREAKS) and len(out) == done.at and not done.runs:
            stack[-1].run.take(done.run, *at)
            return
        if stack and stack[-1].run.n:  # the element parts the text around it
            stack[-1].runs.append(stack[-1].run)
            stack[-1].run = _Run()
        for run in [*done.runs, done.run]:
            for leaf in run.found(*at):
                put(leaf)

    for m in _TOKEN.finditer(source):
        kind = m.lastgroup if m.lastgroup not in ("attributes", "empty") else "open"
        if m["open"] is not None:
            name = m["open"]
            if stack and _local(name).lower() in BREAKS:
                stack[-1].run.add(BREAKS[_local(name).lower()], m.end(), 0, "text")
            made += 1
            stack.append(_Element(name, made, len(out)))
            for a in _ATTRIBUTE.finditer(source, m.start("attributes"), m.end("attributes")):
                if not a[1].startswith("xmlns"):
                    run, which = _Run(), 2 if a[2] is not None else 3
                    run.read(source, a.start(which), a.end(which), "attribute")
                    put(run.leaf(path(f"/@{a[1]}"), _local(a[1]), "attribute", records()))
            if m["empty"]:
                shut()
        elif m["close"] is not None:
            shut()
        elif kind == "text" or m["cdata"] is not None:
            if stack:
                stack[-1].run.read(source, *m.span("text" if kind == "text" else "cdata"), kind)
        elif m["comment"] is not None or m["target"] is not None:
            which = "comment" if m["comment"] is not None else "pi"
            if m["target"] is not None and m["target"].lower() == "xml":
                continue
            run = _Run()
            run.read(source, *m.span(which), which)
            put(run.leaf(path("/#comment" if which == "comment" else f"/?{m['target']}"), "" if which == "comment" else m["target"], "comment" if which == "comment" else "instruction", records()))
    return [leaf for _, leaf in sorted(out, key=lambda x: x[0])]


def _spelled(new: str, how: str) -> str:
    """``new`` as it is written at a place."""
    new = re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "\ufffd", new)  # what XML does not hold
    if how == "cdata":
        return new.replace("]]>", "]]]]><![CDATA[>")
    if how == "comment":
        return re.sub("-(?=-)|-$", "- ", new)
    if how == "pi":
        return new.replace("?>", "? >")
    new = new.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\r", "&#13;")
    return new.replace('"', "&quot;").replace("'", "&apos;").replace("\n", "&#10;").replace("\t", "&#9;") if how == "attribute" else new


def placed(leaf: Leaf, start: int, end: int, new: str) -> list[tuple[int, int, str]]:
    """(source start, source end, spelled text) of a change of characters ``start`` to ``end`` of a leaf: the new text stands where the old one began, the rest of the old one goes."""
    starts = [s[0] for s in leaf.segments]
    out: list[tuple[int, int, str]] = []
    for at, n, source, width, how in leaf.segments[max(0, bisect_right(starts, start) - 1) :]:
        if at >= end:
            break
        a, b = max(start, at), min(end, at + n)
        if a < b and width:
            place = (source + a - at, source + b - at) if n == width else (source, source + width)
            out.append((*place, "" if out else _spelled(new, how)))
    return out


def patched(source: str, changes: Sequence[tuple[int, int, int, str]]) -> str:
    """``source`` with changes (number of the leaf, start and end in its text, new text) made where the leaf's characters stand.

    A change that no source character of its leaf answers to is an error: it is never passed over.
    """
    found = leaves(source)
    edits: list[tuple[int, int, str]] = []
    for number, start, end, new in changes:
        if not 0 <= number < len(found) or not 0 <= start < end <= len(found[number].text):
            raise BadXML("lost_leaf")
        places = placed(found[number], start, end, new)
        if not places:
            raise BadXML("lost_leaf")
        edits += places
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a < at:
            raise BadXML("overlap")
        out += [source[at:a], new]
        at = b
    return "".join([*out, source[at:]])


def written(source: str, changes: dict[str, str]) -> str:
    """The document with each leaf whose whole text is a key of ``changes`` changed to its value; all else as it is."""
    return patched(source, [(i, 0, len(f.text), changes[f.text]) for i, f in enumerate(leaves(source)) if f.text and f.text in changes])
