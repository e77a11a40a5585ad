"""Documents of any format as one table of leaves: what detectors and associations read."""

from __future__ import annotations

import base64
import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from . import csvsource, formats, jsonsource, xmlsource
from .scratch import dealt

SCHEMA = "doc_id string, leaf_id long, kind string, path string, key string, start int, end int, text string, record_ids array<long>, problem string"
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.string())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_BASE64 = re.compile("[A-Za-z0-9+/=]+")
NESTED = 16
#: Leaves that are handed on together.
ROWS = 20_000


def _nested(text: str) -> str | None:
    """A string that is JSON, or base64 of JSON, as JSON text."""
    body = text.strip()
    if body[:1] in ("{", "["):
        return body
    if len(body) >= 8 and len(body) % 4 == 0 and _BASE64.fullmatch(body):
        try:
            inner = base64.b64decode(body, validate=True).decode()
        except (ValueError, UnicodeDecodeError):
            return None
        return inner if inner.strip()[:1] in ("{", "[") else None
    return None


def _json(text: str, lines: bool, depth: int = 0, made: Counter | None = None) -> Iterator[tuple]:
    """Leaves with records numbered over the whole document, also those of documents within its strings."""
    made = Counter() if made is None else made
    own: dict[int, int] = {}
    known: dict[tuple[int, ...], tuple[int, ...]] = {}

    def numbered(records: tuple[int, ...]) -> tuple[int, ...]:
        if records not in known:
            for r in records:
                if r not in own:
                    made["records"] += 1
                    own[r] = made["records"]
            known[records] = tuple(own[r] for r in records)
        return known[records]

    for f in jsonsource.line_leaves(text) if lines else jsonsource.leaves(text):
        records = numbered(f.records)
        inner = _nested(f.text) if f.kind == "value" and depth < NESTED else None
        if inner is not None:
            try:
                jsonsource.leaves(inner)
            except jsonsource.BadJSON:
                inner = None
        if inner is None:
            yield f.kind, f.path, f.key, f.start, f.end, f.text, records
        else:
            for kind, path, key, _, _, value, under in _json(inner, False, depth + 1, made):
                yield kind, f"{f.path}~{path[1:]}", key, f.start, f.end, value, (*records, *under)


def hinted(name: str) -> bool:
    compact = "".join(c for c in name.lower() if c.isalnum())
    return any(compact in names for names in keys.NAMES.values())


def _csv(text: str) -> Iterator[tuple]:
    delimiter, quote = csvsource.sniff(text)
    rows = csvsource.parse(text, delimiter, quote)
    named = csvsource.header(rows, hinted)
    heads = rows[0] if named else []
    for n, row in enumerate(rows[named:]):
        for i, cell in enumerate(row):
            yield "value", f"[{n}][{i}]", heads[i] if i < len(heads) else "", 0, len(cell), cell, (n,)


def of(text: str, kind: str, nested: bool = True) -> list[tuple]:
    """(kind, path, key, start, end, text, record ids) of one document; with ``nested`` also of documents within its strings."""
    depth = 0 if nested else NESTED
    if kind in ("json", "jsonl"):
        return list(_json(text, kind == "jsonl", depth))
    if kind == "csv":
        return list(_csv(text))
    if kind == "xml":
        # an element's text is a field of the element around it
        return [(f.kind, f.path, f.key, 0, len(f.text), f.text, f.records[:-1] if f.kind == "text" else f.records) for f in xmlsource.leaves(text)]
    out, at, made = [], 0, Counter()
    for a, b in jsonsource.regions(text):  # documents written inside prose
        out.append(("prose", "$", "", at, a, text[at:a], ()))
        out += [(k, f"$@{a}{p[1:]}", key, a + s, a + e, v, r) for k, p, key, s, e, v, r in _json(text[a:b], False, depth, made)]
        at = b
    return [x for x in [*out, ("prose", "$", "", at, len(text), text[at:], ())] if x[5]]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``SCHEMA`` as one batch."""
    columns = [list(c) for c in zip(*rows)]
    ends = pa.array(accumulate(map(len, columns[8]), initial=0), pa.int32())
    records = pa.ListArray.from_arrays(ends, pa.array(chain.from_iterable(columns[8]), pa.int64()))
    return pa.RecordBatch.from_arrays([records if c == "record_ids" else pa.array(x, t) for c, x, t in zip(_NAMES, columns, _TYPES)], names=_NAMES)


def leaves(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str | None = None, nested: bool = True) -> DataFrame:
    """Leaves of documents; ``kind`` names the column of formats (sniffed without it). A document that cannot be read gives one row with ``problem``.

    Each document is one task's work; the number of leaves in a task is that of its batch of documents.
    """
    what = F.col(kind) if kind else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), what.alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, k, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "text"))):
                try:
                    found = of(body, k or formats.sniff_text(body), nested)
                    out += [(doc, i, *f, None) for i, f in enumerate(found)]
                except (jsonsource.BadJSON, csvsource.BadCSV, xmlsource.BadXML, json.JSONDecodeError) as e:
                    out.append((doc, 0, "problem", "$", "", 0, 0, "", (), str(e)))
                if len(out) >= ROWS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return dealt(rows, "doc_id").mapInArrow(run, SCHEMA)
