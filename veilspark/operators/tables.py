"""Table functions for SQL: the spans of a text and the leaves of a document as rows.

A Python function answers each row; where a whole table is searched, ``detect.detect`` searches batches of texts and checks the few matches in native columns. The table functions are
for lateral joins in plain SQL, and their spans are the matches of the bank's patterns by form: checks that need native columns (Luhn, dates, IBAN) are made by the caller, on the few rows that come out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ..sources import csvsource, formats, jsonsource, leaves, xmlsource


def _text(argument: AnalyzeArgument, name: str) -> None:
    if not isinstance(argument.dataType, StringType) and argument.dataType.typeName() != "void":
        raise TypeError(f"{name} is a string, not {argument.dataType.simpleString()}")


@udtf
class Spans:
    """(start, end, entity, value) of the matches of the pattern bank in a text, by place; a null text has none. Offsets are code points."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "text")
        return AnalyzeResult(StructType().add("start", IntegerType()).add("end", IntegerType()).add("entity", StringType()).add("value", StringType()))

    def __init__(self) -> None:
        from ..functions import scan
        from . import detect

        self.bank = [p for p in detect.BANK if p.score >= detect.FLOOR]  # others need the words around
        self.compiled, _ = scan._compiled(tuple((p.pattern, p.need, False) for p in self.bank))

    def eval(self, text: str) -> Iterator[tuple]:
        found = []
        for i, pattern, need, _ in self.compiled if text else ():
            if need is None or need.search(text):
                found += [(m.start(), m.end(), self.bank[i].entity, m[0]) for m in pattern.finditer(text)]
        yield from sorted(set(found))


@udtf
class Leaves:
    """(leaf, kind, path, key, text, records) of a document of a format (json, jsonl, csv, xml, text; null: sniffed); one that cannot be read is one leaf of kind ``problem``."""

    @staticmethod
    def analyze(document: AnalyzeArgument, format: AnalyzeArgument) -> AnalyzeResult:
        _text(document, "document")
        _text(format, "format")
        schema = StructType().add("leaf", LongType()).add("kind", StringType()).add("path", StringType()).add("key", StringType()).add("text", StringType())
        return AnalyzeResult(schema.add("records", ArrayType(LongType())))

    def eval(self, document: str, format: str) -> Iterator[tuple]:
        if document is None:
            return
        try:
            found = leaves.of(document, format or formats.sniff_text(document))
        except (jsonsource.BadJSON, csvsource.BadCSV, xmlsource.BadXML, ValueError) as e:
            yield 0, "problem", "$", "", str(e), []
            return
        for i, (kind, path, key, _, _, text, records) in enumerate(found):
            yield i, kind, path, key, text, list(records)


FUNCTIONS = {"pii_spans": Spans, "pii_leaves": Leaves}
