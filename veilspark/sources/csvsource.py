"""CSV with its dialect: sniffed delimiter and quote, ragged rows, a header only where there is one, and a writer in the same dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, ROWS = 1 << 16, 50


class BadCSV(ValueError):
    """A quote is never closed."""


def parse(text: str, delimiter: str = ",", quote: str = '"', whole: bool = True) -> list[list[str]]:
    """Rows of cells; doubled quotes, lines within quotes and ragged rows are fine. A cut text (``whole`` false) may end in a quote."""
    rows: list[list[str]] = []
    row: list[str] = []
    cell: list[str] = []
    quoted = started = False
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if quoted:
            if c == quote and text[i + 1 : i + 2] == quote:
                cell.append(quote)
                i += 1
            elif c == quote:
                quoted = False
            else:
                cell.append(c)
        elif c == quote and not cell and not started:
            quoted = started = True
        elif c == delimiter:
            row.append("".join(cell))
            cell, started = [], False
        elif c in "\r\n":
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            row.append("".join(cell))
            rows.append(row)
            row, cell, started = [], [], False
        else:
            cell.append(c)
        i += 1
    if quoted and whole:
        raise BadCSV("unterminated quote")
    if cell or row or started:
        row.append("".join(cell))
        rows.append(row)
    return rows


def sniff(text: str, delimiters: str = ",;\t|") -> tuple[str, str]:
    """(delimiter, quote): the pair by which most rows of the head are as wide as the first, wider ones on a tie."""
    best, found = (-1, 0), (",", '"')
    for delimiter in delimiters:
        for quote in "\"'":
            rows = [r for r in parse(text[:HEAD], delimiter, quote, False) if r != [""]][:ROWS]
            if not rows:
                continue
            width = len(rows[0])
            same = sum(len(r) == width for r in rows) * 10_000 // len(rows) if width > 1 else 0
            # an apostrophe counts as a quote only where it closes cells
            closed = quote == '"' or bool(re.search(rf"(?m)(^|{re.escape(delimiter)})'[^'\n]*'({re.escape(delimiter)}|$)", text[:HEAD]))
            score = (same + min(width, 99) if closed else -1, quote == '"')
            if score > best:
                best, found = score, (delimiter, quote)
    return found


_NUMBER = re.compile(r"[+-]?[0-9]+([.,][0-9]+)*")


def header(rows: list[list[str]], hinted) -> bool:
    """Whether the first row names the columns: a cell hints a field and none holds a value, or the later rows are more of numbers."""
    if len(rows) < 1:
        return False
    first = rows[0]
    if any("@" in c or _NUMBER.fullmatch(c.strip()) for c in first):
        return False
    if any(hinted(c) for c in first):
        return True
    numbers = lambda r: sum(bool(_NUMBER.fullmatch(c.strip())) for c in r)
    return len(rows) > 1 and max(numbers(r) for r in rows[1:20]) > numbers(first)


def quoted(cell: str, delimiter: str, quote: str = '"', always: bool = False) -> str:
    """A cell as it is written: in quotes only where it must be."""
    if always or any(c in cell for c in (delimiter, quote, "\n", "\r")):
        return quote + cell.replace(quote, quote * 2) + quote
    return cell


def neutralised(cell: Column) -> Column:
    """Cells that a spreadsheet would run as formulas get an apostrophe before them; plain signed numbers do not."""
    opens = cell.rlike(r"^[=@+\-\t\r\n＝＠＋－]")
    number = cell.rlike(r"^[+-]?[0-9]+([.,][0-9]+)*%?$")
    return F.when(opens & ~number, F.concat(F.lit("'"), cell)).otherwise(cell)


def neutral(cell: str) -> str:
    """As ``neutralised``, for one cell."""
    return "'" + cell if re.match(r"[=@+\-\t\r\n＝＠＋－]", cell) and not re.fullmatch(r"[+-]?[0-9]+([.,][0-9]+)*%?", cell) else cell


def written(rows: list[list[str]], delimiter: str, quote: str = '"', end: str = "\n") -> str:
    return "".join(delimiter.join(quoted(c, delimiter, quote) for c in r) + end for r in rows)
