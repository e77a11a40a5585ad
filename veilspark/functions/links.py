"""Parts of links: decoded with the place of every character in the source, and stand-ins encoded as the original was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = r"(?:%[0-9A-Fa-f]{2})+|\+|[^%+]|%"


def _decoded(piece: Column, plus: bool) -> Column:
    space = F.lit(" ") if plus else F.lit("+")
    return F.when(piece.rlike("^%."), F.coalesce(F.call_function("try_url_decode", piece), piece)).when(piece == "+", space).otherwise(piece)


def decoded(raw: Column, plus: bool = True) -> Column:
    """A part without percent signs (``plus``: a plus is a space, as in queries); what is not well encoded stays as it is."""
    pieces = F.regexp_extract_all(raw, F.lit(f"({_PIECE})"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: _decoded(p, plus)), "")


def source_span(raw: Column, start: Column, end: Column, plus: bool = True) -> Column:
    """The (start, end) in ``raw`` of characters [start, end) of its decoded form; a run of escapes is taken whole."""
    pieces = F.regexp_extract_all(raw, F.lit(f"({_PIECE})"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))

    def step(s: Column, p: Column) -> Column:
        at, to = s["at"] + F.length(p), s["to"] + F.length(_decoded(p, plus))
        meets = (s["to"] < end) & (start < to)
        return F.struct(at.alias("at"), to.alias("to"), F.when(meets & (s["a"] < 0), s["at"]).otherwise(s["a"]).alias("a"), F.when(meets, at).otherwise(s["b"]).alias("b"))

    got = F.aggregate(pieces, zero, step)
    return F.when(got["a"] >= 0, F.struct(got["a"].alias("start"), got["b"].alias("end")))


def encoded_like(value: Column, raw: Column) -> Column:
    """A new value encoded the way ``raw`` was: its spaces as plus or %20, its at sign as it stood, all else escaped where a link needs it."""
    out = F.url_encode(value)
    out = F.when(F.lower(raw).contains("%20") | ~raw.contains("+"), F.regexp_replace(out, r"\+", "%20")).otherwise(out)
    return F.when(raw.contains("@"), F.regexp_replace(out, "%40", "@")).otherwise(out)
