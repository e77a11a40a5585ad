"""Small text functions as native columns: what is visible, notes, emphasis, sentences, and values that are no one's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks, keys

#: Characters that do not show: zero-width spaces and joiners, word joiner, byte order mark, soft hyphen.
HIDDEN = "[​‌‍⁠﻿­]"


def visible(text: Column) -> Column:
    """A text as it is read: without hidden characters and markup inside words, with plain spaces."""
    shown = F.regexp_replace(text, HIDDEN, "")
    shown = F.regexp_replace(shown, r"(?<=\p{L})\*{1,2}(?=\p{L})|(?<=\p{L})</?(?:b|i|em|strong|u|span)>(?=\p{L})", "")
    return F.translate(shown, "   ", "   ")


def visible_offsets(text: Column) -> Column:
    """For each visible character its place in the text, hidden characters skipped."""
    at = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.transform(F.filter(at, lambda x: ~x["c"].rlike(f"^{HIDDEN}$")), lambda x: x["i"])


def value_and_note(text: Column) -> Column:
    """struct<value, note>: ``128 -- gate code`` is a value and a note."""
    mark = r"[ \t]+(?:-{2,}|[—–|])[ \t]+"
    parts = F.split(text, mark, 2)
    return F.struct(F.trim(parts[0]).alias("value"), F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))).alias("note"))


def emphasis_masked(text: Column) -> Column:
    """Markdown emphasis as spaces, so that places stay."""
    return F.regexp_replace(F.regexp_replace(text, r"\*\*(?=\S)|(?<=\S)\*\*", "  "), r"(?<![\w*])[*_](?=\S)|(?<=\S)[*_](?![\w*])", " ")


def sentence_index(text: Column, at: Column) -> Column:
    """How many sentences end before a place."""
    return F.size(F.regexp_extract_all(F.substring(text, F.lit(1), at), F.lit(r"[.!?…](?=\s|$)|\n"), F.lit(0)))


def paragraph_index(text: Column, at: Column) -> Column:
    """How many paragraphs end before a place."""
    return F.size(F.regexp_extract_all(F.substring(text, F.lit(1), at), F.lit(r"\n\s*\n"), F.lit(0)))


def free_text(text: Column, words: int = 3) -> Column:
    """Whether a value is prose: some words, or letters beyond Latin."""
    return (F.size(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}"))) >= words) | text.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def secret_like(value: Column) -> Column:
    """A string that can be a secret: six characters or more with digits, symbols or inner capitals, and no path, option or placeholder."""
    mixed = value.rlike(r"[0-9]") & value.rlike(r"[A-Za-z]") | value.rlike(r"[a-z][A-Z]") | value.rlike(r"[^\w\s./-]")
    return (F.length(value) >= 6) & mixed & ~value.rlike(r"^(?:[/~.]|--?[a-z]|[a-z]+://)|\s") & ~keys.placeholder(value)


def no_ones(value: Column) -> Column:
    """Identifiers of requests, versions, files and products rather than of people."""
    return (
        value.rlike(r"(?i)^(?:req|request|trace|span|ord|order|inv|invoice|txn|evt|job|build|sku|sha|rev)[_-]")
        | value.rlike(r"^v?\d+(?:\.\d+){1,3}(?:[-+][\w.]+)?$")
        | value.rlike(r"(?i)^[\w-]+\.(?:py|js|ts|json|csv|txt|log|md|png|jpg|pdf|html|xml|ya?ml)$")
    )


def machine_address(text: Column, at: Column, value: Column) -> Column:
    """A private address after a word for a machine is no person's."""
    before = F.lower(F.substring(text, F.greatest(at - 24, F.lit(0)) + 1, F.least(at, F.lit(24))))
    return checks.private_ip(value) & before.rlike(r"(?:node|host|gateway|server|router|pod|upstream|proxy|broker|instance|endpoint)\W*$")


def cased_like(new: Column, original: Column) -> Column:
    """A new value in the case of the original: all capitals, all small, or as it is."""
    letters = original.rlike(r"\p{L}")
    return F.when(letters & (original == F.upper(original)), F.upper(new)).when(letters & (original == F.lower(original)), F.lower(new)).otherwise(new)


def company(value: Column) -> Column:
    """A name with a legal form or a word for an organisation."""
    return value.rlike(r"(?i)\b(?:inc|llc|ltd|gmbh|plc|corp|co|ag|sa|bv|s\.?r\.?l|university|hospital|bank|foundation|institute|ministry|department|church|school|company|group)\b\.?")
