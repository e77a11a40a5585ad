"""Names that no cue stands beside: capitals, joined parts, and given names alone; and what is cut from a guessed name or makes it none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, scan
from . import people

# Words before and after a name that are not of it.
LEADING = ["dear", "hi", "hello", "from", "to", "by", "with", "and", "or", "the", "a", "for", "contact", "call", "ask", "meet", "thanks", "regards", "customer", "patient", "manager", "director", "engineer", "nurse", "teacher", "agent", "president"]
TRAILING = ["said", "says", "wrote", "called", "asked", "replied", "and", "or", "is", "was", "has", "will", "from", "at", "in", "on", "today", "yesterday", "tomorrow"]
DATES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
PARTICLES = ["van", "von", "de", "da", "do", "dos", "del", "della", "der", "den", "di", "la", "le", "bin", "ibn", "al", "el", "ter", "zu"]
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "md", "esq"]
#: Capitals that are no one's name.
ACRONYMS = ["API", "URL", "HTTP", "HTTPS", "JSON", "XML", "CSV", "SQL", "PDF", "HTML", "CEO", "CFO", "CTO", "USA", "UK", "EU", "UN", "NASA", "FBI", "CIA", "IRS", "ID", "OK", "FAQ", "TODO", "NOTE", "ERROR", "WARN", "INFO", "DEBUG", "NULL", "TRUE", "FALSE", "UTC", "GMT"]
_CAPITALS = [
    (rf"(?<![\p{{L}}-])(?!(?:Mr|Mrs|Ms|Dr|Prof|Mme)\b)\p{{Lu}}\p{{Ll}}+ \p{{Lu}}{{2,}}(?:-\p{{Lu}}{{2,}})?(?![\p{{L}}-])", None, False),
    (r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Mme|M)\.? )\p{Lu}{2,}(?:-\p{Lu}{2,})?(?![\p{L}-])", None, False),
    (r"^\p{Lu}{2,}(?: \p{Lu}{2,}){1,2}$", None, False),
]
SPAN = "start", "end", "value"


def capitals(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``names``: ``Julie BEET``, ``Ms BEET`` and whole fields in capitals, acronyms refused. A null text has none."""
    acronym = lambda w: F.array_contains(keys.literals(ACRONYMS), w)
    found = rows.withColumn("found__", scan.matches(F.col(text), _CAPITALS))
    kept = F.filter("found__", lambda m: ~F.exists(F.split(m["value"], " "), acronym))
    return found.select(*rows.columns, F.transform(kept, lambda m: F.struct(*(m[c].alias(c) for c in SPAN))).alias("names"))


def _ends(words: Column, cut: list[str], back: bool) -> Column:
    """How many words at one end are of ``cut``."""
    each = F.transform(F.reverse(words) if back else words, lambda w: F.array_contains(keys.literals(cut), F.regexp_replace(keys.plain(w), r"[^\p{L}]", "")))
    first = F.array_position(each, False)
    return F.when(first == 0, F.size(words)).otherwise(first - 1).cast("int")


def trimmed(name: Column) -> Column:
    """A guessed name without roles, verbs and greetings at its ends; null where nothing of a name is left: a date, one letter, or digits."""
    words = F.split(F.trim(name), r"\s+")
    before, after = _ends(words, [*LEADING, *DATES], False), _ends(words, [*TRAILING, *DATES], True)
    kept = F.slice(words, before + 1, F.greatest(F.size(words) - before - after, F.lit(0)))
    out = F.regexp_replace(F.array_join(kept, " "), r"[,.;:!?]+$", "")
    return F.when(out.rlike(r"^\p{L}[^0-9]*\p{L}[^0-9]*$") & ~F.lower(out).isin(*DATES), out)


def no_ones(value: Column, before: Column) -> Column:
    """Names of services, log states and sizes: lower-case hosts, ``svc_`` accounts, and whatever follows ``status`` or ``level``."""
    account = value.rlike(r"(?i)^(svc|srv|sys|bot|noreply|no-reply|root|admin|daemon|nobody|www-data|postgres|mysql|redis|jenkins|github-actions)(?![A-Za-z])|(?i)[_-](bot|svc|service)$")
    size = value.rlike(r"(?i)^[0-9.]+ ?([kmgt]i?b|ms|s|px|%)$")
    state = before.rlike(r"(?i)\b(status|level|state|severity|mode|phase|env)\"?\s*[:=]\s*\"?$")
    return account | size | state


def joined(spans: DataFrame) -> DataFrame:
    """(leaf_id, start, end) of names whose parts (leaf_id, start, end, between: the text from the part before, null at the first) belong together.

    Parts join over a space, an initial, a quoted nickname, a particle, or before a suffix. Windows are single texts.
    """
    particle = "|".join(PARTICLES)
    suffix = "|".join(SUFFIXES)
    link = rf"(?i)^\s((\p{{L}}\.\s?){{1,3}}|[\"“(]\p{{L}}+[\"”)]\s|((?:{particle})['’]?\s?){{1,3}})?$|^,?\s(?=(?:{suffix})\b)"
    w = Window.partitionBy("leaf_id").orderBy("start", "end")
    fresh = (~F.coalesce(F.col("between").rlike(link), F.lit(False))).cast("int")
    grouped = spans.withColumn("fresh__", fresh).withColumn("group__", F.sum("fresh__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("leaf_id", "group__").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("group__")


def given_alone(mentions: DataFrame) -> DataFrame:
    """``mentions`` (scope, name, evidence) of one word each or more, with ``verdict``.

    A full name, or a given name with evidence (a title, label, sign-off or email), is kept; a given name alone is kept where its scope has one full name that
    starts with it, is a doubt where it has several, and a doubt where it has none.
    """
    m = mentions.withColumn("p", people.parts(F.col("name")))
    full = m.where(F.size("p") > 1).select("scope", F.element_at("p", 1).alias("first"), F.element_at("p", -1).alias("last"))
    known = full.groupBy("scope", "first").agg(F.count_distinct("last").alias("n"))
    met = m.withColumn("first", F.element_at("p", 1)).join(known, ["scope", "first"], "left")
    keep = (F.size("p") > 1) | F.coalesce(F.col("evidence"), F.lit(False)) | F.coalesce(F.col("n") == 1, F.lit(False))
    return met.select("scope", "name", F.when(keep, "keep").otherwise("doubt").alias("verdict"))


def gated(spans: DataFrame) -> DataFrame:
    """``spans`` (lang, entity, before, after, ...) with ``doubt``: outside English a guessed person needs a title, label, sign-off or email beside it."""
    title = F.col("before").rlike(r"(?i)\b(mr|mrs|ms|dr|prof|herr|frau|mme|sr|sra|señor|señora|monsieur|madame)\.?\s*$")
    label = F.col("before").rlike(r"(?i)\b(name|nombre|nom|naam|nome|contact|from|to|by|von|de)\"?\s*[:=]\s*\"?$")
    sign_off = F.col("before").rlike(r"(?i)\b(regards|sincerely|cheers|grüße|gruss|saludos|cordialement|groeten),?\s*\n?\s*$")
    email = F.col("after").rlike(r"^\s*[<(]?[\w.+-]+@")
    guessed = (F.col("entity") == "PERSON") & ~F.coalesce(F.col("lang") == "en", F.lit(False))
    seen = F.coalesce(title | label | sign_off | email, F.lit(False))
    return spans.withColumn("doubt", F.when(guessed & ~seen, "no_evidence"))
