"""Detectors: from (text, key) to spans: one pass finds the matches of all patterns, native columns check, score and resolve them.

A pattern has an entity, a base score, words that speak for it (one of the five before adds 0.35, to at least 0.4) and a validator. What stays
below 0.4 is dropped. Later readers only fill gaps that surer ones leave (``spans.resolve``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, identifiers, keys, scan
from ..functions import spans as S
from ..sources.scratch import large
from . import records

NEAR, LIFT, FLOOR = 5, 0.35, 0.4
REVIEW_BELOW = 0.65


def _any(v: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Pattern:
    entity: str
    pattern: str
    score: float
    words: tuple[str, ...] = ()
    valid: Callable[[Column], Column] = _any
    #: A cheap pattern that every text with a match has; others are not searched.
    need: str | None = None


def _public_ip(v: Column) -> Column:
    return checks.ipv4(v) & ~checks.shared_ip(v)


def _birth(v: Column) -> Column:
    p = F.transform(F.split(v, "[-/.]"), lambda x: x.try_cast("int"))
    year_first = checks.real_date(p[0], p[1], p[2]) & p[0].between(1900, 2030)
    year_last = (checks.real_date(p[2], p[0], p[1]) | checks.real_date(p[2], p[1], p[0])) & p[2].between(1900, 2030)
    return F.coalesce(year_first, F.lit(False)) | F.coalesce(year_last, F.lit(False))


# Formats as their publishers describe them, and words that speak for them.
BANK: tuple[Pattern, ...] = (
    Pattern("EMAIL_ADDRESS", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+", 1.0, need=r"@"),
    Pattern("EMAIL_ADDRESS", r"(?<![\w.%+-])[a-zA-Z0-9][a-zA-Z0-9._+-]*%40[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+", 1.0, need=r"%40"),
    # ISO/IEC 7812: 13 to 19 digits, unbroken or printed in groups; a number beside unbroken ones and a part of a dotted address are no groups of it
    Pattern("CREDIT_CARD", r"(?<![\w-])(?:\d{13,19}(?![\w-])|(?<!\d\.\d{1,3}\.)(?!(?:\d{1,5}[ -])+\d{13,19}(?![\w-]))\d(?:[ -]?\d){12,18}(?![\w-]|\.\d{1,3}\.\d))", 0.6, ("card", "cards", "pan", "visa", "amex", "mastercard"), checks.card, need=r"\d{4}"),
    # ISO 13616: country, check digits, up to 30 letters and digits, printed whole or in fours
    Pattern("IBAN_CODE", r"(?<![A-Za-z0-9])[A-Z]{2}\d\d(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", 0.6, ("iban", "bank", "account"), checks.iban, need=r"[A-Z]{2}\d{2}"),
    Pattern("IP_ADDRESS", r"(?<![\w:.])(?:\d{1,3}\.){3}\d{1,3}(?![\w:/]|\.\d)", 0.6, ("ip", "address"), _public_ip, need=r"\d\.\d"),
    Pattern("IP_ADDRESS", r"(?i)(?<![\w:])(?:[0-9a-f]{1,4}:){2,7}(?::?[0-9a-f]{1,4}){1,6}(?![\w:])", 0.6, ("ip", "address"), lambda v: ~checks.shared_ip(v) & v.rlike("[0-9]"), need=r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    # the Social Security Administration's numbering: no area 000, 666 or 9xx
    Pattern("US_SSN", r"(?<![\d-])(?!000|666|9)\d{3}(?:-\d\d-|\x20\d\d\x20)\d{4}(?![\d-])", 0.85, ("ssn", "social"), checks.ssn, need=r"\d[ -]\d{4}"),
    Pattern("US_SSN", r"(?<![\w-])(?!000|666|9)\d{9}(?![\w-])", 0.05, ("ssn", "social"), checks.ssn, need=r"\d{9}"),
    Pattern("US_ITIN", r"\b9\d{2}[- ]\d{2}[- ]\d{4}\b", 0.5, ("individual", "taxpayer", "itin", "tax", "tin"), checks.itin, need=r"9\d{2}[- ]"),
    Pattern("SECRET", r"\b(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bAKIA[0-9A-Z]{16}\b|\bglpat-[\w-]{20,}", 0.9, need=r"[spr]k_|gh[pousr]_|AKIA|glpat"),
    Pattern("SECRET", r"(?i)(?<=(?:password|passwd|passphrase|secret|api[_-]?key|access[_-]?key|token)\"?\s{0,3}[:=]\s{0,3}\"?)[^\s\"',;]{6,}", 0.9, (), lambda v: ~keys.placeholder(v), need=r"(?i)passw|passphrase|secret|key|token"),
    # a North American number ends after its ten digits, whatever number follows it
    Pattern("PHONE_NUMBER", r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![\w-])|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w-]))", 0.75, ("phone", "call", "mobile", "tel"), lambda v: F.length(checks.digits(v)).between(8, 15), need=r"\+\d"),
    Pattern("PHONE_NUMBER", r"(?<![\w+-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-])", 0.75, ("phone", "call", "mobile", "tel"), need=r"\d{3}[-.)]"),
    # the North American plan: area and exchange codes open with 2 to 9
    Pattern("PHONE_NUMBER", r"(?<![\w+-])(?:[2-9]\d\d){2}\d{4}(?![\w-])", 0.3, ("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "text", "dial", "number"), need=r"\d{10}"),
    # numeric dates of ISO 8601 and of common use, with one separator throughout
    Pattern(
        "DATE_OF_BIRTH", r"(?<!\d)(?:(?:19|20)\d\d(?:-\d\d?-|/\d\d?/|\.\d\d?\.)\d\d?|\d\d?(?:-\d\d?-|/\d\d?/|\.\d\d?\.)(?:19|20)\d\d)(?!\d)", 0.1, ("born", "birth", "birthday", "birthdate", "dob", "geboren", "née", "né", "nacido", "nacida"), _birth,
        need=r"\d[-/.]\d{1,2}[-/.]\d",
    ),
    # a house number, a street's words, and one of the postal service's kinds of street
    Pattern("ADDRESS", r"(?<![\w-])\d{1,6}[A-Z]?\s(?:[NSEW]{1,2}\.?\s)?(?:[A-Z][a-z]+\.?\s){1,4}(?:St(?:reet)?|Ave(?:nue)?|R(?:oa)?d|(?:Lane|Ln)|Dr(?:ive)?|(?:Boulevard|Blvd)|C(?:our)?t|W(?:a)?y|Pl(?:ace)?|Sq(?:uare)?)\b", 0.6, need=r"\d[A-Z]?\s"),
    Pattern("ADDRESS", r"(?i)\bP\.? ?O\.? ?Box \d{1,6}\b", 0.6, need=r"(?i)\bbox\b"),
    Pattern("MRZ", r"(?<![A-Z0-9<])[A-Z0-9<]{44}\n[A-Z0-9<]{44}(?![A-Z0-9<])|(?<![A-Z0-9<])(?:[A-Z0-9<]{30}\n){2}[A-Z0-9<]{30}(?![A-Z0-9<])", 0.97, need=r"<<"),
    # account numbers have 8 to 17 digits in the clearing house's files
    Pattern("US_BANK_NUMBER", r"(?<![\w.-])\d{8,17}(?![\w-])", 0.05, ("account", "acct", "bank", "checking", "savings"), need=r"\d{8}"),
    Pattern("US_DRIVER_LICENSE", r"\b[A-Z]\d{6,12}\b", 0.1, ("driver", "license", "licence", "dl", "driving"), need=r"[A-Z]\d{6}"),
    Pattern("US_PASSPORT", r"\b[A-Z]?\d{8,9}\b", 0.05, ("passport",), need=r"\d{8}"),
    Pattern("CRYPTO", r"\b(?:bc1[02-9ac-hj-np-z]{25,62}|0x[0-9a-fA-F]{40})\b", 0.9, need=r"\bbc1|\b0x"),
    Pattern("USERNAME", r"(?<=(?:/Users/|/home/|C:\\Users\\))(?!(?:Shared|Public|Default|root|admin|runner|ubuntu)\b)[A-Za-z][\w.-]{1,31}", 0.9, need=r"/Users/|/home/|Users"),
    Pattern("PERSON", r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? )\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}", 0.9, need=r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\b"),
    Pattern("PERSON", r"(?<=\b(?:From|To|Cc): )\p{Lu}[\p{L}'’.-]+(?: \p{Lu}[\p{L}'’.-]+){1,3}(?= ?<)", 0.9, need=r"(?:From|To|Cc): "),
    Pattern("PERSON", r"(?<=(?:Dear|Hi|Hello|Hallo|Bonjour|Hola) )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?=[,!])", 0.9, need=r"\b(?:Dear|Hi|Hello|Hallo|Bonjour|Hola) "),
    Pattern("PERSON", r"(?<=\b(?:née|geb\.) )\p{Lu}\p{Ll}+", 0.9, need=r"née|geb\."),
    Pattern("AGE", r"(?i)(?<=\b(?:aged|age:) )\d{1,3}\b", 0.8, need=r"(?i)\bage"),
    Pattern("LAST_DIGITS", r"(?i)(?<=\bending (?:in|with) )\d{4}\b", 0.8, need=r"(?i)ending "),
    Pattern("SECRET", r"(?i)(?<=\b(?:cvv|cvc|pin)(?: is|:)? )\d{3,6}\b", 0.9, need=r"(?i)\b(?:cvv|cvc|pin)\b"),
    *(Pattern("RECORD_ID", form, 0.8, need=need) for form, need, _ in records.IDS),
)
#: Patterns of things that are no one's; what a span of these covers is no finding of other kinds.
STANDARDS = r"\b(?:RFC ?\d{3,5}|ISO(?:/IEC)? ?\d{3,5}(?:-\d+)?|IEEE ?\d{3,4}(?:\.\d+)*|CVE-\d{4}-\d{4,7})\b"
LINKS = r"\b(?:https?://|www\.)[^\s<>\"')\]]+"
TIME_ZONES = r"\b(?:Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Z][A-Za-z_]+(?:/[A-Z][A-Za-z_]+)?\b"
#: Kinds that do not stand inside links.
NOT_IN_LINKS = ("PERSON", "ADDRESS", "LOCATION", "EMPLOYER", "PHONE_NUMBER")


def _choice(at: Column, values: Sequence[Column]) -> Column:
    """The value of a match's pattern."""
    return F.element_at(F.array(*values), at + 1)


def _scored(m: Column, bank: Sequence[Pattern], base: Column, words: Sequence[Sequence[str]], reach: int) -> Column:
    named = F.arrays_overlap(F.slice(m["near"], 1, reach), _choice(m["pattern"], [keys.literals(w) if w else F.expr("cast(array() as array<string>)") for w in words]))
    return F.when(F.coalesce(named, F.lit(False)), F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), base + LIFT))).otherwise(base)


def _span(m: Column, entity: Column, score: Column) -> Column:
    return F.struct(m["start"].alias("start"), m["end"].alias("end"), entity.alias("entity"), score.alias("score"), m["value"].alias("value"))


def _of_bank(found: Column, bank: Sequence[Pattern]) -> Column:
    """Scored and checked spans of the bank's matches."""
    base = lambda m: _choice(m["pattern"], [F.lit(float(p.score)) for p in bank])
    spans = F.transform(found, lambda m: F.struct(m["pattern"].alias("pattern"), _span(m, _choice(m["pattern"], [F.lit(p.entity) for p in bank]), _scored(m, bank, base(m), [p.words for p in bank], NEAR)).alias("s")))

    def valid(x: Column) -> Column:
        out = F.lit(True)
        for i, p in enumerate(bank):
            if p.valid is not _any:
                out = F.when(x["pattern"] == i, F.coalesce(p.valid(x["s"]["value"]), F.lit(False))).otherwise(out)
        return out

    return F.transform(F.filter(spans, lambda x: (x["s"]["score"] >= FLOOR) & valid(x)), lambda x: x["s"])


def _of_registry(found: Column, registry: Sequence[identifiers.Identifier], first: int) -> Column:
    """Identifiers that pass their check: score 1 where a naming word stands before, 0.85 where the form tells by itself."""
    at = lambda m: m["pattern"] - first
    base = lambda m: _choice(at(m), [F.lit(0.85 if k.alone else float(k.base)) for k in registry])

    def one(m: Column) -> Column:
        named = F.arrays_overlap(m["near"], _choice(at(m), [keys.literals(k.keys) for k in registry]))
        return _span(m, _choice(at(m), [F.lit(k.entity) for k in registry]), F.when(named, F.lit(1.0)).otherwise(base(m)))

    return F.filter(F.transform(F.filter(found, lambda m: identifiers.passes(at(m), m["value"], registry)), one), lambda s: s["score"] >= FLOOR)


def _form(pattern: Pattern) -> tuple[str, str | None, bool]:
    return pattern.pattern, pattern.need, bool(pattern.words)


def _searched(df: DataFrame, text: str, forms: Sequence[tuple[str, str | None, bool]], spans: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``spans`` made from the matches of ``forms`` in its column ``text``."""
    found = df.withColumn("found__", scan.matches(F.col(text), forms).alias("found__"))
    return found.select(*(F.col(f"`{c}`") for c in df.columns), spans(F.col("found__")).alias("spans"))


def find_all(df: DataFrame, bank: Sequence[Pattern], text: str = "text") -> DataFrame:
    """``df`` with ``spans``: scored and checked ones of some patterns, not resolved."""
    return _searched(df, text, [*map(_form, bank)], lambda found: _of_bank(found, bank))


def find_identifiers(df: DataFrame, registry: Sequence[identifiers.Identifier] = identifiers.REGISTRY, text: str = "text") -> DataFrame:
    """``df`` with ``spans`` of the registry's identifiers."""
    return _searched(df, text, [(k.form, None, True) for k in registry], lambda found: _of_registry(found, registry, 0))


def outside(found: Column, taken: Column, entities: Sequence[str] | None = None) -> Column:
    """Spans that share no character with ``taken`` ones (only those of ``entities``, if given, are held to it)."""

    def free(s: Column) -> Column:
        clear = ~F.exists(taken, lambda t: S.overlap(t, s))
        return clear if entities is None else clear | ~s["entity"].isin(*entities)

    return F.filter(found, free)


def detect(df: DataFrame, bank: Sequence[Pattern] = BANK, with_identifiers: bool = False, text: str = "text") -> DataFrame:
    """``df`` with ``spans``: the resolved spans of its texts, each of which is read once for all patterns. A null text has none."""
    registry = identifiers.REGISTRY if with_identifiers else ()
    guards = [(STANDARDS, r"RFC|ISO|IEEE|CVE", False), (TIME_ZONES, "/[A-Z]", False), (LINKS, r"://|www\.", False)]
    n, r = len(bank), len(bank) + len(guards)

    def resolved(found: Column) -> Column:
        spans = _of_bank(F.filter(found, lambda m: m["pattern"] < n), bank)
        if registry:
            spans = F.concat(spans, _of_registry(F.filter(found, lambda m: m["pattern"] >= r), registry, r))
        spans = outside(spans, F.filter(found, lambda m: m["pattern"].isin(n, n + 1)))
        return S.resolve(outside(spans, F.filter(found, lambda m: m["pattern"] == n + 2), NOT_IN_LINKS))

    return _searched(df, text, [*map(_form, bank), *guards, *((k.form, None, True) for k in registry)], resolved)


def detect_leaves(leaves: DataFrame, bank: Sequence[Pattern] = BANK) -> DataFrame:
    """``leaves`` (text, key, ...) with ``spans``: the whole value where its key says what it is and the value fits, else what its text shows.

    Each distinct (key, text) is read once, so repeated values cost one detection.
    """
    hint = keys.hint(F.col("key"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), hint.alias("entity"), F.lit(1.0).alias("score"), F.col("text").alias("value")))
    fits = F.coalesce(hint.isNotNull() & (F.length("text") > 0) & keys.fits(hint, F.col("text")), F.lit(False))
    distinct = leaves.select("key", "text").distinct().select("key", "text", F.when(fits, whole).when(keys.structural(F.col("key")), F.filter(whole, lambda s: F.lit(False))).alias("told"))
    read = detect(distinct.withColumn("prose", F.when(F.col("told").isNull(), F.col("text"))), bank, text="prose")
    read = read.select(F.col("key").alias("read_key"), F.col("text").alias("read_text"), F.coalesce("told", "spans").alias("spans"))
    return leaves.join(large(read), F.col("key").eqNullSafe(F.col("read_key")) & (F.col("text") == F.col("read_text")), "left").drop("read_key", "read_text")
