"""Readers of structure inside text: links, labelled lines, pairs, cookies, connection strings, machine-readable zones, written dates, address lines, languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks, draw, keys
from ..functions import spans as S

# Path segments after which a person's name or id stands, and parameters that let their bearer in.
PEOPLE = "users user u customers customer members member people profiles profile accounts account patients employees authors contacts".split()
BEARER = "token access_token id_token refresh_token sig signature auth api_key apikey key secret password code session sessionid sid jwt".split()
_PAGES = "new edit search settings list all me login logout sign_in sign_up register index export import".split()

_EMPTY = "array<struct<part: string, name: string, value: string>>"


def links(text: Column) -> Column:
    """Places of links in a text."""
    return S.matches(text, r"\b(?:https?://|www\.)[^\s<>\"')\]]+")


def components(url: Column) -> Column:
    """A link's parts as struct<part, name, value>: user info, path segments named by the one before, query and fragment parameters; values are decoded."""
    body = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    authority, rest = F.regexp_extract(body, r"^([^/?#]*)", 1), F.regexp_extract(body, r"^[^/?#]*(.*)$", 1)
    segments = F.filter(F.split(F.regexp_extract(rest, r"^([^?#]*)", 1), "/"), lambda s: s != "")
    decode = lambda v: F.coalesce(F.try_url_decode(v), v)

    def pair(part: str):
        return lambda p: F.struct(F.lit(part).alias("part"), F.lower(F.substring_index(p, "=", 1)).alias("name"), decode(F.regexp_extract(p, "=(.*)$", 1)).alias("value"))

    user = F.regexp_extract(authority, r"^([^@]*)@", 1)
    none = F.array().cast(_EMPTY)
    return F.concat(
        F.when(user != "", F.array(F.struct(F.lit("user").alias("part"), F.lit("").alias("name"), user.alias("value")))).otherwise(none),
        F.transform(segments, lambda s, i: F.struct(F.lit("path").alias("part"), F.when(i > 0, F.lower(F.get(segments, i - 1))).otherwise(F.lit("")).alias("name"), decode(s).alias("value"))),
        F.transform(F.filter(F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&"), lambda p: p.contains("=")), pair("query")),
        F.transform(F.filter(F.split(F.regexp_extract(rest, r"#(.*)$", 1), "&"), lambda p: p.contains("=")), pair("fragment")),
    )


def personal(component: Column) -> Column:
    """The entity of a link's part, else null: bearer parameters, parameters with personal keys, what stands after people, ``@handle`` and ``~user``."""
    name, value, part = component["name"], component["value"], component["part"]
    named = keys.hint(name)
    after = (part == "path") & name.isin(*PEOPLE) & ~F.lower(value).isin(*_PAGES) & (F.length(value) >= 3) & ~value.rlike(r"^[0-9]{1,4}$")
    return (
        F.when(part == "user", F.lit("USERNAME"))
        .when((part == "path") & value.rlike(r"^[@~][A-Za-z][\w.-]{2,}$"), F.lit("USERNAME"))
        .when(after, F.when(value.contains("@"), "EMAIL_ADDRESS").otherwise("USERNAME"))
        .when(part.isin("query", "fragment") & name.isin(*BEARER) & (F.length(value) >= 6), F.lit("SECRET"))
        .when(part.isin("query", "fragment") & named.isNotNull() & keys.fits(named, value), named)
        .when(part.isin("query", "fragment") & value.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]+$"), F.lit("EMAIL_ADDRESS"))
    )


def _tail(m: Column, value: Column, entity: Column, score: float) -> Column:
    """A span of the end of a match."""
    return F.struct((m["end"] - F.length(value)).alias("start"), m["end"].alias("end"), entity.alias("entity"), F.lit(score).alias("score"), value.alias("value"))


def labelled(text: Column) -> Column:
    """Spans of ``Label: value`` lines and ``| label | value |`` rows whose label says what the value is."""
    line = r"(?m)^[ \t>*-]{0,6}\**[\p{L}][\p{L}\p{N} ./_-]{1,40}\**:\**[ \t]+[^\s].*?(?=[ \t]*$)"
    row = r"(?m)^\|[ \t]*[\p{L}][\p{L}\p{N} ./_-]{1,40}[ \t]*\|[ \t]*[^|\s][^|\n]*?(?=[ \t]*\|)"

    def read(pattern: str, label: str, value: str) -> Column:
        found = F.transform(S.matches(text, pattern), lambda m: _tail(m, F.regexp_extract(m["value"], value, 1), keys.hint(F.regexp_replace(F.regexp_extract(m["value"], label, 1), r"\*", "")), 0.9))
        return F.filter(found, lambda s: s["entity"].isNotNull() & (s["value"] != "") & F.coalesce(keys.fits(s["entity"], s["value"]), F.lit(False)))

    return F.concat(read(line, r"^[ \t>*-]*(.*?):", r":\**[ \t]+(.*)$"), read(row, r"^\|[ \t]*(.*?)[ \t]*\|", r"^\|[^|]*\|[ \t]*(.*)$"))


def pairs(text: Column) -> Column:
    """Spans of values in object literals, settings and assignments (``"key": "value"``, ``key: 'value'``, ``KEY=value``) whose key says what they are."""
    quoted = r"""["']?[A-Za-z_][\w.-]+["']?\s{0,3}(?:=>|[:=])\s{0,3}["'][^"'\n]+(?=["'])"""
    bare = r"(?m)^(?:export )?[A-Z][A-Z0-9_]+=[^\s\"'#]+"

    def read(pattern: str, value: str) -> Column:
        found = F.transform(S.matches(text, pattern), lambda m: _tail(m, F.regexp_extract(m["value"], value, 1), keys.hint(F.regexp_extract(m["value"], r"^(?:export )?[\"']?([A-Za-z_][\w.-]*)", 1)), 0.95))
        return F.filter(found, lambda s: s["entity"].isNotNull() & F.coalesce(keys.fits(s["entity"], s["value"]), F.lit(False)))

    return F.concat(read(quoted, r"""(?s)[:=>]\s{0,3}["']([^"'\n]*)$"""), read(bare, "=(.*)$"))


def cookies(text: Column) -> Column:
    """Spans of the values of a ``Cookie:`` or ``Set-Cookie:`` line that let their bearer in or name someone; settings stay."""
    # the line is looked at only where a value may begin, else each of its characters would be behind every other
    found = S.matches(text, r"(?im)(?<=[ ;])(?=[\w.-]{2,40}=[^;\s]{6})(?<=^(?:set-)?cookie:[^\n]{0,800}[ ;])[\w.-]{2,40}=[^;\s]{6,}")
    named = F.filter(found, lambda m: F.regexp_extract(m["value"], "^([^=]*)", 1).rlike(r"(?i)sess|sid|token|auth|jwt|csrf|user|email|login"))
    return F.transform(named, lambda m: _tail(m, F.regexp_extract(m["value"], "=(.*)$", 1), F.lit("SECRET"), 0.9))


def connection_strings(text: Column) -> Column:
    """Spans of passwords, keys and users in ``k=v;`` strings and of credentials before a host."""
    secret = S.matches(text, r"(?i)\b(?:password|pwd|accountkey|sharedaccesskey)=[^;\s\"']{3,}")
    user = S.matches(text, r"(?i)\b(?:user id|uid|username)=[^;\s\"']{2,}")
    login = S.matches(text, r"(?<=[a-z]://[^\s/@:]{1,60}:)[^\s/@]{3,}(?=@)")
    value = lambda entity: lambda m: _tail(m, F.regexp_extract(m["value"], "=(.*)$", 1), F.lit(entity), 0.9)
    return F.concat(F.transform(secret, value("SECRET")), F.transform(user, value("USERNAME")), F.transform(login, lambda m: _tail(m, m["value"], F.lit("SECRET"), 0.9)))


def mrz(line: Column) -> Column:
    """The second line of a passport's machine-readable zone with all its check digits right: struct<number, country, birth, sex, expiry>, else null."""
    part = lambda a, n: F.substring(line, a, n)
    check = lambda a, n, c: checks.icao(part(a, n)).cast("string") == part(c, 1)
    whole = checks.icao(F.concat(part(1, 10), part(14, 7), part(22, 22))).cast("string") == part(44, 1)
    good = line.rlike("^[A-Z0-9<]{44}$") & check(1, 9, 10) & check(14, 6, 20) & check(22, 6, 28) & whole
    return F.when(good, F.struct(F.regexp_replace(part(1, 9), "<", "").alias("number"), part(11, 3).alias("country"), part(14, 6).alias("birth"), part(21, 1).alias("sex"), part(22, 6).alias("expiry")))


def mrz_rewritten(line: Column, seed: str, scope: Column | str) -> Column:
    """Such a line for a stand-in holder: number and birth date drawn anew, country, sex and expiry kept, all check digits made again."""
    h = draw.stream(seed, scope, "MRZ", line)
    number = draw.same_shape(F.substring(line, 1, 9), h)
    birth = F.concat(F.lpad((draw.number(h, 8) % 100).cast("string"), 2, "0"), F.lpad((draw.number(h, 16) % 12 + 1).cast("string"), 2, "0"), F.lpad((draw.number(h, 24) % 28 + 1).cast("string"), 2, "0"))
    digit = lambda v: checks.icao(v).cast("string")
    head = F.concat(number, digit(number), F.substring(line, 11, 3), birth, digit(birth), F.substring(line, 21, 1), F.substring(line, 22, 7), F.substring(line, 29, 15))
    return F.concat(head, digit(F.concat(F.substring(head, 1, 10), F.substring(head, 14, 7), F.substring(head, 22, 22))))


# Months in four languages.
MONTHS = [
    ("january", "januar", "janvier", "enero"), ("february", "februar", "fevrier", "febrero"), ("march", "marz", "mars", "marzo"), ("april", "april", "avril", "abril"), ("may", "mai", "mai", "mayo"), ("june", "juni", "juin", "junio"),
    ("july", "juli", "juillet", "julio"), ("august", "august", "aout", "agosto"), ("september", "september", "septembre", "septiembre"), ("october", "oktober", "octobre", "octubre"), ("november", "november", "novembre", "noviembre"), ("december", "dezember", "decembre", "diciembre"),
]


def written_date(value: Column) -> Column:
    """The day that a date with a month's name stands for, in English, German, French or Spanish, else null."""
    v = keys.plain(value)
    table = F.create_map(*(F.lit(x) for pair in {w: i + 1 for i, names in enumerate(MONTHS) for w in names}.items() for x in pair))
    month = F.element_at(table, F.regexp_extract(v, "(" + "|".join(sorted({w for names in MONTHS for w in names}, key=len, reverse=True)) + ")", 1))
    numbers = F.transform(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    year = F.get(F.filter(numbers, lambda n: n >= 1000), F.lit(0))
    day = F.get(F.filter(numbers, lambda n: n <= 31), F.lit(0))
    spelled = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(month.isNotNull() & year.isNotNull() & day.isNotNull(), F.try_to_date(spelled, "yyyy-MM-dd"))


def address_layout(value: Column) -> Column:
    """The pieces of an address line as struct<role, text>: unit, street, place, postcode, country."""
    pieces = F.filter(F.transform(F.split(value, r"[,\n]"), lambda p: F.trim(p)), lambda p: p != "")
    role = lambda p: (
        F.when(p.rlike(r"(?i)^(apt|apartment|unit|suite|ste|floor|flat|#)\b.*|^#\s*\d+"), "unit")
        .when(p.rlike(r"(?i)^p\.? ?o\.? ?box"), "street")
        .when(p.rlike(r"^\d{1,6}[A-Za-z]?\s+\p{L}") | p.rlike(r"\p{L}.*\s\d{1,5}[a-z]?$") & ~p.rlike(r"\b\d{5}$"), "street")
        .when(p.rlike(r"^[A-Z]{2}\s+\d{5}(-\d{4})?$") | p.rlike(r"^\d{4,6}(\s|$)") | p.rlike(r"(?i)^[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$"), "postcode")
        .when(F.lower(p).isin("usa", "united states", "uk", "united kingdom", "germany", "deutschland", "france", "spain", "españa", "italy", "canada", "australia", "netherlands"), "country")
        .otherwise("place")
    )
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), p.alias("text")))


# Small words that tell languages apart, and family names that lead names in Han characters.
STOP = {"en": "the of and to in is that with was for", "de": "der die und das ist mit den von nicht ein", "fr": "le la les et des est dans une que pour", "es": "el los las del una por con para que es"}
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗김이박최정강조윤장임"


def language(text: Column, least: int = 3) -> Column:
    """The language whose small words a text has most of (``least`` at least; ties go to the earlier one), else null."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")
    scores = [F.struct(F.size(_in(w, s)).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, s) in enumerate(STOP.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] >= least, best["name"])


def _in(words: Column, some: str) -> Column:
    return F.filter(words, lambda x: x.isin(*some.split()))


def han_or_hangul_name(value: Column) -> Column:
    """Two to four Han or Hangul characters that a common family name leads."""
    return value.rlike(rf"^[{SURNAMES}](?:\p{{IsHan}}{{1,3}}|\p{{IsHangul}}{{1,3}})$")


def windows(tokens: Column, size: int = 128, stride: int = 96) -> Column:
    """A text's tokens in overlapping windows of struct<first, tokens>, the last one as long as it comes."""
    n = F.size(tokens)
    count = F.greatest(F.lit(1), (F.ceil((n - size) / F.lit(stride)) + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).alias("first"), F.slice(tokens, i * stride + 1, F.lit(size)).alias("tokens")))


def first_window_wins(read: DataFrame) -> DataFrame:
    """One row for each (leaf_id, token) of ``read`` (leaf_id, token, first, label): the label of the earliest window."""
    w = Window.partitionBy("leaf_id", "token").orderBy("first")
    return read.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def quality(truth: DataFrame, found: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """(by..., n, caught, recall) of labelled spans (leaf_id, start, end, label) that found spans cover whole."""
    t, f = truth.alias("t"), found.alias("f")
    met = (F.col("t.leaf_id") == F.col("f.leaf_id")) & (F.col("f.start") <= F.col("t.start")) & (F.col("t.end") <= F.col("f.end"))
    caught = t.join(f, met, "left_semi").select(*truth.columns).withColumn("hit", F.lit(1)).distinct()
    return truth.join(caught, truth.columns, "left").groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("caught")).withColumn("recall", F.col("caught") / F.col("n"))
