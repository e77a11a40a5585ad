"""Stand-ins drawn by a keyed hash: the same original takes the same stand-in everywhere in its scope, whatever the partitioning.

The stream of a draw is the SHA-256 of seed, scope, kind, canonical value and attempt; its hexadecimal digits choose digits, letters and
list entries. A draw that equals its original moves to the next attempt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dealt
from . import checks, keys
from .keys import once

ATTEMPTS = 3

# Names of stand-ins.
FIRST = "Avery Blake Casey Devon Ellis Frankie Greer Harper Indra Jules Kerry Lennox Marlow Noel Oakley Parker Quinn Reese Sasha Tatum Umber Vesper Wren Yael Zuri".split()
LAST = "Abbot Barlow Carver Dalton Easton Farrow Garland Hadley Ingram Jarvis Keller Langley Mercer Norwood Osborn Prescott Quimby Rowland Sawyer Thorne Underhill Vance Whitlow Yardley Zeller".split()
PLACES = [
    ("Albany", "NY", "12207", "518", "America/New_York", 42.65, -73.75), ("Boise", "ID", "83702", "208", "America/Boise", 43.62, -116.20), ("Dayton", "OH", "45402", "937", "America/New_York", 39.76, -84.19),
    ("Eugene", "OR", "97401", "541", "America/Los_Angeles", 44.05, -123.09), ("Fresno", "CA", "93721", "559", "America/Los_Angeles", 36.74, -119.79), ("Lansing", "MI", "48933", "517", "America/Detroit", 42.73, -84.56),
    ("Macon", "GA", "31201", "478", "America/New_York", 32.84, -83.63), ("Pueblo", "CO", "81003", "719", "America/Denver", 38.25, -104.61), ("Tulsa", "OK", "74103", "918", "America/Chicago", 36.15, -95.99), ("Waco", "TX", "76701", "254", "America/Chicago", 31.55, -97.15),
]
STREETS = "Alder Birch Cedar Dogwood Elm Fir Hazel Juniper Larch Maple Oak Pine Rowan Spruce Willow".split()
COMPANIES = "Arden Bexley Corvid Dunmore Everly Fenwick Garrick Holloway Ivers Jessop Kestrel Lorimer".split()
DOMAINS = ("example.com", "example.net", "example.org")


def stream(seed: str, scope: Column | str, kind: str, canonical: Column, attempt: Column | int = 0) -> Column:
    """64 hexadecimal digits for one draw."""
    scope = F.lit(scope) if isinstance(scope, str) else scope.cast("string")
    attempt = F.lit(str(attempt)) if isinstance(attempt, int) else attempt.cast("string")
    return F.sha2(F.concat_ws("\u0000", F.lit(seed), F.coalesce(scope, F.lit("")), F.lit(kind), canonical, attempt), 256)


def number(hexes: Column, at: int, width: int = 8) -> Column:
    """``width`` (at most 12) hexadecimal digits from ``at`` as a number."""
    return F.conv(F.substring(hexes, at + 1, width), 16, 10).cast("long")


def pick(hexes: Column, at: int, items: list) -> Column:
    """An entry of a list."""
    chosen = F.element_at(keys.literals(items), (number(hexes, at) % len(items) + 1).cast("int"))
    return chosen if isinstance(items[0], str) else chosen.cast("double")


def drawn_digits(hexes: Column, count: int, at: int = 0) -> Column:
    """``count`` digits, each from two hexadecimal digits."""
    codes = F.sequence(F.lit(0), F.lit(count - 1))
    return once(hexes, lambda h: F.concat_ws("", F.transform(codes, lambda i: (F.conv(F.substring(h, (i * 2 + at) % 62 + 1, F.lit(2)), 16, 10).cast("int") % 10).cast("string"))))


def pour(original: Column, new: Column) -> Column:
    """The digits of ``new`` in the places of the digits of ``original``."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(s: Column, c: Column, made: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.when(digit, s["n"] + 1).otherwise(s["n"]).alias("n"), F.concat(s["out"], F.when(digit, F.substring(made, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return once(new, lambda made: F.aggregate(F.split(original, ""), start, lambda s, c: step(s, c, made), lambda s: s["out"]))


def same_shape(original: Column, hexes: Column) -> Column:
    """Every digit, lower and upper letter drawn anew, all else kept."""

    def one(c: Column, i: Column, h: Column) -> Column:
        n = F.conv(F.substring(h, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int") + i
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), letter).when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c)

    return once(hexes, lambda h: F.concat_ws("", F.transform(F.split(original, ""), lambda c, i: one(c, i, h))))


def hex_shape(original: Column, hexes: Column) -> Column:
    """Every hexadecimal digit drawn anew in its case, all else kept."""

    def one(c: Column, i: Column, h: Column) -> Column:
        new = F.substring(h, i % 64 + 1, F.lit(1))
        return F.when(c.rlike("^[0-9a-f]$"), new).when(c.rlike("^[A-F]$"), F.upper(new)).otherwise(c)

    return once(hexes, lambda h: F.concat_ws("", F.transform(F.split(original, ""), lambda c, i: one(c, i, h))))


def first_new(original: Column, draw: Callable[[Column | int], Column]) -> Column:
    """The first attempt's draw that differs from the original, the last one if none does."""
    differs = lambda x: F.lower(x) != F.lower(original)
    more = F.transform(keys.literals(range(1, ATTEMPTS)), draw)
    rest = F.coalesce(F.get(F.filter(more, differs), F.lit(0)), F.element_at(more, -1))
    # the first draw is bound by a lambda, so that it is made once; the others are made only where it will not do
    return F.get(F.transform(F.array(draw(0)), lambda x: F.when(differs(x), x).otherwise(rest)), F.lit(0))


def email(original: Column, seed: str, scope: Column | str) -> Column:
    """A name at an example domain; a role mailbox keeps its local part."""
    canonical = F.lower(original)
    local = F.substring_index(original, "@", 1)

    def draw(attempt):
        h = stream(seed, scope, "EMAIL_ADDRESS", canonical, attempt)
        name = F.concat(F.lower(pick(h, 0, FIRST)), F.lit("."), F.lower(pick(h, 8, LAST)), F.lit("."), (number(h, 16) % 10000).cast("string"))
        return F.concat(F.when(role_mailbox(original), local).otherwise(name), F.lit("@"), pick(h, 24, list(DOMAINS)))

    return first_new(original, draw)


# Local parts that name a function rather than a person.
ROLES = "abuse accounts admin billing careers contact customer-service customerservice devops help hello helpdesk hostmaster hr info jobs legal mail marketing newsletter no-reply noreply notifications office ops ops-team orders postmaster press privacy sales security service support team webmaster".split()


def role_mailbox(value: Column) -> Column:
    return F.lower(F.substring_index(value, "@", 1)).isin(*ROLES)


def phone(original: Column, seed: str, scope: Column | str) -> Column:
    """North American numbers become an area code of a stand-in place and 555-01xx; others keep calling code and first digit. The layout stays."""
    d = checks.digits(original)
    national = F.when(F.length(d) == 11, F.substring(d, 2, 10)).otherwise(d)

    def draw(attempt):
        h = stream(seed, scope, "PHONE_NUMBER", national, attempt)
        home = F.concat(pick(h, 0, [p[3] for p in PLACES]), F.lit("55501"), F.lpad((number(h, 8) % 100).cast("string"), 2, "0"))
        north = (F.length(d) == 10) | ((F.length(d) == 11) & d.startswith("1"))
        abroad = F.concat(F.substring(d, 1, 3), F.substring(drawn_digits(h, 20), F.lit(1), F.length(d) - 3))
        return pour(original, F.when(north, F.concat(F.when(F.length(d) == 11, F.lit("1")).otherwise(F.lit("")), home)).otherwise(abroad))

    return first_new(original, draw)


def check_digit(stem: Column) -> Column:
    """The digit that makes stem and digit pass the mod-10 check."""
    return once(stem, lambda s: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: checks.luhn(F.concat(s, d))), 1))


def card(original: Column, seed: str, scope: Column | str) -> Column:
    """Network, length and grouping stay, and so does the check."""
    d = checks.digits(original)

    def draw(attempt):
        h = stream(seed, scope, "CREDIT_CARD", d, attempt)
        stem = F.concat(F.substring(d, 1, 4), F.substring(drawn_digits(h, 20), F.lit(1), F.length(d) - 5))
        return pour(original, once(stem, lambda s: F.concat(s, check_digit(s))))

    return first_new(original, draw)


def ip(original: Column, seed: str, scope: Column | str) -> Column:
    """An address of the documentation range of its family."""

    def draw(attempt):
        h = stream(seed, scope, "IP_ADDRESS", F.lower(original), attempt)
        six = F.concat(F.lit("2001:db8::"), F.lower(F.substring(h, 1, 4)), F.lit(":"), F.lower(F.substring(h, 5, 4)))
        return F.when(original.contains(":"), six).otherwise(F.concat(F.lit("203.0.113."), (number(h, 0) % 254 + 1).cast("string")))

    return first_new(original, draw)


def ssn(original: Column, seed: str, scope: Column | str) -> Column:
    """An issuable number in the same layout."""
    d = checks.digits(original)

    def draw(attempt):
        h = stream(seed, scope, "US_SSN", d, attempt)
        area = number(h, 0) % 898 + 1
        parts = (F.when(area >= 666, area + 1).otherwise(area), 3), (number(h, 8) % 99 + 1, 2), (number(h, 16) % 9999 + 1, 4)
        return pour(original, F.concat(*(F.lpad(n.cast("string"), w, "0") for n, w in parts)))

    return first_new(original, draw)


def secret(original: Column, seed: str, scope: Column | str) -> Column:
    """Short digits stay digits, hexadecimal and UUID forms stay, a vendor prefix stays before 24 new characters."""
    canonical = original

    def draw(attempt):
        h = stream(seed, scope, "SECRET", canonical, attempt)
        prefix = F.regexp_extract(original, r"^((?:sk|pk|rk)_(?:live|test)_|gh[pousr]_|xox[a-z]-|AKIA|glpat-)", 1)
        return (
            F.when(original.rlike("^[0-9]{1,8}$"), pour(original, drawn_digits(h, 8)))
            .when(original.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$") | original.rlike("^[0-9a-fA-F]{16,}$"), hex_shape(original, h))
            .otherwise(F.concat(prefix, F.substring(F.base64(F.unhex(h)).cast("string"), 1, 24)))
        )

    return first_new(original, draw)


def record_id(original: Column, seed: str, scope: Column | str, kind: str = "RECORD_ID") -> Column:
    """A type prefix and all character classes stay."""
    prefix = F.regexp_extract(original, r"^([A-Za-z]{2,8}[_#-])", 1)

    def draw(attempt):
        return F.concat(prefix, same_shape(F.substring(original, F.length(prefix) + 1, F.length(original)), stream(seed, scope, kind, original, attempt)))

    return first_new(original, draw)


def person(original: Column, seed: str, scope: Column | str) -> Column:
    """A first and a last name for a full name, one part for one; the case of all capitals stays."""
    canonical = F.lower(F.regexp_replace(F.trim(original), r"\s+", " "))

    def draw(attempt):
        h = stream(seed, scope, "PERSON", canonical, attempt)
        name = F.when(canonical.contains(" "), F.concat_ws(" ", pick(h, 0, FIRST), pick(h, 8, LAST))).otherwise(pick(h, 8, LAST))
        return F.when((original == F.upper(original)) & original.rlike(r"\p{Lu}"), F.upper(name)).otherwise(name)

    return first_new(original, draw)


def birth_date(original: Column, seed: str, scope: Column | str) -> Column:
    """ISO dates and three-part numeric dates move by 1 to 8 years and to a new day, spelled alike."""
    iso = F.try_to_date(original, "yyyy-MM-dd")
    slashed = F.try_to_date(original, "MM/dd/yyyy")
    day = F.coalesce(iso, slashed)
    h = stream(seed, scope, "DATE_OF_BIRTH", F.coalesce(day.cast("string"), original))
    years = F.when(number(h, 0) % 2 == 0, number(h, 8) % 8 + 1).otherwise(-(number(h, 8) % 8) - 1).cast("int")
    moved = F.make_date(F.year(day) + years, (number(h, 16) % 12 + 1).cast("int"), (number(h, 24) % 28 + 1).cast("int"))
    return F.when(iso.isNotNull(), F.date_format(moved, "yyyy-MM-dd")).when(slashed.isNotNull(), F.date_format(moved, "MM/dd/yyyy")).otherwise(same_shape(original, h))


def age(original: Column, shift: Column) -> Column:
    """An age moves against its birth year."""
    return (original.cast("int") - F.coalesce(shift, F.lit(0))).cast("string")


def iban(original: Column, seed: str, scope: Column | str) -> Column:
    """Country and layout stay; check digits are made anew."""
    v = F.upper(F.regexp_replace(original, "[ .-]", ""))

    def draw(attempt):
        body = same_shape(F.substring(v, 5, 64), stream(seed, scope, "IBAN_CODE", v, attempt))
        check = F.lpad((F.lit(98) - checks.mod97(F.concat(body, F.substring(v, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        flat = F.concat(F.substring(v, 1, 2), check, body)
        start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

        def step(s: Column, c: Column) -> Column:
            solid = c.rlike("^[A-Za-z0-9]$")
            return F.struct(F.when(solid, s["n"] + 1).otherwise(s["n"]).alias("n"), F.concat(s["out"], F.when(solid, F.substring(flat, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(F.split(original, ""), start, step, lambda s: s["out"])

    return first_new(original, draw)


def place(original: Column, seed: str, scope: Column | str, part: int) -> Column:
    """City (0), region (1), postcode (2), area code (3), zone (4), latitude (5) or longitude (6) of the stand-in place of a canonical original."""
    h = stream(seed, scope, "LOCATION", F.lower(F.trim(original)))
    return pick(h, 0, [p[part] for p in PLACES])


def address(original: Column, seed: str, scope: Column | str) -> Column:
    """House number in as many digits, a stand-in street with the kind of street kept."""
    h = stream(seed, scope, "ADDRESS", F.lower(F.trim(original)))
    kind = F.regexp_extract(original, r"(?i)\b(street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|way|place|pl|square|sq)\b\.?", 1)
    house = F.regexp_extract(original, r"^\s*([0-9]+)", 1)
    return F.concat_ws(" ", F.when(house != "", pour(house, F.concat((number(h, 0) % 9 + 1).cast("string"), drawn_digits(h, 8, 10)))), pick(h, 8, STREETS), F.when(kind != "", kind).otherwise(F.lit("Street")))


def employer(original: Column, seed: str, scope: Column | str) -> Column:
    """An invented company with the legal form of the original."""
    h = stream(seed, scope, "EMPLOYER", F.lower(original))
    form = F.regexp_extract(original, r"(?i)\b(inc|llc|ltd|gmbh|ag|sa|bv|plc|corp|co)\b\.?$", 0)
    return F.trim(F.concat_ws(" ", pick(h, 0, COMPANIES), F.when(form != "", form)))


def masked_tail(original: Column, stand_in: Column) -> Column:
    """A masked number (``***-**-7784``) that ends like the stand-in of the number it is the end of."""
    tail = F.regexp_extract(original, r"([0-9]{2,6})\D*$", 1)
    d = checks.digits(stand_in)
    return F.regexp_replace(original, F.concat(tail, F.lit(r"(?=\D*$)")), F.substring(d, F.length(d) - F.length(tail) + 1, F.length(tail)))


DRAWS: dict[str, Callable[[Column, str, Column | str], Column]] = {
    "EMAIL_ADDRESS": email,
    "PHONE_NUMBER": phone,
    "CREDIT_CARD": card,
    "IP_ADDRESS": ip,
    "US_SSN": ssn,
    "US_ITIN": lambda o, s, c: first_new(o, lambda a: pour(o, F.concat(F.lit("9"), drawn_digits(stream(s, c, "US_ITIN", checks.digits(o), a), 2), F.lit("70"), drawn_digits(stream(s, c, "US_ITIN", checks.digits(o), a), 4, 20)))),
    "SECRET": secret,
    "PERSON": person,
    "FIRST_NAME": lambda o, s, c: first_new(o, lambda a: pick(stream(s, c, "FIRST_NAME", F.lower(o), a), 0, FIRST)),
    "LAST_NAME": lambda o, s, c: first_new(o, lambda a: pick(stream(s, c, "LAST_NAME", F.lower(o), a), 0, LAST)),
    "DATE_OF_BIRTH": birth_date,
    "IBAN_CODE": iban,
    "LOCATION": lambda o, s, c: place(o, s, c, 0),
    "REGION": lambda o, s, c: place(o, s, c, 1),
    "POSTAL_CODE": lambda o, s, c: place(o, s, c, 2),
    "TIME_ZONE": lambda o, s, c: place(o, s, c, 4),
    "ADDRESS": address,
    "EMPLOYER": employer,
    "USERNAME": lambda o, s, c: first_new(o, lambda a: F.concat(F.lower(pick(stream(s, c, "USERNAME", F.lower(o), a), 0, FIRST)), drawn_digits(stream(s, c, "USERNAME", F.lower(o), a), 3, 20))),
    "RECORD_ID": record_id,
}


def drawn(entity: Column, original: Column, seed: str, scope: Column | str, kinds: Iterable[str] | None = None) -> Column:
    """The stand-in of a value of any kind; kinds without a draw of their own keep the value's shape. With ``kinds`` no others are planned for."""
    out = record_id(original, seed, scope, "ID_NUMBER")
    for name in DRAWS if kinds is None else sorted(DRAWS.keys() & set(kinds)):
        out = F.when(entity == name, DRAWS[name](original, seed, scope)).otherwise(out)
    return out


def stand_ins(values: DataFrame, seed: str, kinds: Iterable[str] | None = None) -> DataFrame:
    """(scope, entity, original) rows with their ``stand_in``, drawn once for each distinct value; ``kinds``, if given, must hold all kinds of theirs."""
    # dealt out last, by a fixed number: drawing costs more than its few bytes tell
    values = dealt(values.select("scope", "entity", "original").distinct(), "original")
    return values.withColumn("stand_in", drawn(F.col("entity"), F.col("original"), seed, F.col("scope"), kinds))


def _surnames(rank: Column) -> Column:
    """The digits of a rank, from 1, in base 25 as surnames joined by hyphens."""
    powers = F.array(*(F.lit(25**i) for i in range(8)))
    digits = F.transform(F.filter(powers, lambda p: p <= rank), lambda p: F.element_at(keys.literals(LAST), (F.floor(rank / p) % 25 + 1).cast("int")))
    return F.array_join(digits, "-")


def widened(entity: Column, stand_in: Column, rank: Column) -> Column:
    """The stand-in of the value that is number ``rank`` (from 0) among those that drew the same one: no two of a kind are alike.

    Names get further surnames, handles and local parts a number; phones count on from their line number in steps of a hundred (beyond the numbers kept for
    fiction where so many are drawn), addresses go on in the other ranges that documents and benchmarks may use, then in that of private networks;
    other kinds take the rank's digits at their end.
    """
    k = rank.cast("long")
    digits = checks.digits(stand_in)
    line = F.lpad(((F.substring(digits, -7, 7).try_cast("long") + k * 100) % 10_000_000).cast("string"), 7, "0")
    last = F.substring_index(stand_in, ".", -1)
    far = k - 1026
    four = (
        F.when(k == 1, F.concat(F.lit("198.51.100."), last))
        .when(k == 2, F.concat(F.lit("192.0.2."), last))
        .when(far < 0, F.concat_ws(".", F.lit("198"), (18 + F.floor((k - 3) / 512) % 2).cast("string"), ((k - 3) % 256).cast("string"), last))
        .otherwise(F.concat_ws(".", F.lit("10"), (F.floor(far / 256) % 256).cast("string"), (far % 256).cast("string"), last))
    )
    name = F.concat(stand_in, F.lit("-"), F.when(stand_in == F.upper(stand_in), F.upper(_surnames(k))).otherwise(_surnames(k)))
    wide = (
        F.when(entity.isin("PERSON", "FIRST_NAME", "LAST_NAME", "EMPLOYER", "LOCATION", "REGION", "ADDRESS"), name)
        .when(entity == "EMAIL_ADDRESS", F.concat(F.substring_index(stand_in, "@", 1), F.lit("."), k.cast("string"), F.lit("@"), F.substring_index(stand_in, "@", -1)))
        .when(entity == "USERNAME", F.concat(stand_in, F.lit("_"), k.cast("string")))
        .when((entity == "PHONE_NUMBER") & (F.length(digits) >= 10), pour(stand_in, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 7), line)))
        .when((entity == "IP_ADDRESS") & ~stand_in.contains(":"), four)
        .when(entity == "IP_ADDRESS", F.concat(stand_in, F.lit(":"), F.lower(F.hex(k))))
        .otherwise(F.concat(stand_in, F.lit("-"), k.cast("string")))
    )
    return F.when(k == 0, stand_in).otherwise(wide)


#: Kinds of which different values may take one stand-in: coarse by nature, or masks of another value.
COARSE = ("DATE_OF_BIRTH", "AGE", "LOCATION", "REGION", "POSTAL_CODE", "TIME_ZONE", "LAST_DIGITS", "EXPIRY_DATE", "SECRET")


def persona(person: Column, seed: str, scope: Column | str) -> Column:
    """struct<first, last, number> of a person told by a key: what all of that person's names, handles and addresses are made of."""
    h = stream(seed, scope, "PERSONA", F.lower(person))
    return F.struct(pick(h, 0, FIRST).alias("first"), pick(h, 8, LAST).alias("last"), (number(h, 16) % 10000).alias("number"))


def of_persona(entity: Column, original: Column, who: Column, seed: str, scope: Column | str) -> Column:
    """A value of a person as their persona has it: names, email, username, initials; null for kinds that do not follow a person."""
    first, last, n = who["first"], who["last"], who["number"].cast("string")
    # a lone word is a surname, if it is a word
    whole = F.when(original.contains(","), F.concat_ws(", ", last, first)).when(original.rlike(r"^[\p{L}'’-]+$"), last).otherwise(F.concat_ws(" ", first, last))
    local = F.when(role_mailbox(original), F.substring_index(original, "@", 1)).otherwise(F.lower(F.concat_ws(".", first, last, n)))
    made = (
        F.when(entity == "PERSON", whole)
        .when(entity == "FIRST_NAME", first)
        .when(entity == "LAST_NAME", last)
        .when(entity == "EMAIL_ADDRESS", F.concat(local, F.lit("@"), pick(stream(seed, scope, "DOMAIN", F.lower(F.substring_index(original, "@", -1))), 0, list(DOMAINS))))
        .when(entity == "USERNAME", F.lower(F.concat(F.substring(first, 1, 1), last, n)))
        .when(entity == "INITIALS", initials(original, F.concat_ws(" ", first, last)))
    )
    capital = entity.isin("PERSON", "FIRST_NAME", "LAST_NAME") & (original == F.upper(original)) & (F.length(original) > 1)
    return F.when(capital, F.upper(made)).otherwise(made)


def coordinates(latitude: Column, longitude: Column, original: Column, seed: str, scope: Column | str) -> Column:
    """struct<latitude, longitude>: the stand-in place of a canonical original (a city, or the point itself), each at the precision it had."""
    h = stream(seed, scope, "LOCATION", F.lower(F.trim(original)))

    def like(value: Column, part: int) -> Column:
        decimals = F.length(F.regexp_extract(value, r"\.([0-9]+)$", 1))
        point = pick(h, 0, [f"{p[part]:.2f}" for p in PLACES])
        jitter = drawn_digits(h, 12, 20)
        whole, tail = F.substring_index(point, ".", 1), F.concat(F.substring_index(point, ".", -1), jitter)
        return F.when(decimals > 0, F.concat(whole, F.lit("."), F.substring(tail, F.lit(1), decimals))).otherwise(whole)

    return F.struct(like(latitude, 5).alias("latitude"), like(longitude, 6).alias("longitude"))


def expiry(original: Column, seed: str, scope: Column | str) -> Column:
    """``MM/YY`` or ``MM/YYYY`` a few years on, a real month, as wide as it was."""
    h = stream(seed, scope, "EXPIRY_DATE", original)
    month, year = F.lpad((number(h, 0) % 12 + 1).cast("string"), 2, "0"), F.regexp_extract(original, r"([0-9]{2}|[0-9]{4})$", 1)
    moved = F.lpad(F.pmod(year.try_cast("int") + (number(h, 8) % 4 + 1).cast("int"), F.pow(F.lit(10), F.length(year)).cast("int")).cast("string"), F.length(year), F.lit("0"))
    return F.concat(month, F.regexp_extract(original, r"^[0-9]{1,2}([^0-9]*)", 1), moved)


def numeric(original: Column, seed: str, scope: Column | str, kind: str = "ID_NUMBER") -> Column:
    """A number token of the same length that stays a number: no leading zero, sign and point where they were."""
    h = stream(seed, scope, kind, original)
    digits = checks.digits(original)
    first = (number(h, 60, 4) % 9 + 1).cast("string")
    return pour(original, F.concat(F.when(digits.startswith("0"), F.lit("0")).otherwise(first), drawn_digits(h, 31)))


def initials(original: Column, stand_in: Column) -> Column:
    """The initials of a stand-in name, dotted and spaced as the original ones."""
    letters = F.transform(F.split(stand_in, r"\s+"), lambda w: F.upper(F.substring(w, 1, 1)))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        letter = c.rlike(r"^\p{L}$")
        return F.struct(F.when(letter, s["n"] + 1).otherwise(s["n"]).alias("n"), F.concat(s["out"], F.when(letter, F.coalesce(F.get(letters, s["n"]), F.element_at(letters, -1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(original, ""), start, step, lambda s: s["out"])


def key_digits(key: Column, seed: str, scope: Column | str) -> Column:
    """A field's name with its runs of seven digits or more drawn anew, the same everywhere."""
    runs = F.regexp_extract_all(key, F.lit("[0-9]{7,}"), F.lit(0))
    pieces = F.split(key, "[0-9]{7,}", -1)
    new = F.transform(runs, lambda r: pour(r, F.concat(*(drawn_digits(stream(seed, scope, f"KEY_{i}", r), 31) for i in range(2)))))
    return F.when(F.size(runs) == 0, key).otherwise(F.array_join(F.flatten(F.zip_with(pieces, F.concat(new, F.array(F.lit(""))), lambda p, n: F.array(p, n))), ""))


def same_number(token: Column) -> Column:
    """The exact decimal that a JSON number token spells, as a key: ``2.12e9`` and ``2120000000`` are one; null where 38 digits do not hold it."""
    return F.regexp_replace(F.regexp_replace(token.try_cast("decimal(38,9)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
