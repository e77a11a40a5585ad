"""Validators of identifiers as native columns: check digits, ranges and formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Social security numbers of advertisements.
SAMPLE_SSNS = ("078051120", "219099999", "123456789")
# Multiplication and permutation of the dihedral check.
_VERHOEFF_D = ["0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210"]
_VERHOEFF_P = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]


def digits(value: Column) -> Column:
    """The ASCII digits of a value."""
    return F.regexp_replace(value, "[^0-9]", "")


def digit_array(value: Column) -> Column:
    """The ASCII digits of a value as numbers; of a value without any, one null."""
    return F.split(digits(value), "").try_cast("array<int>")


def numbers(values: Sequence[int]) -> Column:
    """A constant array of numbers, made in one call."""
    return F.expr(f"array({', '.join(map(str, values))})")


def weighted(value: Column, weights: Sequence[int], start: int = 0) -> Column:
    """Sum of the digits from ``start`` times the weights."""
    part = F.slice(digit_array(value), start + 1, len(weights))
    return F.aggregate(F.zip_with(part, numbers(weights), lambda d, w: d * w), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def luhn(value: Column) -> Column:
    """The mod-10 check of a string of digits, 2 or more."""
    return (F.length(value) >= 2) & F.coalesce(F.call_function("luhn_check", value), F.lit(False))


def epoch_milliseconds(value: Column) -> Column:
    """Thirteen digits that do not open with 4 are a time rather than a card."""
    return (F.length(value) == 13) & ~value.startswith("4")


def card_network(value: Column) -> Column:
    """The network that digits open like, else null."""
    return (
        F.when(value.rlike("^4"), "visa")
        .when(value.rlike("^5[1-5]|^2(22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)"), "mastercard")
        .when(value.rlike("^3[47]"), "amex")
        .when(value.rlike("^35"), "jcb")
        .when(value.rlike("^3[68]"), "diners")
        .when(value.rlike("^6011|^64[4-9]|^65"), "discover")
        .when(value.rlike("^62"), "unionpay")
    )


def card(value: Column) -> Column:
    """A written card number: 13 to 19 digits with a right check digit that are no time. No network's numbers open with 0."""
    d = digits(value)
    return F.length(d).between(13, 19) & ~d.startswith("0") & luhn(d) & ~epoch_milliseconds(d) & ~((F.length(d) >= 18) & d.startswith("1"))


def mod97(value: Column) -> Column:
    """A string of digits and capital letters (A = 10), modulo 97, piece by piece."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return F.aggregate(codes, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def iban(value: Column) -> Column:
    """A written IBAN of a known country's length with right check digits."""
    v = F.upper(F.regexp_replace(value, "[ .-]", ""))
    lengths = F.expr(f"map({', '.join(f'{c!r}, {n}' for c, n in IBAN_LENGTHS.items())})")
    right = v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.length(v) == F.element_at(lengths, F.substring(v, 1, 2)))
    return F.coalesce(right & (mod97(F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))) == 1), F.lit(False))


def ssn(value: Column) -> Column:
    """Nine digits that can have been issued."""
    d = digits(value)
    return (F.length(d) == 9) & ~d.rlike("^(000|666|9)") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000") & ~d.isin(*SAMPLE_SSNS)


def itin(value: Column) -> Column:
    d = digits(value)
    return d.rlike("^9[0-9]{2}(5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-24-9])[0-9]{4}$")


def octets(value: Column) -> Column:
    """The four numbers of a dotted address, else null."""
    parts = F.transform(F.split(value, r"\."), lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("int")))
    return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.between(0, 255), F.lit(False))), parts)


def ipv4(value: Column) -> Column:
    return octets(value).isNotNull()


def private_ip(value: Column) -> Column:
    """Addresses of private networks."""
    o = octets(value)
    return F.coalesce((o[0] == 10) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)), F.lit(False)) | F.lower(value).rlike("^f[cd][0-9a-f]{0,2}:")


def shared_ip(value: Column) -> Column:
    """Addresses that are no one's: loopback, unspecified, public resolvers, broadcast, documentation of none."""
    o = octets(value)
    return F.coalesce((o[0] == 127) | (o[0] == 0) | value.isin("8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "255.255.255.255", "::1", "::"), F.lit(False))


def verhoeff(value: Column) -> Column:
    """The dihedral check of a string of digits."""
    table = F.expr(f"array({', '.join(map(repr, _VERHOEFF_D))})")
    turns = F.expr(f"array({', '.join(map(repr, _VERHOEFF_P))})")
    order = F.reverse(digit_array(value))
    at = F.transform(order, lambda d, i: F.substring(F.element_at(turns, i % 8 + 1), d + 1, F.lit(1)).cast("int"))
    return F.aggregate(at, F.lit(0), lambda c, d: F.substring(F.element_at(table, c + 1), d + 1, F.lit(1)).cast("int")) == 0


def real_date(year: Column, month: Column, day: Column) -> Column:
    """Whether a day exists."""
    spelled = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(spelled, "yyyy-MM-dd").isNotNull()


def icao(value: Column) -> Column:
    """The 7-3-1 sum of a machine-readable field, modulo 10."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(0))
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    return F.aggregate(F.transform(codes, lambda c, i: c * F.element_at(weights, i % 3 + 1)), F.lit(0), lambda a, x: a + x) % 10
