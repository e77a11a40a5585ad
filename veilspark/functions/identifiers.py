"""National, business and device identifiers: how they look, what they are called, and the check that they pass.

Every check is a native column over the identifier without separators. An identifier counts where a naming word stands before it, or where its form is
telling by itself (``alone``); ``base`` is its score without a name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks, national
from .checks import weighted


@dataclass(frozen=True)
class Identifier:
    kind: str
    keys: tuple[str, ...]
    form: str
    check: Callable[[Column], Column]
    base: float = 0.05
    alone: bool = False
    entity: str = "ID_NUMBER"
    raw: bool = False  # whether the check reads separators too


def _at(v: Column, i: int) -> Column:
    """The i-th character as a digit."""
    return F.substring(v, i + 1, 1).try_cast("int")


def _eleven(v: Column, weights: list[int], at: int, over: int = 11) -> Column:
    """A check digit of 11 minus the weighted sum's rest, with 10 and 11 as 0."""
    rest = weighted(v, weights) % 11
    return _at(v, at) == F.when(rest < 2, 0).otherwise(over - rest)


def _letter(number: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), (F.pmod(number, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def _cpf(v: Column) -> Column:
    repeated = v.rlike(r"^(\d)\1{10}$")
    return (F.length(v) == 11) & ~repeated & _eleven(v, list(range(10, 1, -1)), 9) & _eleven(v, list(range(11, 1, -1)), 10)


def _cnpj(v: Column) -> Column:
    w = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return (F.length(v) == 14) & _eleven(v, w, 12) & _eleven(v, [6, *w], 13)


def _cuil(v: Column) -> Column:
    rest = F.pmod(F.lit(11) - weighted(v, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11, F.lit(11))
    return (F.length(v) == 11) & (_at(v, 10) == rest)


def _rut(v: Column) -> Column:
    body = F.lpad(F.substring(v, F.lit(1), F.length(v) - 1), 9, "0")
    rest = F.lit(11) - weighted(body, [4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    mark = F.when(rest == 11, "0").when(rest == 10, "K").otherwise(rest.cast("string"))
    return F.upper(F.substring(v, F.length(v), F.lit(1))) == mark


def _dni(v: Column) -> Column:
    v = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(v), "^X", "0"), "^Y", "1"), "^Z", "2"))
    return F.substring(v, 9, 1) == _letter(F.substring(v, 1, 8).try_cast("int"), "TRWAGMYFPDXBNJZSQVHLCKE")


def _pesel(v: Column) -> Column:
    month = F.substring(v, 3, 2).try_cast("int")
    century = F.element_at(checks.numbers((1900, 2000, 2100, 2200, 1800)), (F.floor(month / 20) + 1).cast("int"))
    return (F.pmod(F.lit(10) - weighted(v, [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]) % 10, F.lit(10)) == _at(v, 10)) & checks.real_date(century + F.substring(v, 1, 2).try_cast("int"), month % 20, F.substring(v, 5, 2).try_cast("int"))


def _nir(v: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.substring(v, 1, 13), "2A", "19"), "2B", "18")
    return (F.length(v) == 15) & (F.lit(97) - body.try_cast("long") % 97 == F.substring(v, 14, 2).try_cast("long"))


def _belgian(v: Column) -> Column:
    n, check = F.substring(v, 1, 9), F.substring(v, 10, 2).try_cast("long")
    return (F.lit(97) - n.try_cast("long") % 97 == check) | (F.lit(97) - F.concat(F.lit("2"), n).try_cast("long") % 97 == check)


def _bsn(v: Column) -> Column:
    return F.pmod(weighted(v, [9, 8, 7, 6, 5, 4, 3, 2]) - _at(v, 8), F.lit(11)) == 0


def _steuer(v: Column) -> Column:
    part = F.slice(checks.digit_array(v), 1, 10)

    def step(p: Column, d: Column) -> Column:
        s = (p + d) % 10
        return F.when(s == 0, 10).otherwise(s) * 2 % 11

    return (F.pmod(F.lit(11) - F.aggregate(part, F.lit(10), step), F.lit(10)) == _at(v, 10)) & ~v.startswith("0")


def _swedish(v: Column) -> Column:
    ten = F.substring(v, F.length(v) - 9, F.lit(10))
    day = F.pmod(F.substring(ten, 5, 2).try_cast("int"), F.lit(60))
    return checks.luhn(ten) & checks.real_date(F.lit(2000) + F.substring(ten, 1, 2).try_cast("int"), F.substring(ten, 3, 2).try_cast("int"), day)


def _norwegian(v: Column) -> Column:
    k1 = F.pmod(F.lit(11) - weighted(v, [3, 7, 6, 1, 8, 9, 4, 5, 2]) % 11, F.lit(11))
    k2 = F.pmod(F.lit(11) - weighted(v, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11, F.lit(11))
    return (_at(v, 9) == k1) & (_at(v, 10) == k2)


def _hetu(v: Column) -> Column:
    number = F.concat(F.substring(v, 1, 6), F.substring(v, 8, 3)).try_cast("int")
    return F.substring(v, 11, 1) == _letter(number, "0123456789ABCDEFHJKLMNPRSTUVWXY")


def _nhs(v: Column) -> Column:
    rest = F.pmod(F.lit(11) - weighted(v, list(range(10, 1, -1))) % 11, F.lit(11))
    return (rest != 10) & (_at(v, 9) == rest)


def _resident(v: Column) -> Column:
    rest = weighted(v, [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11
    return (F.upper(F.substring(v, 18, 1)) == F.substring(F.lit("10X98765432"), rest + 1, F.lit(1))) & checks.real_date(F.substring(v, 7, 4).try_cast("int"), F.substring(v, 11, 2).try_cast("int"), F.substring(v, 13, 2).try_cast("int"))


def _tckn(v: Column) -> Column:
    odd, even = weighted(v, [1, 0, 1, 0, 1, 0, 1, 0, 1]), weighted(v, [0, 1, 0, 1, 0, 1, 0, 1])
    return (F.pmod(odd * 7 - even, F.lit(10)) == _at(v, 9)) & (weighted(v, [1] * 10) % 10 == _at(v, 10))


def _nric(v: Column) -> Column:
    total = weighted(F.substring(v, 2, 7), [2, 7, 6, 5, 4, 3, 2]) + F.when(F.substring(v, 1, 1).isin("T", "G"), 4).when(F.substring(v, 1, 1) == "M", 3).otherwise(0)
    first = F.substring(v, 1, 1)
    mark = F.when(first.isin("S", "T"), _letter(total, "JZIHGFEDCBA")).when(first == "M", _letter(F.lit(10) - total % 11, "KLJNPQRTUWX")).otherwise(_letter(total, "XWUTRQPNMLK"))
    return F.substring(v, 9, 1) == mark


def _dea(v: Column) -> Column:
    d = F.substring(v, 3, 7)
    return (weighted(d, [1, 2, 1, 2, 1, 2]) % 10) == _at(d, 6)


def _npi(v: Column) -> Column:
    return checks.luhn(F.concat(F.lit("80840"), v))


def _tfn(v: Column) -> Column:
    return weighted(v, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0


def _medicare(v: Column) -> Column:
    return weighted(v, [1, 3, 7, 9, 1, 3, 7, 9]) % 10 == _at(v, 8)


def _abn(v: Column) -> Column:
    return (weighted(v, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0


def _thai(v: Column) -> Column:
    return F.pmod(F.lit(11) - weighted(v, list(range(13, 1, -1))) % 11, F.lit(10)) == _at(v, 12)


def _dowod(v: Column) -> Column:
    codes = F.transform(F.slice(F.split(v, ""), 1, 3), lambda c: F.ascii(c) - 55)
    letters = F.aggregate(F.zip_with(codes, checks.numbers((7, 3, 1)), lambda c, w: c * w), F.lit(0), lambda a, x: a + x)
    return (letters + weighted(F.substring(v, 5, 5), [7, 3, 1, 7, 3])) % 10 == _at(v, 3)


def _taiwan(v: Column) -> Column:
    code = F.instr(F.lit("ABCDEFGHJKLMNPQRSTUVXYWZIO"), F.substring(v, 1, 1)) + 9
    total = F.floor(code / 10) + code % 10 * 9 + weighted(F.substring(v, 2, 9), [8, 7, 6, 5, 4, 3, 2, 1, 1])
    return total % 10 == 0


def _korean(v: Column) -> Column:
    return F.pmod(F.lit(11) - weighted(v, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11, F.lit(10)) == _at(v, 12)


def _my_number(v: Column) -> Column:
    rest = weighted(v, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11
    return F.when(rest <= 1, 0).otherwise(F.lit(11) - rest) == _at(v, 11)


def _vin(v: Column) -> Column:
    letters = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9]))
    plain = F.translate(F.upper(v), "".join(letters), "".join(map(str, letters.values())))
    rest = weighted(plain, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    return F.substring(F.upper(v), 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string"))


def _lei(v: Column) -> Column:
    return checks.mod97(v) == 1


def _ean(v: Column) -> Column:
    return F.pmod(F.lit(10) - weighted(v, [1, 3] * 6) % 10, F.lit(10)) == _at(v, 12)


def _routing(v: Column) -> Column:
    return weighted(v, [3, 7, 1, 3, 7, 1, 3, 7, 1]) % 10 == 0


def _shape(v: Column) -> Column:
    return F.lit(True)


def _sums(weights: list[int], over: int, at: int) -> Callable[[Column], Column]:
    """A check digit that is the weighted sum's rest (a rest of ten as 0)."""
    return lambda v: _at(v, at) == weighted(v, weights) % over % 10


# Forms and naming words of identifiers.
_FIRST = (
    Identifier("CPF", ("cpf", "cadastro"), r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b", _cpf, 0.5, True),
    Identifier("CPF_DIGITS", ("cpf",), r"\b[0-9]{11}\b", _cpf),
    Identifier("CNPJ", ("cnpj",), r"\b[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}\b", _cnpj, 0.5, True),
    Identifier("CUIL", ("cuil", "cuit"), r"\b(?:2[0347]|3[034])-[0-9]{8}-[0-9]\b", _cuil, 0.5, True),
    Identifier("RUT", ("rut",), r"\b[0-9]{1,2}\.[0-9]{3}\.[0-9]{3}-[0-9kK]\b", _rut, 0.5, True),
    Identifier("DNI", ("dni", "nif"), r"\b[0-9]{8}-?[A-HJ-NP-TV-Z]\b", _dni, 0.3, True),
    Identifier("NIE", ("nie", "nif"), r"\b[XYZ]-?[0-9]{7}-?[A-HJ-NP-TV-Z]\b", _dni, 0.3, True),
    Identifier("NIR", ("nir", "insee", "sécurité", "securite"), r"\b[12] [0-9]{2} (?:0[1-9]|1[0-2]) (?:[0-9]{2}|2[AB]) [0-9]{3} [0-9]{3} [0-9]{2}\b", _nir, 0.5, True),
    Identifier("BELGIAN_NATIONAL_NUMBER", ("rijksregisternummer", "insz", "niss"), r"\b[0-9]{2}\.[0-9]{2}\.[0-9]{2}-[0-9]{3}\.[0-9]{2}\b", _belgian, 0.5, True),
    Identifier("BSN", ("bsn", "burgerservicenummer"), r"\b[0-9]{9}\b", _bsn),
    Identifier("STEUER_ID", ("steuerid", "steueridentifikationsnummer", "idnr"), r"\b[1-9][0-9]{10}\b", _steuer),
    Identifier("PESEL", ("pesel",), r"\b[0-9]{11}\b", _pesel),
    Identifier("PERSONNUMMER", ("personnummer", "pnr"), r"\b(?:19|20)?[0-9]{6}[-+][0-9]{4}\b", _swedish, 0.3),
    Identifier("FODSELSNUMMER", ("fødselsnummer", "fodselsnummer"), r"\b[0-7][0-9]{10}\b", _norwegian),
    Identifier("CPR", ("cpr", "personnummer"), r"\b(?:0[1-9]|[12][0-9]|3[01])(?:0[1-9]|1[0-2])[0-9]{2}-[0-9]{4}\b", _shape, 0.1),
    Identifier("HETU", ("hetu", "henkilötunnus"), r"\b[0-9]{6}[-+A-FU-Y][0-9]{3}[0-9A-FHJ-NPR-Y]\b", _hetu, 0.5, True, raw=True),
    Identifier("NINO", ("nino", "insurance"), r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b", _shape, 0.3),
    Identifier("NHS_NUMBER", ("nhs",), r"\b[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{4}\b", _nhs),
    Identifier("SIN", ("sin", "insurance"), r"\b[1-79][0-9]{2}[- ]?[0-9]{3}[- ]?[0-9]{3}\b", checks.luhn),
    Identifier("AADHAAR", ("aadhaar", "aadhar"), r"\b[2-9][0-9]{3}[- ]?[0-9]{4}[- ]?[0-9]{4}\b", checks.verhoeff),
    Identifier("PAN", ("pan",), r"\b[A-Z]{3}[ABCFGHLJPT][A-Z][0-9]{4}[A-Z]\b", _shape, 0.3),
    Identifier("RESIDENT_ID", ("身份证",), r"\b[1-8][0-9]{5}(?:18|19|20)[0-9]{9}[0-9Xx]\b", _resident, 0.5, True),
    Identifier("RRN", ("rrn", "주민등록번호"), r"\b[0-9]{6}-[1-8][0-9]{6}\b", _korean, 0.3),
    Identifier("SOUTH_AFRICAN_ID", ("rsa", "identity"), r"\b[0-9]{10}[012][0-9]{2}\b", checks.luhn),
    Identifier("TCKN", ("tckn", "kimlik"), r"\b[1-9][0-9]{10}\b", _tckn),
    Identifier("EMIRATES_ID", ("emirates",), r"\b784-(?:19|20)[0-9]{2}-[0-9]{7}-[0-9]\b", checks.luhn, 0.5, True),
    Identifier("NRIC", ("nric", "fin"), r"\b[STFGM][0-9]{7}[A-Z]\b", _nric, 0.3),
    Identifier("TAIWAN_ID", ("身分證",), r"\b[A-Z][12][0-9]{8}\b", _taiwan, 0.3),
    Identifier("MY_NUMBER", ("マイナンバー", "個人番号"), r"\b[0-9]{4} ?[0-9]{4} ?[0-9]{4}\b", _my_number),
    Identifier("DOWOD", ("dowód", "dowodu", "dowod"), r"\b[A-Z]{3} ?[0-9]{6}\b", _dowod, 0.3),
    Identifier("THAI_ID", ("บัตรประชาชน",), r"\b[1-8]-[0-9]{4}-[0-9]{5}-[0-9]{2}-[0-9]\b", _thai, 0.5, True),
    Identifier("CURP", ("curp",), r"\b[A-Z][AEIOUX][A-Z]{2}[0-9]{6}[HMX][A-Z]{5}[0-9A-Z][0-9]\b", _shape, 0.6, True),
    Identifier("RFC", ("rfc",), r"\b[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{3}\b", _shape, 0.3),
    Identifier("CODICE_FISCALE", ("codice", "fiscale"), r"\b[A-Z]{6}[0-9]{2}[A-EHLMPRST][0-9]{2}[A-Z][0-9]{3}[A-Z]\b", _shape, 0.6, True),
    Identifier("NPI", ("npi", "provider"), r"\b[12][0-9]{9}\b", _npi),
    Identifier("DEA", ("dea",), r"\b[ABCDEFGHJKLMPRSTUX][A-Z9][0-9]{7}\b", _dea, 0.3, entity="MEDICAL_LICENSE"),
    Identifier("MBI", ("mbi", "medicare"), r"\b[1-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y]{2}[0-9]{2}\b", _shape, 0.5, True),
    Identifier("TFN", ("tfn", "tax"), r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", _tfn),
    Identifier("AU_MEDICARE", ("medicare",), r"\b[2-6][0-9]{3} ?[0-9]{5} ?[0-9]\b", _medicare),
    Identifier("ABN", ("abn",), r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", _abn),
    Identifier("VIN", ("vin", "vehicle"), r"\b[A-HJ-NPR-Z0-9]{17}\b", _vin, 0.3),
    Identifier("LEI", ("lei",), r"\b[0-9A-Z]{18}[0-9]{2}\b", _lei, 0.3),
    Identifier("IMEI", ("imei",), r"\b[0-9]{2}-?[0-9]{6}-?[0-9]{6}-?[0-9]\b", checks.luhn, 0.3),
    Identifier("EAN", ("ean", "gtin"), r"\b[0-9]{13}\b", _ean),
    Identifier("ROUTING", ("routing", "aba"), r"\b[0-9]{9}\b", _routing, entity="US_BANK_NUMBER"),
    Identifier("SA_NATIONAL_ID", ("iqama",), r"\b[12][0-9]{9}\b", checks.luhn),
    Identifier("VN_CCCD", ("cccd",), r"\b0[0-9]{2} ?[0-9]{3} ?[0-9]{6}\b", _shape),
    Identifier("ISRAELI_ID", ("teudat",), r"\b[0-9]{9}\b", checks.luhn),
    Identifier("ESTONIAN_ID", ("isikukood",), r"\b[1-8][0-9]{10}\b", national.twice(10)),
    Identifier("EGN", ("egn",), r"\b[0-9]{10}\b", _sums([2, 4, 8, 5, 10, 9, 7, 3, 6], 11, 9)),
    Identifier("CNP", ("cnp",), r"\b[1-8][0-9]{12}\b", lambda v: _at(v, 12) == F.when(weighted(v, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9]) % 11 == 10, 1).otherwise(weighted(v, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9]) % 11)),
    Identifier("OIB", ("oib",), r"\b[0-9]{11}\b", _steuer),
    Identifier("JMBG", ("jmbg",), r"\b[0-9]{13}\b", lambda v: _at(v, 12) == F.pmod(F.lit(11) - weighted(v, [7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11, F.lit(11)) % 10),
    Identifier("NIP", ("nip",), r"\b[0-9]{3}-?[0-9]{3}-?[0-9]{2}-?[0-9]{2}\b", lambda v: _at(v, 9) == weighted(v, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11),
    Identifier("REGON", ("regon",), r"\b[0-9]{9}\b", _sums([8, 9, 2, 3, 4, 5, 6, 7], 11, 8)),
    Identifier("SIREN", ("siren",), r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", checks.luhn),
    Identifier("SIRET", ("siret",), r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3} ?[0-9]{5}\b", checks.luhn),
    Identifier("ORCID", ("orcid",), r"\b[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]\b", _shape, 0.5, True),
    Identifier("EIN", ("ein", "employer"), r"\b[0-9]{2}-[0-9]{7}\b", _shape, 0.1),
    Identifier("SWIFT", ("swift", "bic"), r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", _shape, 0.05),
)


#: Every kind; of two that hold of one value the earlier one counts.
REGISTRY = (*_FIRST, *(Identifier(*row) for row in national.ROWS))


def compact(value: Column) -> Column:
    """An identifier without its separators."""
    return F.regexp_replace(value, r"[ ./+()\u2010-\u2015-]", "")


def valid(kind: Identifier, value: Column) -> Column:
    """Whether a written identifier passes the kind's check."""
    return F.coalesce(kind.check(value if kind.raw else compact(value)), F.lit(False))


def passes(at: Column, value: Column, registry: Sequence[Identifier] | None = None) -> Column:
    """Whether a written identifier passes the check of the kind at a place of the registry.

    All kinds whose check is a weighted sum share one expression over a constant table, and all with one function share its branch, so the plan stays
    small however many kinds there are.
    """
    registry = REGISTRY if registry is None else registry
    plain = compact(value)
    sums = [k.check if isinstance(k.check, national.Sum) else None for k in registry]
    out, branches = F.lit(False), {}
    for i, k in enumerate(registry):
        if sums[i] is None:
            branches.setdefault((k.check, k.raw), []).append(i)
    for (check, raw), places in branches.items():
        out = F.when(at.isin(*places), F.lit(True) if check is national.shape or check is _shape else check(value if raw else plain)).otherwise(out)
    summed = [i for i, s in enumerate(sums) if s is not None]
    if summed:
        table = national.table(sums)
        out = F.when(at.isin(*summed), national.holds(plain, F.element_at(table, at + 1))).otherwise(out)
    return F.coalesce(out, F.lit(False))


#: Digits poured into an identifier until one passes its check: of a hundred draws at a check of one in eleven, none passes once in 14,000 times.
DRAWS = 100


def stand_in(at: Column, original: Column, seed: str, scope: Column | str, registry: Sequence[Identifier] | None = None) -> Column:
    """Another number that passes the check of the kind at a place of the registry, with the original's letters, separators and leading digit; null if none was drawn.

    The same original takes the same one within a scope.
    """
    from . import draw

    first = F.regexp_extract(original, "([0-9])", 1)

    def candidate(i: Column) -> Column:
        digits = draw.drawn_digits(draw.stream(seed, scope, "ID_NUMBER", compact(original), i), 30)
        return draw.pour(original, F.concat(first, digits))

    tries = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), candidate)
    return F.get(F.filter(tries, lambda c: (c != original) & passes(at, c, registry)), F.lit(0))
