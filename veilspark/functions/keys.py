"""What a field's key says of its values: words, folding, kinds, and whether a value fits its kind."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import checks

# Latin letters that no decomposition gives.
_SPECIAL = {"ø": "o", "ł": "l", "đ": "d", "ı": "i", "ð": "d", "þ": "t", "Ø": "O", "Ł": "L", "Đ": "D"}
_PLAIN = {chr(i): d[0] for i in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(i)))[0].isascii()} | _SPECIAL
_FROM, _TO = "".join(_PLAIN), "".join(_PLAIN.values())

# Names of fields by what their values are.
NAMES = {
    "PERSON": ["name", "nm", "fullname", "contactname", "customername", "displayname", "ownername", "accountholder", "cardholder", "cardholdername", "recipient", "beneficiary"],
    "FIRST_NAME": ["firstname", "givenname", "middlename", "fname", "forename", "preferredname", "namefirst", "vorname", "prenom", "nombre"],
    "LAST_NAME": ["lastname", "surname", "familyname", "lname", "maidenname", "namelast", "nachname", "apellido", "apellidos"],
    "EMAIL_ADDRESS": ["email", "emailaddress", "emailaddr", "mail", "eposta", "courriel", "correo", "correoelectronico", "epost"],
    "PHONE_NUMBER": ["phone", "phonenumber", "mobile", "cell", "telephone", "tel", "ph", "telefon", "telefono", "telefone", "celular", "telefonnummer", "fax", "mobilenumber", "cellphone"],
    "US_SSN": ["ssn", "socialsecuritynumber", "socialsecurity", "ssnnumber"],
    "ADDRESS": ["address", "streetaddress", "street", "addressline1", "addressline2", "addressline", "line1", "line2", "adres", "adresse", "direccion", "domicilio", "indirizzo", "calle", "strasse"],
    "DATE_OF_BIRTH": ["dob", "dateofbirth", "birthdate", "birthday", "geburtsdatum", "datedenaissance", "fechanacimiento"],
    "CREDIT_CARD": ["cardnumber", "creditcardnumber", "debitcardnumber", "ccnumber", "cardno", "primaryaccountnumber", "pan", "card"],
    "IBAN_CODE": ["iban", "ibannumber"],
    "LOCATION": ["city", "town", "locality", "municipality", "cityname", "ciudad", "cidade", "citta", "ville", "stadt", "plaats", "placeofbirth", "birthplace"],
    "REGION": ["state", "stateprovince", "province", "region", "addressregion"],
    "POSTAL_CODE": ["zip", "zipcode", "postcode", "postalcode", "postal", "codepostal", "codigopostal", "postnummer", "plz", "postleitzahl"],
    "IP_ADDRESS": ["ip", "ipaddress", "ipaddr", "clientip", "remoteip", "remoteaddr", "xforwardedfor"],
    "SECRET": ["password", "passwd", "pwd", "passphrase", "secret", "clientsecret", "apisecret", "apikey", "accesstoken", "token", "cvv", "cvc", "pin", "passwort", "contrasena", "motdepasse"],
    "USERNAME": ["username", "login", "handle", "screenname", "nickname", "benutzername", "nombredeusuario"],
    "AGE": ["age", "ageyears", "currentage"],
    "INITIALS": ["initials", "nameinitials", "monogram", "middleinitial"],
    "LATITUDE": ["latitude", "lat", "geolat"],
    "LONGITUDE": ["longitude", "lng", "lon", "long", "geolng", "geolon"],
    "COORDINATES": ["coordinates", "coordinate", "coords", "latlng", "latlong", "geolocation"],
    "TIME_ZONE": ["timezone", "tz", "zoneinfo"],
    "EXPIRY_DATE": ["cardexpiry", "cardexpirydate", "cardexpiration", "expmonth", "expyear", "expirydate"],
    "LAST_DIGITS": ["last4", "ssnlast4", "cardlast4", "lastfour"],
    "EMPLOYER": ["employer", "employername", "company", "companyname"],
    "MRZ": ["mrz", "mrz1", "mrz2", "mrzline1", "mrzline2"],
    "RECORD_ID": ["customerid", "accountid", "userid", "memberid", "patientid", "employeeid"],
    "ID_NUMBER": ["nationalid", "nationalidnumber", "idnumber", "passportnumber", "driverlicense", "taxid", "nino", "accountnumber", "licenseplate"],
}
# Fields that are read as written.
STRUCTURAL = ["createdat", "updatedat", "deletedat", "timestamp", "ts", "requestid", "traceid", "spanid", "correlationid", "eventid", "eventtype", "version", "apiversion", "status", "type", "currency", "locale", "language", "country", "sku", "orderid", "invoicenumber", "hash", "checksum", "digest", "uuid"]
# Words that stand for a result or for no value.
COMMON = ["match", "matched", "nomatch", "mismatch", "pass", "passed", "fail", "failed", "true", "false", "yes", "no", "null", "none", "nil", "undefined", "unknown", "string", "number", "boolean", "na", "n/a", "valid", "invalid", "verified", "unverified", "pending", "approved", "denied", "active", "inactive", "ok", "error", "redacted", "hidden", "test", "example", "sample", "todo", "tbd", "xxx"]


def plain(value: Column) -> Column:
    """A value without accents, in lower case."""
    return F.lower(F.translate(F.regexp_replace(value, "ß", "ss"), _FROM, _TO))


def words(key: Column) -> Column:
    """The words of a camel, snake, kebab, dotted or spaced key."""
    cut = F.regexp_replace(F.regexp_replace(key, r"([\p{Ll}0-9])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(plain(cut), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def compact(key: Column) -> Column:
    """A key's words together."""
    return F.array_join(words(key), "")


def literals(items: Iterable[str], kind: str = "array") -> Column:
    """A constant array (or a map of keys and values in turn) of plain strings, made in one call."""
    return F.expr(f"{kind}({', '.join(repr(str(x)) for x in items)})")


def _table() -> Column:
    return literals((x for entity, names in NAMES.items() for name in names for x in (name, entity)), "map")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once; written in several places of an expression it would be made anew for each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hint(key: Column) -> Column:
    """The entity that a key's values are: by its whole name, else by its last two words, else by its last one; null if none."""
    table = _table()

    def told(w: Column, whole: Column) -> Column:
        last = lambda n: F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), "")
        found = F.coalesce(whole, F.when(F.size(w) >= 2, F.element_at(table, last(2))), F.when(F.size(w) >= 2, F.element_at(table, last(1))))
        counted = F.element_at(w, 1).isin("num", "count", "has", "is", "total", "n") | F.element_at(w, -1).isin("count", "status", "score", "verified", "type", "id") & whole.isNull()
        return F.when((F.size(w) > 0) & ~counted, found)

    return once(words(key), lambda w: once(F.element_at(table, F.array_join(w, "")), lambda whole: told(w, whole)))


def structural(key: Column) -> Column:
    """Timestamps, request ids, statuses and the like."""
    return F.coalesce(compact(key).isin(*STRUCTURAL), F.lit(False))


def person_prefix(key: Column) -> Column:
    """Whose field this is: ``applicant_email`` is the applicant's; null for an unqualified one."""
    w = words(key)
    roles = ("applicant", "spouse", "customer", "patient", "employee", "manager", "guardian", "parent", "beneficiary", "sender", "recipient", "owner", "contact", "coapplicant")
    return F.when(F.size(w) >= 2, F.when(F.element_at(w, 1).isin(*roles), F.element_at(w, 1)))


def date_part(key: Column) -> Column:
    """year, month or day for a key of a part of a date."""
    last = F.element_at(words(key), -1)
    dated = F.exists(words(key), lambda w: w.isin("birth", "dob", "exp", "expiry", "expiration"))
    return F.when((F.size(words(key)) >= 2) & dated & last.isin("year", "month", "day"), last)


def common(value: Column) -> Column:
    """A result or placeholder word."""
    return F.regexp_replace(F.lower(F.trim(value)), "[ _-]", "").isin(*COMMON)


def placeholder(value: Column) -> Column:
    """A template slot, masked or sample value."""
    return common(value) | value.rlike(r"^(\{\{.*\}\}|\$\{.*\}|<[^>]+>|%\w+%|\[[A-Z_]+\]|(?i)your[_-].*|[*xX•]+)$")


def fits(entity: Column, value: Column) -> Column:
    """Whether a value can be what its key says: results, scores and placeholders are not."""
    number = value.rlike(r"^-?[0-9]+([.][0-9]+)?$")
    return (
        ~placeholder(value)
        & F.when(entity.isin("PERSON", "FIRST_NAME", "LAST_NAME", "LOCATION", "REGION", "EMPLOYER", "INITIALS"), value.rlike(r"\p{L}") & ~number)
        .when(entity == "EMAIL_ADDRESS", value.contains("@") | value.contains("%40"))
        .when(entity == "PHONE_NUMBER", F.length(F.regexp_replace(value, "[^0-9]", "")) >= 6)
        .when(entity.isin("DATE_OF_BIRTH", "US_SSN", "CREDIT_CARD", "ADDRESS"), value.rlike("[0-9]") | (entity == "ADDRESS"))
        .when(entity.isin("LATITUDE", "LONGITUDE"), number & F.coalesce(F.abs(value.try_cast("double")) <= 180, F.lit(False)))
        .when(entity == "AGE", value.rlike("^[0-9]{1,3}$"))
        .when(entity == "IP_ADDRESS", value.rlike("^[0-9a-fA-F:.]+$"))
        .when(entity == "LAST_DIGITS", value.rlike("^[0-9]{3,6}$"))
        .otherwise(F.lit(True))
    )


# Keys that say only which part of their parent's value they hold.
SLOTS = ("value", "data", "text", "content", "number", "num", "no", "current", "raw", "formatted", "full", "line", "item", "entry", "v")
NAME_SLOTS = {"first": "FIRST_NAME", "given": "FIRST_NAME", "middle": "FIRST_NAME", "last": "LAST_NAME", "family": "LAST_NAME"}
DATE_SLOTS = ("year", "month", "day")


def resolved(key: Column, parent: Column) -> Column:
    """The entity of a key in its object: a slot (``value``, ``number``, ``[3]``) takes its parent's, ``first`` and ``last`` are names under a person, and
    ``year`` is a date's under a date of birth; other keys speak for themselves."""
    own, above, name = hint(key), hint(parent), compact(key)
    slot = name.isin(*SLOTS) | name.rlike("^[0-9]*$")
    names = literals((x for pair in NAME_SLOTS.items() for x in pair), "map")
    part = F.when(above.isin("PERSON", "FIRST_NAME", "LAST_NAME"), F.element_at(names, name)).when((above == "DATE_OF_BIRTH") & name.isin(*DATE_SLOTS), F.lit("DATE_OF_BIRTH"))
    return F.coalesce(part, F.when(slot, above).otherwise(own))


def header(name: Column) -> Column:
    """The entity of a spoken or flattened column name: ``Contact Phones 0 Number`` is a phone, the last piece of a URI counts, a note in brackets does not."""
    last = F.regexp_replace(F.regexp_replace(name, r"^\w+://.*[/#]", ""), r"\s*[(\[].*?[)\]]", "")
    slots = F.array(*(F.lit(s) for s in SLOTS))
    single = lambda w: F.regexp_replace(w, "(?<=[^s])s$", "")

    def told(kept: Column) -> Column:
        inner = F.filter(kept, lambda w: ~F.array_contains(slots, w))
        return F.coalesce(hint(F.array_join(kept, " ")), hint(F.array_join(F.transform(inner, single), " ")))

    return once(F.filter(words(last), lambda w: ~w.rlike("^[0-9]+$")), told)


def numeric(key: Column, parent: Column, number: Column) -> Column:
    """The entity of a bare number, null for a count, an amount or a time: it is personal by its key or, with 13 digits or more, by a card's check."""
    told = resolved(key, parent)
    plain = number.rlike("^-?[0-9]+([.][0-9]+)?$")
    return F.when(~plain | structural(key), None).when(told.isNotNull() & fits(told, number), told).when(told.isNull() & checks.card(number), "CREDIT_CARD")
