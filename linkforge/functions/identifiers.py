"""Canonical forms and checks of identifier families, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge.functions.contact import bound, digits, tidy

# Letters and prefixes that national insurance numbers never have.
NINO = r"^(?!BG|GB|NK|KN|TN|NT|ZZ)[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z][0-9]{6}[A-D]$"
# Fixed value: letters and digits of vehicles' numbers.
VIN = r"^[A-HJ-NPR-Z0-9]{17}$"
# Prefixes of company numbers.
COMPANY_PREFIXES = "SC NI OC SO NC FC SF NF GE GS GN IP SP NP RC SR NR AC SA NA SE ES PC CE RS NO NZ IC SI NV LP SL NL".split()
# The shapes of UK postcodes and of number plates.
POSTCODE = r"^(GIR ?0AA|([A-Z][0-9]{1,2}|[A-Z][A-HJ-Y][0-9]{1,2}|[A-Z][0-9][A-Z]|[A-Z][A-HJ-Y][0-9][A-Z]) ?[0-9][A-Z]{2})$"
PLATES = r"^([A-Z]{2}[0-9]{2}[A-Z]{3}|[A-Z][0-9]{1,3}[A-Z]{3}|[A-Z]{3}[0-9]{1,3}[A-Z]|[A-Z]{1,3}[0-9]{1,4}|[0-9]{1,4}[A-Z]{1,3})$"


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def account(c: Column) -> Column:
    d = digits(c)
    return F.when((d != "") & (F.length(d) <= 8), F.lpad(d, 8, "0")).otherwise(F.substring(alnum(c), 1, 18))


def sort_code(c: Column) -> Column:
    return F.substring(digits(c), 1, 6)


def sort_code_valid(c: Column) -> Column:
    return F.length(digits(c)) == 6


def nino(c: Column) -> Column:
    return F.substring(F.regexp_replace(alnum(c), "^NINO", ""), 1, 9)


def nino_valid(c: Column) -> Column:
    return nino(c).rlike(NINO)


def vrm(c: Column) -> Column:
    return F.regexp_replace(alnum(c), "^VRM", "")


def vrm_format_valid(c: Column) -> Column:
    return alnum(c).rlike(PLATES)


def vin(c: Column) -> Column:
    return F.substring(F.regexp_replace(alnum(c), "^VIN", ""), 1, 17)


def vin_valid(c: Column) -> Column:
    return vin(c).rlike(VIN)


def company_valid(c: Column) -> Column:
    s = alnum(c)
    return s.rlike("^([0-9]{8}|R[0-9]{7})$") | (s.rlike("^[A-Z]{2}[0-9]{6}$") & F.substring(s, 1, 2).isin(COMPANY_PREFIXES))


def luhn(c: Column) -> Column:
    d = digits(c)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def imei_valid(c: Column) -> Column:
    return (F.length(digits(c)) == 15) & F.call_function("luhn_check", digits(c))


def vat_valid(c: Column) -> Column:
    """Nine digits: weights 8 to 2, then the two check digits; the sum, or the sum and 55, is a multiple of 97."""
    d = digits(c)
    total = sum(((F.substring(d, i + 1, 1).try_cast("int") * (8 - i)) for i in range(7)), F.lit(0)) + F.substring(d, 8, 2).try_cast("int")
    return F.coalesce((F.length(d) >= 9) & ((total % 97 == 0) | ((total + 55) % 97 == 0)), F.lit(False))


def iban_valid(c: Column) -> Column:
    """Length, shape, and the remainder of the rearranged number by 97, taken digit by digit."""
    s = alnum(c)
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    each = F.filter(F.split(turned, ""), lambda x: x != "")
    value = lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(each, F.lit(0), lambda acc, x: (F.when(value(x) > 9, acc * 100).otherwise(acc * 10) + value(x)) % 97)
    return F.length(s).between(15, 34) & s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rest == 1)


def postcode(c: Column) -> Column:
    s = F.regexp_replace(F.upper(c), r"\s+", "")
    return F.when(F.length(s) < 5, s).otherwise(F.concat(s.substr(F.lit(1), F.length(s) - 3), F.lit(" "), F.right(s, F.lit(3))))


def postcode_valid(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(c), r"\s+", " ")).rlike(POSTCODE)


def _without(c: Column, *words: str) -> Column:
    """Capital letters and digits without a leading word for the family."""
    return F.regexp_replace(alnum(c), f"^({'|'.join(words)})", "")


def _numbered(c: Column, shape: str, groups: int, join: Callable[[list[Column]], Column], *words: str) -> Column:
    """join() of the groups of a shape's first place in the capitals; where there is none, what stands there without the family's word."""
    return bound(F.upper(c), lambda up: F.when(up.rlike(shape), join([F.regexp_extract(up, shape, i + 1) for i in range(groups)])).otherwise(_without(up, *words)))


def cro(c: Column) -> Column:
    """Criminal records: a number, a slash, two digits of the year and a letter; S first for Scotland."""
    return _numbered(c, r"(S?)\s*([0-9]{1,7})\s*/\s*([0-9]{2})\s*([A-Z])", 4, lambda g: F.concat(g[0], g[1], F.lit("/"), g[2], g[3]), "SCRO", "CRO")


def pnc(c: Column) -> Column:
    """Police computer: two digits of the year, a slash, a number and a letter."""
    year = lambda y: F.when(F.length(y) == 4, F.right(y, F.lit(2))).otherwise(y)
    return _numbered(c, r"([0-9]{2,4})\s*/\s*([0-9]{1,7})\s*([A-Z])", 3, lambda g: F.concat(year(g[0]), F.lit("/"), g[1], g[2]), "PNC")


def nib(c: Column) -> Column:
    return _numbered(c, r"([0-9]{1,6})\s*/\s*([0-9]{2})", 2, lambda g: F.concat(g[0], F.lit("/"), g[1]), "NIB")


def passport(c: Column) -> Column:
    """Nine digits, or six and a letter."""
    def found(s: Column) -> Column:
        return bound(F.regexp_extract(s, "[0-9]{9}|[0-9]{6}[A-Z]", 0), lambda x: F.when(x != "", x).otherwise(s))

    return bound(_without(c, "PPT"), found)


def driver_licence(c: Column) -> Column:
    return F.substring(_without(c, "DRV"), 1, 16)


def driver_licence_valid(c: Column) -> Column:
    return _driver_licence_form(driver_licence(c))


def _driver_licence_form(s: Column) -> Column:
    """Five letters of the surname, six digits of the birth date (months of women stand 50 later), two initials, a digit, two letters."""
    month, day = F.substring(s, 7, 2).try_cast("int"), F.substring(s, 9, 2).try_cast("int")
    return F.coalesce(s.rlike("^[A-Z9]{5}[0-9]{6}[A-Z9]{2}[0-9][A-Z]{2}$") & (month.between(1, 12) | month.between(51, 62)) & day.between(1, 31), F.lit(False))


def _handle(c: Column, word: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^(?i)({word})", ""), r"\s+", "")


def ip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?i)ip\s*address", ""), r"\s+", "")


def ip_loose(c: Column) -> Column:
    """Four numbers up to 255, or hexadecimal digits and colons."""
    s = ip(c)
    octets = F.transform(F.split(s, "[.]"), lambda x: x.try_cast("int"))
    return F.coalesce(F.when(s.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), F.forall(octets, lambda x: x <= 255)).otherwise(s.rlike("^[0-9A-Fa-f:]+$") & s.contains(":")), F.lit(False))


def iban_text(c: Column) -> Column:
    """Capitals in fours."""
    return F.trim(F.regexp_replace(alnum(c), "(.{4})", "$1 "))


def nino_text(c: Column) -> Column:
    return _nino_pairs(nino(c))


def _nino_pairs(s: Column) -> Column:
    """In pairs, where the shape fits."""
    return F.regexp_replace(s, "^([A-Z]{2})([0-9]{2})([0-9]{2})([0-9]{2})([A-D])$", "$1 $2 $3 $4 $5")


def _long(low: int, high: int = 1000) -> Callable[[Column], Column]:
    return lambda s: F.length(s).between(low, high)


def _like(shape: str) -> Callable[[Column], Column]:
    return lambda s: s.rlike(shape)


@dataclass(frozen=True)
class Family:
    """A family of identifiers: canonical form, check, and the form in free text (a word, then the canonical form if nothing else is named).

    The check takes the canonical form, unless whole says that it takes what was written; text takes the canonical form.
    """

    canonical: Callable[[Column], Column]
    check: Callable[[Column], Column]
    word: str
    text: Callable[[Column], Column] | None = None
    whole: bool = False

    def valid(self, c: Column) -> Column:
        return self.check(c if self.whole else self.canonical(c))

    def free_text(self, c: Column) -> Column:
        return self.text_of(self.canonical(c))

    def text_of(self, canonical: Column) -> Column:
        return F.concat(F.lit(f"{self.word} "), self.text(canonical) if self.text else canonical)


_hmrc, _engine, _serial = (lambda c: _without(c, "HMRC")), (lambda c: _without(c, "ENGINE")), (lambda c: _without(c, "SERIAL"))
_card, _vat = (lambda c: F.substring(digits(c), 1, 18)), (lambda c: F.substring(digits(c), 1, 12))
_house = lambda c: F.substring(_without(c, "COMPANIESHOUSE", "CH"), 1, 8)
_charity = lambda c: _without(c, "REGISTEREDCHARITYNUMBER", "CHARITY")
_jabber, _skype = (lambda c: F.lower(_handle(c, "jabber"))), (lambda c: _handle(c, "skype"))
_twitter = lambda c: F.regexp_replace(_handle(c, r"twitter\s*|x\s*"), "^@", "")

# The families' names and the words before them in free text.
FAMILIES = {
    "account": Family(account, lambda c: F.length(alnum(c)).between(1, 18), "AC", whole=True),
    "sortCode": Family(sort_code, sort_code_valid, "SC", whole=True),
    "creditCard": Family(_card, lambda c: F.length(digits(c)).between(12, 18), "CC", whole=True),
    "cro": Family(cro, _like("^S?[0-9]{1,7}/[0-9]{2}[A-Z]$"), "CRO"),
    "pnc": Family(pnc, _like("^[0-9]{2}/[0-9]{1,7}[A-Z]$"), "PNC"),
    "nino": Family(nino, _like(NINO), "NINO", _nino_pairs),
    "nib": Family(nib, _like("^[0-9]{1,6}/[0-9]{2}$"), "NIB"),
    "passport": Family(passport, _like("^([0-9]{9}|[0-9]{6}[A-Z])$"), "PPT"),
    "driverLicence": Family(driver_licence, _driver_licence_form, "DRV"),
    "vat": Family(_vat, lambda c: F.length(digits(c)).isin(9, 12), "VAT", whole=True),
    "hmrc": Family(_hmrc, _long(4), "HMRC"),
    "companiesHouse": Family(_house, _like("^([0-9]{8}|[A-Z]{2}[0-9]{6})$"), "Companies House"),
    "charity": Family(_charity, _like("^([0-9]{6,8}|SC[0-9]{6})$"), "Registered Charity Number"),
    "vrm": Family(vrm, _long(2, 8), "VRM"),
    "vin": Family(vin, _like(VIN), "VIN"),
    "engine": Family(_engine, _long(3), "Engine"),
    "serial": Family(_serial, _long(3), "Serial"),
    "icq": Family(digits, _long(5), "ICQ"),
    "jabber": Family(_jabber, _like("@"), "Jabber"),
    "skype": Family(_skype, _long(3), "Skype"),
    "twitter": Family(_twitter, _like("^[A-Za-z0-9_]{1,15}$"), "Twitter"),
    "ip": Family(ip, ip_loose, "IP Address", whole=True),
}


def identify(family: str, c: Column) -> Column:
    """A struct family, canonical, valid, free_text; null stays null. A family of no name gives the tidied text, not valid."""
    f = FAMILIES.get(family)

    def told(form: Column) -> Column:
        valid, text = (F.coalesce(f.check(c if f.whole else form), F.lit(False)), f.text_of(form)) if f else (F.lit(False), form)
        if family == "cro":
            text = F.concat(F.when(form.startswith("S"), "SCRO ").otherwise("CRO "), form)
        return F.struct(F.lit(family).alias("family"), form.alias("canonical"), valid.alias("valid"), text.alias("free_text"))

    return F.when(c.isNotNull(), bound(f.canonical(c) if f else tidy(c), told))


def ip_valid(c: Column) -> Column:
    part = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|0?[0-9]{1,2})"
    return c.rlike(rf"^{part}(\.{part}){{3}}$") | (c.rlike("^[0-9A-Fa-f:]+$") & c.contains(":"))
