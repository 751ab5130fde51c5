"""Passes over free text that claim what they find, so that later passes leave it alone.

Three steps, without a shuffle. Tasks look for the shapes of all passes, on Arrow batches. Canonical forms that the library has as columns (mail addresses,
phone numbers, dates) are worked out over the finds of a text, and what has none falls. Then a ledger of claimed intervals goes through
a text's finds, pass by pass: a find that meets a claim falls, all others stand and claim their place.

A null or empty text has no finds. Rows are judged alone, so repeated rows and keys are answered alike. Positions count code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from linkforge.functions import contact
from linkforge.functions.vocabulary import WALLETS
from linkforge.operators.dictionary import Finder
from linkforge.operators.recognise import NO_FORENAME, NO_SURNAME

# Months and weekdays as they are written.
MONTHS = {m[:k].lower(): i for i, m in enumerate("January February March April May June July August September October November December".split(), 1) for k in (3, 4, 20)}
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
# What vehicles are called.
COLOURS = "black white silver grey gray blue red green gold brown orange yellow beige maroon dark navy light".split()
MAKES = """BMW;Audi;Mercedes-Benz;Mercedes;VW;Volkswagen;Ford;Vauxhall;Toyota;Honda;Nissan;Range Rover;Land Rover;Jaguar;Kia;Hyundai;Peugeot;Renault;Citroen;Skoda;SEAT;Volvo;
Lexus;Porsche;Tesla;Mini;Fiat;Mazda;Suzuki;Bentley;DAF;Scania;Iveco""".replace("\n", "").split(";")
MODELS = "Golf Polo Passat Sprinter Transit Leon Ibiza Corsa Astra Insignia Focus Fiesta Mondeo Civic Qashqai Juke Clio Megane Captur".split()
BODIES = "van lorry truck hgv motorcycle motorbike moped scooter pickup minibus coach".split()
STREETS = "Road Rd Street St Lane Ln Close Avenue Ave Way Drive Dr Place Pl Court Crescent Gardens Terrace".split()
# The shapes that passes look for.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "date_numeric": r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})\b",
    "date_iso": r"\b(\d{4})-(\d{2})-(\d{2})\b",
    "date_worded": r"\b(?:(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})|([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?,?)\s+(\d{4})\b",
    "date_relative": r"(?i)\b(today|yesterday|tomorrow|last\s+night|this\s+(?:morning|afternoon|evening)|(?:last|next)\s+(?:" + "|".join(WEEKDAYS) + r"|week|month))\b",
    "tag": r"\bXX-[A-Z]{2,6}\b",
    "grading": r"\[\s*([1-3])\s*[·.\s]*([A-E])\s*[·.\s]*([PC])\s*\]",
    "booking": r"\b(?:PNRs?|Locators?|LOCATORS?|locators?|[Bb]ooking\s+[Rr]ef(?:erence)?s?)[\s.:]*\(?([A-Z0-9]{6})\b",
    "imei": r"(?i)\bIMEI(?:\s+(?:no\.?|number|is))?[\s.:=]*((?:[0-9] ?){15})\b",
    "passport": r"\b(?:PPT|[Pp]assport)(?:\s+(?:no\.?|number))?[\s.:]*(?:is\s+)?([0-9]{6,9}|[0-9]{6}[A-Z]|[A-Z]{1,2}[0-9]{6,7})\b(?:\s*\(([^)]{2,40})\))?",
    "cro": r"\bS?CRO[\s.:]*(?:is\s+)?([0-9]{1,6}/[0-9]{2}[A-Z]?)\b",
    "pnc": r"\bPNC(?:\s?ID)?[\s.:]*(?:is\s+)?([0-9]{2,4}/[0-9]{1,7}[A-Z])\b",
    "nino": r"\b(?:NINO|[Nn]ational\s+[Ii]nsurance(?:\s+(?:[Nn]o\.?|[Nn]umber))?)[\s.:]*(?:is\s+)?([A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D])\b",
    "nino_bare": r"\b([A-CEGHJ-PR-TW-Z]{2}\s\d{2}\s\d{2}\s\d{2}\s[A-D])\b",
    "company_number": r"(?i)\b(?:Co(?:mpany)?\.?\s*(?:No|Number)\.?|Companies\s+House(?:\s+No\.?)?)[\s.:]*\(?(\d{8})\)?",
    "finance_code": r"\b(AC|SC|CC)[\s.:]+([0-9A-Z]{6,18})\b",
    "sort_account": r"(?i)\b(?:s/c|sort\s*code)\s*([0-9]{2}-[0-9]{2}-[0-9]{2})\s+a/c\s*([0-9]{4,8})\b",
    "account_sort": r"(?i)\baccount\s+(\d{6,8})\s*(?:,|at|held\s+at)?\s*(?:sort\s*code|s/c)[\s:]*(\d{2}-\d{2}-\d{2})",
    "account": r"(?i)\baccount\s+(?:number\s+|no\.?\s+)?(\d{6,8})\b",
    "iban": r"(?i)\bIBAN[\s:]*([A-Z]{2}\d{2}(?: ?[A-Z0-9]{2,4}){2,8}(?: ?\d)?)",
    "bank_account": r"\b([A-Z][a-z]+)\s+a/c\s+(?:ending\s+)?([0-9]{4,8})\b",
    "other_number": r"(?i)\b(UTR|VAT|PAYE|IMSI|ICCID)[^0-9\n]{0,40}([A-Z]{0,2}\s*[0-9][0-9A-Z\s/-]{5,20})\b",
    "phone": r"(?:\+|00)?\d[\d\s().-]{7,18}\d",
    "address": r"\b(?:[Cc][/.]\s?[A-ZÁÉÍÓÚÑ][\wáéíóúñü.-]+|Calle\s+\w+|Avda\.?\s+\w+|Av\.?\s+\w+|(?:\d{1,4}\s+)?[A-Z][a-z]+\s+(?:" + "|".join(STREETS) + r"))\b[^.\n•]{0,90}",
    "postcode": r"\b[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}\b",
    "airport": r"\b([A-Z][A-Za-zÁÉÍÓÚáéíóúñü-]+(?:\s[A-Z][A-Za-z-]+)?)\s+[Aa]irport\b",
    "plate": r"\b[A-Z]{2}\d{2}\s?[A-Z]{3}\b",
    "vehicle_name": r"\b(?:(" + "|".join(COLOURS) + r")\s+)?((?:" + "|".join(MAKES) + r")(?:\s+[A-Z][a-z]+)?|(?:" + "|".join(MODELS) + r"))\b",
    "vehicle_body": r"(?i)\b(?:(" + "|".join(COLOURS) + r")\s+|(?:the|a|an|that|same)\s+)(" + "|".join(BODIES) + r")\b",
    "money": r"(?:£|€|\$)[ \t]?\d[\d,]*(?:\.\d{1,2})?(?:[ \t]?(?:k|m|million|thousand))?|\b\d[\d,]*(?:\.\d{1,2})?[ \t](?:GBP|EUR|USD)\b|\b(?:GBP|EUR|USD)[ \t]\d[\d,]*(?:\.\d{1,2})?\b",
    "person": r"\b((?:[A-Z][a-zà-öø-ÿ'’]+(?:-[A-Z]?[a-zà-öø-ÿ]+)*\s+){1,3})([A-Z][A-Z'’-]{1,39})\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
}
# What stands before a number that is no phone number, in either case: (characters to look back, shape).
NO_PHONE = [
    (48, r"\b(?:passport|national\s+insurance|NINO|NHS\s+(?:no\.?|number)|driving\s+licen[cs]e)\b[^0-9\n]{0,44}$"),
    (28, r"\b(?:SAR|CD|CNX|HMRC|PND|NBTC|IR|URN|REF|REFERENCE|DISCLOSURE|CASE|REQ)(?![A-Za-z])[\s/:#-]*$"),
    (28, r"\b(?:UTR|VAT|PAYE|Co\.?\s*No\.?|Company\s+No\.?|PNR|PNCID|CRO|PPT|IMSI|ICCID|IMEI)(?![A-Za-z])[^0-9\n]{0,40}$"),
    (28, r"\b(?:UTR|VAT|PAYE|VAT\s+number|Company\s+number|Disclosure\s+ref)\b[^\n]*\n\s*(?:GB\s*)?$"),
]
NO_PHONE_WITH = r"[A-Z]{2,}[-/][0-9]{4}[-/A-Z0-9]*$"
NO_PHONE_NEAR = r"\b(?:ref|reference|case|disclosure|requirement)\b"

_R = {name: re.compile(shape) for name, shape in SHAPES.items()}
#: Of a shape's words in lower case, those of which a text must hold one for any find; looking for them is much cheaper than for the shape. Shapes without such words aren't listed.
NEEDS = {
    "date_relative": ("today", "yesterday", "tomorrow", "last", "this", "next"), "tag": ("xx-",), "grading": ("[",), "booking": ("pnr", "locator", "ooking"), "imei": ("imei",), "passport": ("ppt", "assport"), "cro": ("cro",), "pnc": ("pnc",),
    "nino": ("nino", "ational"), "company_number": ("co",), "finance_code": ("ac", "sc", "cc"), "sort_account": ("a/c",), "account_sort": ("account",), "account": ("account",), "iban": ("iban",), "bank_account": ("a/c",),
    "other_number": ("utr", "vat", "paye", "imsi", "iccid"), "address": ("c/", "c.", "calle", "av", *(s.lower() for s in STREETS)), "airport": ("irport",), "vehicle_name": tuple(s.lower() for s in (*MAKES, *MODELS)), "vehicle_body": tuple(BODIES),
    "money": ("£", "€", "$", "gbp", "eur", "usd"),
}
#: Shapes all of whose finds hold a digit.
_DIGIT = re.compile(r"\d")
NUMBERED = frozenset("date_numeric date_iso date_worded grading imei passport cro pnc nino nino_bare company_number sort_account account_sort account iban bank_account other_number phone postcode plate money ip".split())
#: Letters that shapes without case take for i, s or k, though lower case leaves them.
_ODD_CASE = "İıſ\u212a"


class Caseless:
    """A shape in either case. ASCII texts are put in lower case first, which leaves positions as they are and is much faster than to compare letters in either case."""

    def __init__(self, shape: str):
        self.shape, self.low = re.compile(f"(?i){shape}"), re.compile(shape.lower())

    def found(self, text: str) -> bool:
        return (self.low.search(text.lower()) if text.isascii() else self.shape.search(text)) is not None

    def last(self, text: str) -> str | None:
        """The last find as written."""
        spans = [m.span() for m in (self.low.finditer(text.lower()) if text.isascii() else self.shape.finditer(text))]
        return text[spans[-1][0] : spans[-1][1]] if spans else None


_NO_PHONE = [(n, Caseless(shape)) for n, shape in NO_PHONE]
#: How words begin of which each of NO_PHONE needs one, in lower case; looking for them is cheaper. They may begin within a word, as what is looked back on may.
_NO_PHONE_WORDS = re.compile("passport|national|nino|nhs|driving|sar|cd|cnx|hmrc|pnd|nbtc|ir|urn|ref|disclosure|case|req|utr|vat|paye|co|pnr|pnc|cro|ppt|imsi|iccid|imei")
_NO_PHONE_WITH, _NO_PHONE_NEAR = Caseless(NO_PHONE_WITH), Caseless(NO_PHONE_NEAR)
_PLATE_AHEAD = re.compile(r"[A-Z]{2}\d{2}\s?[A-Z]{3}\b")
_COLOUR, _MAKE = (Caseless(rf"\b(?:{'|'.join(words)})\b") for words in (COLOURS, [*MAKES, "Transit", "Sprinter"]))
_UK, _ES = re.compile(r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"), re.compile(r"\b(?:0[1-9]|[1-4]\d|5[0-2])\d{3}\b")
_ADDRESS_STOP = re.compile(r"(?i:[\s,;]*\b(?:tel(?:ephone)?|phone|mob(?:ile)?|fax|contact)\b)|\s+(?:and|who|which|but|where|while)\s+")
_PREMISES_AT = re.compile(r"(?i)\b(?:\d{1,4}[a-z]?\s+[A-Za-z]|(?:Unit|Flat|Apartment)\b)")
_BUILT = re.compile(r"(?i)^\d{1,4}[a-z]?\s|\b\d{1,4}[a-z]?\s+[A-Za-z]|\b(?:ROAD|RD|STREET|LANE|CLOSE|AVENUE|AVE|WAY|DRIVE|COURT|CRESCENT|GARDENS|TERRACE|PARK|HOUSE|UNIT|FLAT|ESTATE|HEIGHTS|BUILDINGS?)\b")


class Ledger:
    """Claimed intervals of one text, kept apart and in order."""

    def __init__(self) -> None:
        self.begin: list[int] = []
        self.end: list[int] = []

    def free(self, s: int, e: int) -> bool:
        k = bisect_right(self.end, s)
        return k == len(self.begin) or self.begin[k] >= e

    def claim(self, s: int, e: int) -> None:
        lo, hi = bisect_left(self.end, s), bisect_right(self.begin, e)
        if lo < hi:
            s, e = min(s, self.begin[lo]), max(e, self.end[hi - 1])
        self.begin[lo:hi], self.end[lo:hi] = [s], [e]


class Find(NamedTuple):
    """What a pass has found: its span, its value, or the part from which a column makes one, and what else it tells."""

    s: int
    e: int
    value: str | None
    note: str = ""
    again: bool = False  # speaks of something named before


@dataclass(frozen=True)
class Pass:
    """kind: what its finds are. look: finds in a text. asks: whether it heeds claims; claims: whether it makes any; once: only a text's first."""

    kind: str
    look: Callable[[str, re.Pattern], Iterator[Find]]
    shape: str
    asks: bool = True
    claims: bool = True
    once: bool = False


def _part(group: int, note: str = "", span: int = 0, drop: str = r"\s+") -> Callable[[str, re.Pattern], Iterator[Find]]:
    """Finds whose value is a group of the shape without what drop matches, and whose span is the group span."""
    gone = re.compile(drop)

    def look(text: str, shape: re.Pattern) -> Iterator[Find]:
        for m in shape.finditer(text):
            yield Find(*m.span(span), gone.sub("", m[group]), note)

    return look


_DOMAIN = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def _mails(text: str, _: re.Pattern) -> Iterator[Find]:
    """The shape of an address, sought from each @ to both sides, so that time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _USER:
            s -= 1
        m = s < at and _DOMAIN.match(text, at + 1)
        if m:
            yield Find(s, m.end(), text[s : m.end()])
        done = m.end() if m else max(done, at)
        at = text.find("@", max(done, at + 1))


_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _iso(y: int, m: int, d: int) -> str | None:
    return f"{y}-{m:02}-{d:02}" if 1 <= m <= 12 and 1 <= d <= 31 else None


def _numeric(text: str, shape: re.Pattern) -> Iterator[Find]:
    """Day first, unless only the other way is a date."""
    for m in shape.finditer(text):
        d, mo, y = map(int, m.groups())
        unsure = d <= 12 and mo <= 12 and d != mo
        if mo > 12 >= d:
            d, mo = mo, d
        if iso := _iso(y, mo, d):
            yield Find(*m.span(), iso, "day or month" if unsure else "")


def _iso_dates(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        if iso := _iso(*map(int, m.groups())):
            yield Find(*m.span(), iso)


def _worded(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        month = MONTHS.get((m[2] or m[3]).lower())
        if month and (iso := _iso(int(m[5]), month, int(m[1] or m[4]))):
            yield Find(*m.span(), iso)


def _wallets(text: str, _: re.Pattern) -> Iterator[Find]:
    for coin, shape in _WALLETS:
        for m in shape.finditer(text):
            yield Find(*m.span(), m[0], coin)


_WALLETS = [(coin, re.compile(shape)) for coin, shape in WALLETS]


def _booking(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        if re.search(r"\d", m[1]) and re.search("[A-Z]", m[1]):
            yield Find(*m.span(1), m[1])


def _passport(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        yield Find(*m.span(), f"{m[1]} {m[2]}" if m[2] else m[1])


def _codes(text: str, shape: re.Pattern) -> Iterator[Find]:
    kinds = {"AC": "account", "SC": "sort code", "CC": "card"}
    for m in shape.finditer(text):
        if m[1] != "SC" or re.fullmatch(r"\d{6}", m[2]):
            yield Find(*m.span(), m[2], kinds[m[1]])


def _two(first: int, second: int) -> Callable[[str, re.Pattern], Iterator[Find]]:
    """An account: the digits of a sort code or the name of a bank, then the number."""
    def look(text: str, shape: re.Pattern) -> Iterator[Find]:
        for m in shape.finditer(text):
            yield Find(*m.span(), m[first].replace("-", "") + m[second], "account")

    return look


def _accounts(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        if not re.match(r"(?i)\s*(?:,?\s*(?:at\s+|held\s+at\s+)?sort|/?\s*\d{2}-\d{2}-\d{2})", text[m.end() : m.end() + 20]):
            yield Find(*m.span(), m[1], "account")


def _others(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        key = m[1].lower()
        yield Find(*m.span(), re.sub(r"\D", "", m[2]) if key in ("imsi", "iccid") else re.sub(r"\s+", "" if key == "vat" else " ", m[2]).strip(), key)


def _phones(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        s, e = m.span()
        back, before = text[max(0, s - 48) : s], text[max(0, s - 28) : s]
        if not 9 <= sum(map(str.isdecimal, m[0])) <= 15:
            continue
        if back.isascii():
            low = back.lower()
            told = _NO_PHONE_WORDS.search(low) and any(p.low.search(low[-n:]) for n, p in _NO_PHONE)
        else:
            told = any(p.found(back[-n:]) for n, p in _NO_PHONE)
        if told:
            continue
        near = before + m[0] + text[e : e + 16]
        if ("-" in near or "/" in near) and (_NO_PHONE_WITH.found(before + m[0]) or _NO_PHONE_NEAR.found(near)):
            continue
        yield Find(s, e, m[0])


def _addresses(towns: frozenset[str]) -> Callable[[str, re.Pattern], Iterator[Find]]:
    """Streets with evidence: a number, a postcode or a known town; with only a capital behind a comma they are doubtful."""
    def look(text: str, shape: re.Pattern) -> Iterator[Find]:
        for m in shape.finditer(text):
            stop = _ADDRESS_STOP.search(m[0])
            raw = m[0][: stop.start() if stop else None].rstrip(" \t\r\n\f\v,;")
            if post := _UK.search(raw):
                raw = raw[: post.end()]
            town = any(t.lower() in towns for t in re.split(r"[,\s]+", raw))
            sure = bool(post or town or _ES.search(raw))
            if sure or raw[:1] in "123456789" or re.search(r",\s*[A-Z][a-z]+", raw):
                yield Find(m.start(), m.start() + len(raw), raw, "" if sure else "no postcode" if raw[:1] in "123456789" else "doubtful")

    return look


def _postcodes(text: str, shape: re.Pattern) -> Iterator[Find]:
    """Lines that end in a postcode and look like an address."""
    for m in shape.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        begin = max(line, m.start() - 400)
        if begin == line and (label := re.match(r"[^:]*:\s*", text[line : m.end()])):
            begin = line + label.end()
        begin += re.match(r"[\s,;]*", text[begin : m.end()]).end()
        if number := _PREMISES_AT.search(text[begin : m.end()]):
            begin += number.start()
        raw = text[begin : m.end()]
        if 8 <= len(raw) <= 120 and _BUILT.search(raw):
            yield Find(begin, m.end(), raw)


def _places(finder: Finder) -> Callable[[str, re.Pattern], Iterator[Find]]:
    def look(text: str, _: re.Pattern) -> Iterator[Find]:
        for s, e, key in sorted(finder.hits(text), key=lambda h: (h[0] - h[1], h[0])):
            yield Find(s, e, key)

    return look


def _plates(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        back = text[max(0, m.start() - 44) : m.start()]
        told = [found for found in (_COLOUR.last(back), _MAKE.last(back)) if found]
        yield Find(*m.span(), re.sub(r"\s+", "", m[0]), " ".join(told))


def _vehicles(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        if not _PLATE_AHEAD.search(text[m.end() : m.end() + 40]):
            the = re.search(r"(?i)\b(?:the|that|this|same)\s+$", text[max(0, m.start() - 6) : m.start()])
            yield Find(*m.span(), " ".join(m[2].split()), (m[1] or "").lower(), bool(the))


def _bodies(text: str, shape: re.Pattern) -> Iterator[Find]:
    for m in shape.finditer(text):
        yield Find(m.start() if m[1] else m.start(2), m.end(), m[2].lower(), (m[1] or "").lower())


def _money(text: str, shape: re.Pattern) -> Iterator[Find]:
    """Without years and small numbers beside a currency, which are columns of tables."""
    for m in shape.finditer(text):
        bare = re.fullmatch(r"(\d{1,4})[ \t](?:GBP|EUR|USD)|(?:GBP|EUR|USD)[ \t](\d{1,4})", m[0])
        number = bare and (bare[1] or bare[2])
        if not bare or (len(number) > 2 and not re.fullmatch(r"(?:19|20)\d{2}", number)):
            yield Find(*m.span(), m[0].strip())


def _people(text: str, shape: re.Pattern) -> Iterator[Find]:
    """Forenames and a SURNAME, without words that are neither."""
    for m in shape.finditer(text):
        fore = [w for w in re.finditer(r"\S+", m[1])]
        while fore and fore[0][0].lower() in NO_FORENAME:
            fore = fore[1:]
        if fore and m[2] not in NO_SURNAME:
            yield Find(m.start() + fore[0].start(), m.end(), " ".join([*(w[0] for w in fore), m[2]]))


def passes(names: list[str] | None = None, towns: list[str] | None = None) -> list[Pass]:
    """All passes in order. names: keys of places to look for; towns: those that make a street an address."""
    return [
        Pass("email", _mails, "email", asks=False), Pass("wallet", _wallets, "email"),
        Pass("date", _numeric, "date_numeric", asks=False), Pass("date", _iso_dates, "date_iso"), Pass("date", _worded, "date_worded"), Pass("relative", _part(0, "relative", drop="(?!)"), "date_relative"),
        Pass("tag", _part(0), "tag", asks=False, claims=False), Pass("grading", lambda t, p: (Find(*m.span(), "".join(m.groups())) for m in p.finditer(t)), "grading", asks=False, claims=False, once=True),
        Pass("booking", _booking, "booking"), Pass("imei", _part(1), "imei"), Pass("passport", _passport, "passport"), Pass("cro", _part(1), "cro"), Pass("pnc", _part(1), "pnc"),
        Pass("nino", _part(1), "nino"), Pass("nino", _part(1), "nino_bare"), Pass("company_number", _part(1), "company_number"),
        Pass("account", _codes, "finance_code"), Pass("account", _two(1, 2), "sort_account"), Pass("account", _two(2, 1), "account_sort"), Pass("account", _accounts, "account"),
        Pass("account", _part(1, "iban"), "iban"), Pass("account", _two(1, 2), "bank_account"), Pass("other_number", _others, "other_number"),
        Pass("phone", _phones, "phone"), Pass("address", _addresses(frozenset(towns or ())), "address"), Pass("address", _postcodes, "postcode"),
        Pass("place", _part(0, "airport", drop="(?!)"), "airport"), Pass("place", _places(Finder(names or [])), "email"),
        Pass("vehicle", _plates, "plate"), Pass("vehicle", _vehicles, "vehicle_name"), Pass("vehicle", _bodies, "vehicle_body"), Pass("money", _money, "money"), Pass("ip", _part(0), "ip"),
        Pass("person", _people, "person"),
    ]


_FOUND = pa.list_(pa.struct([("nth", pa.int32()), ("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("raw", pa.string()), ("value", pa.string()), ("note", pa.string()), ("again", pa.bool_())]))
STANDING = "array<struct<kind:string,s:int,e:int,raw:string,value:string,note:string>>"
FOUND = "array<struct<nth:int,kind:string,s:int,e:int,raw:string,value:string,note:string,again:boolean>>"


def relative_day(phrase: Column, day: Column) -> Column:
    """The day that words like yesterday, last Tuesday or next week mean on a given day; null for a null day."""
    low = F.regexp_replace(F.lower(phrase), r"\s+", " ")
    word = F.substring_index(low, " ", -1)
    back = low.startswith("last")
    named = F.coalesce(*[F.when(word == w, F.when(back, F.next_day(F.date_sub(day, 8), w[:3])).otherwise(F.next_day(day, w[:3]))) for w in WEEKDAYS])
    span = F.when(word == "week", 7).when(word == "month", 30)
    return (
        F.when((low == "today") | low.startswith("this"), day).when(low.isin("yesterday", "last night"), F.date_sub(day, 1)).when(low == "tomorrow", F.date_add(day, 1))
        .when(span.isNotNull(), F.date_add(day, F.when(back, -span).otherwise(span))).otherwise(named)
    )


def looked_at(text: str, table: list[Pass]) -> Iterator[tuple[int, Pass]]:
    """The numbered passes that may find anything in a text: those whose shape needs none of NEEDS' words, or of which the text holds one, and a digit where the shape needs that."""
    low, numbers = text.lower(), _DIGIT.search(text) is not None
    odd = not text.isascii() and any(c in text for c in _ODD_CASE)
    for nth, p in enumerate(table):
        words = NEEDS.get(p.shape)
        if p.shape in NUMBERED and not numbers:
            continue
        if words is None or odd or any(w in low for w in words):
            yield nth, p


class Known:
    """A shape whose finds in a text are known by gaps, the lengths of what lies before each."""

    def __init__(self, shape: re.Pattern):
        self.shape, self.gaps = shape, []

    def finditer(self, text: str) -> Iterator[re.Match]:
        at = 0
        for gap in self.gaps:
            m = self.shape.match(text, at + gap)
            if m is None:  # Arrow looks at what is behind a find as at a text of its own, so it takes the place right behind for the border of a word
                yield from self.shape.finditer(text, at)
                return
            yield m
            at = m.end()


#: Texts in which Arrow's expressions and Python's may differ: those with letters, digits or blanks beyond ASCII. Marks that are none of these and often stand in texts are excepted.
_BEYOND = r"[^\x00-\x7F£€·•’‘“”–—…«»]|[\x0b\x1c-\x1f]"
#: Passes that look for finds in their own way, if Arrow's expressions tell the texts that may have any; and these expressions, where they aren't the pass's shape.
_OWN = (_mails, _wallets)
_QUICK = {_wallets: "|".join(re.sub(r"\(\?<?![^)]*\)", "", shape) for _, shape in WALLETS)}


def looked_for(texts: pa.Array, table: list[Pass]) -> Iterator[tuple[int, Pass, list[int], list[list[int]] | None]]:
    """(number, pass, texts in which it may find anything, for each of them the gaps of Known or None in all). Arrow searches all texts for a shape at once."""
    there = pc.fill_null(pc.not_equal(texts, ""), False)
    beyond = pc.and_(pc.fill_null(pc.match_substring_regex(texts, _BEYOND), False), there)
    plain = np.flatnonzero(pc.and_not(there, beyond).to_numpy(zero_copy_only=False))
    some = texts.take(pa.array(plain)) if len(plain) < len(texts) else texts
    others: dict[int, list[int]] = {}
    for i in np.flatnonzero(beyond.to_numpy(zero_copy_only=False)).tolist():
        for nth, _ in looked_at(texts[i].as_py(), table):
            others.setdefault(nth, []).append(i)
    for nth, p in enumerate(table):
        if nth in others:
            yield nth, p, others[nth], None
        quick = _QUICK.get(p.look, SHAPES[p.shape]) if p.look in _OWN or p.shape != "email" else None
        found = np.arange(len(plain)) if quick is None else np.flatnonzero(pc.match_substring_regex(some, quick).to_numpy(zero_copy_only=False))
        if not len(found):
            continue
        gaps = None
        if quick is not None and p.look not in _OWN:
            pieces = pc.split_pattern_regex(some.take(pa.array(found)) if len(found) < len(some) else some, quick)
            length, begin = pc.utf8_length(pieces.values).to_pylist(), pieces.offsets.to_pylist()
            gaps = [length[lo : hi - 1] for lo, hi in zip(begin, begin[1:])]
        yield nth, p, plain[found].tolist(), gaps


def candidates(texts: DataFrame, text: str, table: list[Pass], keep: bool = True) -> DataFrame:
    """texts, without the text itself if it isn't to be kept, with a column found: all finds of all passes, in their order, overlaps included."""
    place = texts.columns.index(text)
    schema = StructType([*(f for f in texts.schema.fields if keep or f.name != text), StructField("found", DataType.fromDDL(FOUND))])
    kinds = pa.array([p.kind for p in table])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            here = b.column(place)
            written = here.to_pylist()
            at, nths, raw, s, e, value, note, again = ([] for _ in range(8))
            for nth, p, which, gaps in looked_for(here, table):
                shape = _R[p.shape] if gaps is None else Known(_R[p.shape])
                for k, i in enumerate(which):
                    if gaps is not None:
                        shape.gaps = gaps[k]
                    t = written[i]
                    for f in p.look(t, shape):
                        at.append(i)
                        nths.append(nth)
                        raw.append(t[f[0] : f[1]])
                        s.append(f[0])
                        e.append(f[1])
                        value.append(f[2])
                        note.append(f[3])
                        again.append(f[4])
                        if p.once:
                            break
            place_of = np.array(at, np.int64)
            order = pa.array(np.argsort(place_of, kind="stable"))
            nth = pa.array(nths, pa.int32())
            fields = [nth, kinds.take(nth), *(pa.array(x, f.type) for x, f in zip((s, e, raw, value, note, again), list(_FOUND.value_type)[2:]))]
            ends = np.concatenate(([0], np.cumsum(np.bincount(place_of, minlength=len(written)))))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([x.take(order) for x in fields], fields=list(_FOUND.value_type)), type=_FOUND)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns) if keep or k != place), found], names=schema.names)

    return texts.mapInArrow(look, schema)


def valued(found: Column, day: Column) -> Column:
    """Finds with their canonical values; those that have none are left out."""
    def value(c: Column) -> Column:
        return (
            F.when(c["kind"] == "email", F.coalesce(contact.email_canonical(c["value"]), c["value"])).when(c["kind"] == "phone", contact.e164(c["value"]))
            .when(c["kind"] == "relative", F.date_format(relative_day(c["value"], day), "yyyy-MM-dd")).otherwise(c["value"])
        )

    some = F.transform(found, lambda c: c.withField("value", value(c)))
    return F.filter(some, lambda c: c["value"].isNotNull())


def standing(places: Iterable[tuple[int, int, int]], table: list[Pass], told: Callable[[int], tuple[str, str, bool]] | None) -> list[int]:
    """Which of the finds, given as (number of the pass, s, e), stand, pass by pass, as each claims its place. told: a vehicle's note and value and whether it speaks of one before; None where none does."""
    ledger, out, vehicles = Ledger(), [], []
    for i, (nth, s, e) in enumerate(places):
        p = table[nth]
        if p.asks and not ledger.free(s, e):
            continue
        if p.claims:
            ledger.claim(s, e)
        if told and p.kind == "vehicle":
            # The BMW, after a BMW was told of, is no vehicle of its own.
            note, value, again = told(i)
            if again and any(value.upper() in v for v in vehicles):
                continue
            vehicles.append(f"{note} {value}".upper())
        out.append(i)
    return out


def stand(found: list[dict], table: list[Pass]) -> list[dict]:
    """The finds that stand, pass by pass, as each claims its place."""
    return [found[i] for i in standing([(f["nth"], f["s"], f["e"]) for f in found], table, lambda i: (found[i]["note"], found[i]["value"], found[i]["again"]))]


def settled_places(lists: pa.ListArray, table: list[Pass]) -> tuple[pa.Array, pa.Array]:
    """(where each text's finds begin and end, which of all finds stand, in order of the text). Texts whose finds lie apart, none of which speaks of one before, need no ledger."""
    begin, finds = lists.offsets.to_numpy(), lists.values
    s, e, again = (finds.field(k).to_numpy(zero_copy_only=False) for k in ("s", "e", "again"))
    row = np.repeat(np.arange(len(lists)), np.diff(begin))
    s, e, again = (x[begin[0] : begin[-1]] for x in (s, e, again))
    order = np.lexsort((s, row))
    meet = (row[order][1:] == row[order][:-1]) & (e[order][:-1] > s[order][1:])
    stands = np.ones(len(row), bool)
    if len(some := np.unique(np.concatenate((row[order][1:][meet], row[again.astype(bool)])))):
        nth = finds.field("nth")
        for r in some.tolist():
            lo, hi = int(begin[r]), int(begin[r + 1])
            first = lo - int(begin[0])
            mine = slice(first, first + hi - lo)
            told = None
            if again[mine].any():
                note, value = (finds.field(k)[lo:hi].to_pylist() for k in ("note", "value"))
                told = lambda i, note=note, value=value, back=again[mine]: (note[i], value[i], bool(back[i]))
            stands[mine] = False
            stands[[first + i for i in standing(zip(nth[lo:hi].to_pylist(), s[mine].tolist(), e[mine].tolist()), table, told)]] = True
    which = order[stands[order]]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[which], minlength=len(lists)))))
    return pa.array(ends, pa.int32()), pa.array(which + begin[0])


_OUT = pa.list_(pa.struct([(k, pa.string() if k in ("kind", "raw", "value", "note") else pa.int32()) for k in ("kind", "s", "e", "raw", "value", "note")]))


def claimed(texts: DataFrame, text: str = "text", day: Column | None = None, names: list[str] | None = None, towns: list[str] | None = None, keep: bool = True) -> DataFrame:
    """texts, without the text itself if it isn't to be kept, with a column found: an array of (kind, s, e, raw, value, note), the finds that stand in order of the text. See claims()."""
    table = passes(names, towns)
    found = candidates(texts, text, table, keep)
    found = found.withColumn("found", valued(F.col("found"), F.lit(None).cast("date") if day is None else day))
    last = found.columns.index("found")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(last)
            finds, ends, which = lists.values, *settled_places(lists, table)
            out = pa.StructArray.from_arrays([finds.field(f.name).take(which).cast(f.type) for f in _OUT.value_type], fields=list(_OUT.value_type))
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.ListArray.from_arrays(ends, out, type=_OUT)], names=b.schema.names)

    return found.mapInArrow(settle, StructType([*found.schema.fields[:last], StructField("found", DataType.fromDDL(STANDING))]))


def claims(texts: DataFrame, text: str = "text", day: Column | None = None, names: list[str] | None = None, towns: list[str] | None = None) -> DataFrame:
    """texts' other columns with (kind, s, e, raw, value, note), one row a find that stands.

    day: the day on which a text was written, by which yesterday and the like are told; without it they are no finds. names and towns: folded keys of places,
    as dictionary.keyed() makes them; the caller bounds their number.
    """
    others = [c for c in texts.columns if c != text]
    return claimed(texts, text, day, names, towns, keep=False).select(*others, F.explode("found").alias("found")).select(*others, "found.*")
