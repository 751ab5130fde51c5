"""Dates and amounts as people write them. All are built-in column functions and give null for what they can't read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkforge.functions.contact import tidy

#: Two-digit years up to this one belong to this century.
PIVOT = 30
# Months by name; the first three letters of a name, and sept, also stand for it.
MONTHS = "january february march april may june july august september october november december".split()
# Zones that a time may name in brackets.
ZONES = "local zulu utc bst gmt".split()
# Currencies known by their code, and the currency that a sign stands for.
CODES = "GBP EUR USD JPY CHF AUD CAD CNY HKD SGD NZD SEK NOK DKK PLN RUB INR AED SAR TRY ZAR BRL MXN NGN PKR THB KRW".split()
SIGNS = {"£": "GBP", "€": "EUR", "$": "USD", "¥": "JPY", "₽": "RUB", "₹": "INR", "₺": "TRY", "₦": "NGN", "₩": "KRW", "฿": "THB"}

def _month(name: Column) -> Column:
    known = {m: i for i, m in enumerate(MONTHS, 1)}
    known |= {m[:3]: i for m, i in known.items()} | {"sept": 9}
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.lower(name)].cast("string")


def _parts(c: Column) -> tuple[Column, list[Column]]:
    """The tidied text and the first three of its words and numbers; null where there aren't just three."""
    s = tidy(c)
    parts = F.filter(F.split(s, "[ /.,-]+"), lambda x: x != "")
    return s, [F.when(F.size(parts) == 3, F.get(parts, F.lit(i))) for i in range(3)]


def _all_numbers(s: Column, parts: list[Column]) -> Column:
    """Whether three numbers stand with one sign between each two."""
    return (F.translate(s, "/.-", "   ") == F.concat_ws(" ", *parts)) & ~s.contains(" ") & F.concat(*parts).rlike("^[0-9]+$")


def parse_date(c: Column) -> Column:
    """2024-03-12, 12/3/2024, 12.3.24, 12 March 2024, 12th Mar 24, March 12, 2024; days that no calendar has give null."""
    s, (a, b, e) = _parts(c)
    numbers = _all_numbers(s, [a, b, e])
    short = lambda x: x.rlike("^[0-9]{1,2}$")
    day_of = lambda x: F.regexp_replace(x, "(?<=[0-9])(st|nd|rd|th)$", "")
    # A dot may follow a month's name, a comma the day after it.
    day_first = s.isin(F.concat_ws(" ", a, b, e), F.concat(a, F.lit(" "), b, F.lit(". "), e))
    month_first = F.replace(s, F.lit(","), F.lit("")).isin(F.concat_ws(" ", a, b, e), F.concat(a, F.lit(". "), b, F.lit(" "), e)) & (~s.contains(",") | s.endswith(F.concat(b, F.lit(", "), e)))

    def date(year: Column, month: Column, day: Column) -> Column:
        century = F.when(year.try_cast("int") <= PIVOT, "20").otherwise("19")
        full = F.when(F.length(year) > 2, F.lpad(year, 4, "0")).otherwise(F.concat(century, year))
        # concat gives null for a month of no name.
        return F.when(F.length(year).between(2, 4) & year.rlike("^[0-9]+$") & short(day), F.try_to_date(F.concat_ws("-", full, month, day), "yyyy-M-d"))

    return (
        F.when(numbers & (F.length(a) == 4) & short(b), date(a, b, e))
        .when(numbers & short(a) & short(b), date(e, b, a))
        .when(day_first & _month(b).isNotNull(), date(e, _month(b), day_of(a)))
        .when(month_first & _month(a).isNotNull(), date(e, _month(a), day_of(b)))
    )


def day_month_swappable(c: Column) -> Column:
    """Whether day and month of a numeric date could change places and give another date."""
    s, parts = _parts(c)
    a, b = (x.try_cast("int") for x in parts[:2])
    fits = _all_numbers(s, parts) & (F.length(parts[0]) <= 2) & (F.length(parts[1]) <= 2) & F.length(parts[2]).between(2, 4)
    return F.coalesce(fits & (a <= 12) & (b <= 12) & (a != b), F.lit(False))


def day_text(c: Column) -> Column:
    """DD/MM/YYYY of a written date; empty where there is none."""
    return F.coalesce(F.date_format(parse_date(c), "dd/MM/yyyy"), F.lit(""))


def day_keys(c: Column) -> Column:
    """A struct of a date's texts: slashes, dots, and eight digits that sort by time; empty where there is none."""
    d = parse_date(c)
    return F.struct(*[F.coalesce(F.date_format(d, shape), F.lit("")).alias(name) for name, shape in (("slashes", "dd/MM/yyyy"), ("dots", "dd.MM.yyyy"), ("key", "yyyyMMdd"))])


def camera_date(c: Column) -> Column:
    """The date of a camera's 2024:03:12 10:00:00; null if there is none."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy:MM:dd")


def time_text(c: Column) -> Column:
    """HH:MM or HH:MM:SS by the 24-hour clock with a zone in brackets kept; empty for what is no time."""
    s = F.lower(tidy(c))
    clock = F.regexp_extract(s, "[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?", 0)
    after = F.trim(F.regexp_extract(s, "[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( ?[ap]m)?", 2))
    parts = F.transform(F.split(clock, ":"), lambda x: x.try_cast("int"))
    h, m, sec = (F.get(parts, F.lit(i)) for i in range(3))
    hour = F.when((after == "pm") & (h < 12), h + 12).when((after == "am") & (h == 12), 0).otherwise(h)
    zone = F.regexp_extract(s, rf"[(]({'|'.join(ZONES)})[)]", 1)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    text = F.concat_ws(":", two(hour), two(m), two(sec))
    named = F.when(zone == "", "").otherwise(F.concat(F.lit(" ("), F.when(zone == "local", "Local").otherwise(F.upper(zone)), F.lit(")")))
    return F.coalesce(F.when((hour <= 23) & (m <= 59) & (F.coalesce(sec, F.lit(0)) <= 59), F.concat(text, named)), F.lit(""))


def parse_amount(c: Column) -> Column:
    """A struct code, amount. A known code goes before a sign; a leading minus, brackets or the word minus make it negative."""
    s = tidy(c)
    words = F.transform(F.filter(F.split(s, "[^A-Za-z0-9_]+"), lambda x: x.rlike("^[A-Za-z]{3}$")), F.upper)
    first = F.get(words, F.lit(0))
    code = F.when(first.isin(CODES), first)
    for sign, name in SIGNS.items():
        code = F.coalesce(code, F.when(F.contains(s, F.lit(sign)), name))
    # The first run of digits, with commas between and one fraction.
    run = F.get(F.filter(F.split(s, "[^0-9.,]+"), lambda x: x.rlike("[0-9]")), F.lit(0))
    plain = F.replace(F.ltrim(F.rtrim(run, F.lit(".,")), F.lit(",")), F.lit(","), F.lit(""))
    whole, fraction = F.get(F.split(plain, "[.]"), F.lit(0)), F.get(F.split(plain, "[.]"), F.lit(1))
    size = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.coalesce(F.when(fraction != "", fraction), F.lit("0"))).try_cast("decimal(28,4)")
    below = s.startswith("-") | (s.contains("(") & s.contains(")")) | F.array_contains(F.split(F.lower(s), "[^a-z0-9_]+"), "minus")
    return F.when(size.isNotNull(), F.struct(code.alias("code"), F.when(below, -size).otherwise(size).alias("amount")))


def amount_text(c: Column) -> Column:
    """GBP 1500 or GBP -250.50; what names no known currency stays as it is."""
    p = parse_amount(c)
    cents = F.round(p["amount"], 2).cast("decimal(26,2)")
    short = F.when(cents % 1 == 0, cents.cast("decimal(26,0)").cast("string")).otherwise(cents.cast("string"))
    return F.when(p["code"].isNotNull(), F.concat_ws(" ", p["code"], short)).otherwise(tidy(c))
