"""Names: their parts, and their similarity as Arrow-batched pandas functions, as no built-in function has it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from linkforge.functions.contact import tidy

# Titles, suffixes of names, and particles that belong to the surname.
TITLES = "Mr Mrs Miss Ms Mx Dr Prof Rev Fr Sr Sir Dame Lord Lady Master Capt Major Col Sgt Cpl Lt Cmdr Hon Judge Rabbi Imam Sheikh".split()
SUFFIXES = "Jr Snr Sr II III IV V OBE MBE CBE QC KC VC GC PhD MD Esq".split()
PARTICLES = "de del della der van von da di du la le los las bin ibn al el san santa st ter ten".split()


def jaro(a: str, b: str) -> float:
    """Matches within half the longer length, less half the share of those out of order."""
    if not a or not b:
        return 0.0
    reach, taken, left = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, t in zip(b, taken) if t]
    m, moved = len(left), sum(x != y for x, y in zip(left, right)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """jaro() raised by a tenth of the rest for each of up to four common first letters, at any score; in lower case, 1 for equal texts."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    base, same = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return base + same * 0.1 * (1 - base)


@F.pandas_udf(DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """jaro_winkler() of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


# Forenames that stand for each other, a group a line.
NICKNAMES = """
geoffrey geoff jeff jeffrey
michael mike mick micky
david dave davey
james jim jimmy jamie
william will bill billy liam
robert rob bob bobby robbie
richard rich rick ricky dick
anthony tony ant
stephen steven steve stevie
christopher chris kit
catherine katherine kate katie cathy kathy
elizabeth liz lizzie beth betty
thomas tom tommy
daniel dan danny
matthew matt matty
nicholas nick nicky
andrew andy drew
benjamin ben benny
samuel sam sammy
samantha sam
joseph joe joey
jonathan jon john johnny jack
edward ed eddie ted teddy
henry harry hal
alexander alex sandy
alexandra alex sandra
patrick pat paddy
patricia pat trish tricia
susan sue suzie
terence terry tel
kenneth ken kenny
raymond ray
gary gaz gazza
barry baz bazza
sharon shaz
charles charlie chas
frederick fred freddie
gerald gerry ged
lawrence laurence larry laz
margaret maggie meg peggy
jennifer jen jenny
rebecca becky becca
deborah debbie debs
victoria vicky tori
timothy tim timmy
philip phillip phil
gregory greg
douglas doug dougie
stuart stewart stu
graham graeme
mohammed mohammad muhammad mo
"""
_GROUPS: dict[str, set[int]] = {}
for _i, _line in enumerate(NICKNAMES.split("\n")):
    for _name in _line.split():
        _GROUPS.setdefault(_name, set()).add(_i)
#: Weights of surname and forename, the most that a name of one word scores, and the least Jaro-Winkler of close surnames and forenames.
SURNAME, FORENAME, ONE_WORD, CLOSE_SURNAME, CLOSE_FORENAME = 0.62, 0.38, 0.84, 0.94, 0.92


def same_nickname_group(a: str, b: str) -> bool:
    return bool(_GROUPS.get(a, set()) & _GROUPS.get(b, set()))


def forename_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if same_nickname_group(a, b):
        return 0.97
    if min(len(a), len(b)) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    close = jaro_winkler(a, b)
    return close * 0.95 if close >= CLOSE_FORENAME else 0.0


def person_score(a: str, b: str) -> float:
    """Likeness of two canonical names, 0 to 1: the surname weighs most; of forenames the best pair counts."""
    left, right = a.split(), b.split()
    if not left or not right:
        return 0.0
    single = min(len(left), len(right)) == 1
    if left == right:
        return ONE_WORD if single else 1.0
    close = jaro_winkler(left[-1], right[-1])
    surname = 1.0 if left[-1] == right[-1] else close * (0.9 if close >= CLOSE_SURNAME else 0.5)
    if single:
        return min(ONE_WORD, surname)
    return SURNAME * surname + FORENAME * max(forename_score(x, y) for x in left[:-1] for y in right[:-1])


@F.pandas_udf(DoubleType())
def person_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """person_score() of two columns of canonical names; null where either is."""
    return pd.Series([None if x is None or y is None else person_score(x, y) for x, y in zip(a, b)], dtype="float64")


def title_case(c: Column) -> Column:
    """Each word with a capital; parts after a hyphen or apostrophe too, and the letter after Mc or Mac."""
    low = F.regexp_replace(F.lower(tidy(c)), "([-' ])", "\u0001$1\u0001")

    def after(x: Column, lead: str) -> Column:
        n = len(lead)
        return F.concat(F.lit(lead.capitalize()), F.upper(F.substring(x, n + 1, 1)), F.substring(x, n + 2, 1000))

    def part(x: Column) -> Column:
        return F.when(x.rlike("^mc[a-z]"), after(x, "mc")).when(x.rlike("^mac[a-z]"), after(x, "mac")).otherwise(after(x, ""))

    return F.array_join(F.transform(F.split(low, "\u0001"), part), "")


def person_parts(c: Column) -> Column:
    """A struct title, forenames, surname, suffix. The surname is the last word with the particles before it, or what stands before a comma."""
    s = tidy(c)
    sides = F.split(s, ",")
    turned = (F.size(sides) == 2) & (F.trim(F.get(sides, F.lit(0))) != "") & (F.trim(F.get(sides, F.lit(1))) != "")
    words = F.split(F.when(turned, F.trim(F.get(sides, F.lit(1)))).otherwise(s), " ")
    known = lambda x, names: F.create_map(*[F.lit(v) for n in names for v in (n.lower(), n)])[F.lower(F.replace(x, F.lit("."), F.lit("")))]
    title = F.when(turned | (F.size(words) > 1), known(F.get(words, F.lit(0)), TITLES))
    words = F.when(title.isNotNull(), F.slice(words, 2, 100)).otherwise(words)
    suffix = F.when(~turned & (F.size(words) > 1), known(F.element_at(words, -1), SUFFIXES))
    words = F.when(suffix.isNotNull(), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    # Particles that stand right before the last word, but never the first word.
    run = F.aggregate(F.reverse(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & F.lower(x).isin(PARTICLES), 1).otherwise(0)).alias("n"), (acc["on"] & F.lower(x).isin(PARTICLES)).alias("on")))
    cut = F.size(words) - 1 - run["n"]
    surname = F.when(turned, F.trim(F.get(sides, F.lit(0)))).otherwise(F.array_join(F.slice(words, cut + 1, F.size(words)), " "))
    fore = F.when(turned, F.array_join(words, " ")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(cut, F.lit(0))), " "))
    none = F.lit("")
    return F.struct(F.coalesce(title, none).alias("title"), title_case(fore).alias("forenames"), F.upper(tidy(surname)).alias("surname"), F.coalesce(suffix, none).alias("suffix"))


def person_label(c: Column) -> Column:
    """Forenames, SURNAME and suffix."""
    p = person_parts(c)
    return tidy(F.concat_ws(" ", p["forenames"], p["surname"], p["suffix"]))
