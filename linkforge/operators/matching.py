"""Likely duplicates among people by their names, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions import contact, names
from linkforge.session import settled

#: Letters from rare to common; any fixed order is right, this one keeps groups small.
ORDER = "qxzjvkwyfbghmpucldrsotinae"
#: A Jaro-Winkler of CLOSE_SURNAME needs a Jaro of 0.9, and that needs this share of either surname's letters in common.
SHARED = 0.7


def letter_keys(c: Column) -> Column:
    """Of a surname's letters, numbered where they repeat and rare ones first, those of which close surnames share one.

    Close surnames have SHARED of their letters in common, so two such lists always meet.
    """
    each = F.filter(F.split(c, ""), lambda x: x != "")
    nth = F.transform(each, lambda x, i: F.struct(F.instr(F.lit(ORDER), x).alias("rank"), (-F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda y: y == x))).alias("nth")))
    take = F.size(each) - F.ceil(F.size(each) * F.lit(SHARED) - F.lit(1e-9)).cast("int") + 1
    return F.slice(F.array_sort(nth), F.lit(1), take)


def close_surnames(surnames: DataFrame, column: str = "surname") -> DataFrame:
    """(a, b), a < b: all pairs of distinct surnames that are close, found through shared rare letters."""
    own = surnames.select(F.col(column).alias("s")).where(F.length("s") > 0).distinct()
    keyed = settled(own.select("s", F.length("s").alias("n"), F.explode(letter_keys(F.col("s"))).alias("key")), "surnames")
    a, b = (keyed.select(F.col("s").alias(x), F.col("n").alias(f"n_{x}"), "key") for x in "ab")
    lengths = F.least("n_a", "n_b") >= F.ceil(F.greatest("n_a", "n_b") * F.lit(SHARED) - F.lit(1e-9))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & lengths).select("a", "b").distinct()
    return pairs.where(names.name_similarity("a", "b") >= names.CLOSE_SURNAME)


def duplicate_people(people: DataFrame, name: str = "name", least: float = 0.85) -> DataFrame:
    """(a, b, score), a < b: pairs of different canonical names that score least or more.

    Equal canonical names are one class; who has which is canonical_name's to say. Names of one word
    never reach the default bound. A pair needs equal or close surnames to score 0.85, so only those are
    compared, and of equal surnames only names with forenames.
    """
    if least < 0.68:
        raise ValueError("names with surnames apart score up to 0.68: they would be missed")
    own = people.select(contact.canonical_name(F.col(name)).alias("c")).where("c like '% %'").distinct()
    own = settled(own.select("c", F.substring_index("c", " ", -1).alias("surname")), "people")
    near = close_surnames(own).select("a", "b")
    alike = own.select(F.col("surname").alias("a"), F.col("surname").alias("b")).distinct().unionByName(near).unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left, right = own.select(F.col("surname").alias("a"), F.col("c").alias("x")), own.select(F.col("surname").alias("b"), F.col("c").alias("y"))
    pairs = left.join(alike, "a").join(right, "b").where("x < y")
    scored = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), F.round(names.person_similarity("x", "y"), 6).alias("score"))
    return scored.where(F.col("score") >= least)
