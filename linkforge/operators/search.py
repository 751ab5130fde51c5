"""Faceted report search: filters, text, dates, counts that leave out a facet's own selection, sort and pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Criteria:
    """A search. filters: {facet: values}, any of which passes; text: words that must all occur; dates as yyyy-mm-dd."""

    filters: dict[str, list[str]] = field(default_factory=dict)
    text: str = ""
    date_from: str = ""
    date_to: str = ""
    sort: tuple[str, int] = ("date_key", -1)
    page: int = 1
    page_size: int = 50


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def passes_text(haystack: Column, text: str) -> Column:
    return _all([F.coalesce(F.lower(haystack).contains(t), F.lit(False)) for t in text.lower().split()])


def passes_date(key: Column, date_from: str, date_to: str) -> Column:
    """Bounds are inclusive; a blank date fails a lower bound but passes an upper one alone."""
    k = F.coalesce(key, F.lit(""))
    tests = [k >= date_from.replace("-", "")] if date_from else []
    return _all([*tests, *([k <= date_to.replace("-", "")] if date_to else [])])


def values_of(df: DataFrame, facet: str) -> Column:
    """A facet's values as an array: one, or those of a multi-valued facet."""
    return F.col(facet) if df.schema[facet].dataType.typeName() == "array" else F.array(F.col(facet))


def passes_filter(df: DataFrame, facet: str, chosen: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values_of(df, facet), F.array(*map(F.lit, chosen))), F.lit(False))


def active(df: DataFrame, facets: list[str], c: Criteria) -> dict[str, Column]:
    """Filters on known facets with a selection; others are ignored."""
    return {k: passes_filter(df, k, v) for k, v in c.filters.items() if k in facets and v}


def matched(df: DataFrame, facets: list[str], c: Criteria, haystack: str = "haystack", date_key: str = "date_key") -> DataFrame:
    return df.where(_all([*active(df, facets, c).values(), passes_date(F.col(date_key), c.date_from, c.date_to), passes_text(F.col(haystack), c.text)]))


def _named(facet: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))


def facet_counts(df: DataFrame, facets: list[str], c: Criteria, haystack: str = "haystack", date_key: str = "date_key") -> DataFrame:
    """(facet, value, cnt, selected): each facet counted over rows that pass all other filters, in one scan.

    The predicates are computed once a row; a row then yields its distinct values of every facet
    whose other filters it passes, and one aggregation with map-side sums counts them.
    """
    tests = active(df, facets, c)
    base = df.where(passes_date(F.col(date_key), c.date_from, c.date_to) & passes_text(F.col(haystack), c.text))
    flags = base.select(*[values_of(df, f).alias(f) for f in facets], *[t.alias(f"_p_{k}") for k, t in tests.items()])
    parts = []
    for f in facets:
        ok = _all([F.col(f"_p_{k}") for k in tests if k != f])
        parts.append(F.when(ok, F.transform(F.array_distinct(F.col(f)), _named(f))).otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
    rows = flags.select(F.inline(F.flatten(F.array(*parts)))).where("value is not null and value <> ''")
    chosen = F.lit(False)
    for k, v in c.filters.items():
        chosen = chosen | ((F.col("facet") == k) & F.col("value").isin(v)) if v else chosen
    return rows.groupBy("facet", "value").agg(F.count("*").alias("cnt")).withColumn("selected", chosen)


def page(df: DataFrame, c: Criteria, key: str) -> DataFrame:
    """The rows of the page asked for, clamped to the pages there are; ties go by key."""
    size = c.page_size or 50
    total = df.count()
    last = max(1, -(-total // size))
    start = (min(max(c.page, 1), last) - 1) * size
    name, way = c.sort
    order = F.col(name).desc_nulls_last() if way < 0 else F.col(name).asc_nulls_first()
    return df.orderBy(order, key).offset(start).limit(size)
