"""Joins by position: the nearest one before, spans inside others, spans free of others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_before(rows: DataFrame, group: str, order: list[str], is_anchor: Column, value: str) -> DataFrame:
    """rows with column nearest: value of the last anchor row before each in its group. One sort by group, no join."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("nearest", F.last(F.when(is_anchor, F.col(value)), ignorenulls=True).over(before))


def contained(inner: DataFrame, outer: DataFrame, group: str) -> DataFrame:
    """(group, s, e, outer_s, outer_e) of inner spans that lie in outer ones of the same group; both have s and e."""
    o = outer.select(group, F.col("s").alias("outer_s"), F.col("e").alias("outer_e"))
    return inner.select(group, "s", "e").join(o, group).where("outer_s <= s and e <= outer_e")


def free_of(spans: DataFrame, claimed: DataFrame, group: str) -> DataFrame:
    """Spans that overlap no claimed span of their group."""
    c = claimed.select(F.col(group).alias("_g"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    return spans.join(c, (F.col(group) == F.col("_g")) & (F.col("s") < F.col("_e")) & (F.col("_s") < F.col("e")), "left_anti")
