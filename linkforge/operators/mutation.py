"""Tables of records changed as whole tables: upsert, merges of entities, links moved to masters, field differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key; rows of a null key in either stay."""
    return old.join(new.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def remap_links(links: DataFrame, masters: DataFrame) -> DataFrame:
    """Distinct (src, dst, type) with each end's master in its place; links with an unknown end and loops go. masters: id, master_id."""
    ends = [masters.select(F.col("id").alias(e), F.col("master_id").alias(f"m_{e}")) for e in ("src", "dst")]
    moved = links.join(ends[0], "src").join(ends[1], "dst").select(F.col("m_src").alias("src"), F.col("m_dst").alias("dst"), "type")
    return moved.where("src <> dst").distinct()


def merge_attributes(attrs: DataFrame, masters: DataFrame) -> DataFrame:
    """(master_id, key, value): of each key the value of the first member that has one. attrs: id, key, value."""
    known = attrs.where("value is not null and value <> ''").join(masters, "id")
    return known.groupBy("master_id", "key").agg(F.min_by("value", F.struct("id", "value")).alias("value"))


def merge_entities(entities: DataFrame, links: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and distinct links after each drop of pairs (keep, drop) has become its keep. A drop has one keep that isn't itself dropped."""
    gone = pairs.select(F.col("drop").alias("id"))
    to = entities.select("id").join(pairs.select(F.col("drop").alias("id"), "keep"), "id", "left").select("id", F.coalesce("keep", "id").alias("master_id"))
    return entities.join(gone, "id", "left_anti"), remap_links(links, to)


def field_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) for every field, as text, that differs; a record on one side only differs in all it holds."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])
        return df.select(key, F.inline(each)).where(F.col(name).isNotNull())

    return tall(a, "before").join(tall(b, "after"), [key, "field"], "full").where(~F.col("before").eqNullSafe(F.col("after")))
