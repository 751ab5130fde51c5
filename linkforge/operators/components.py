"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.session import release, settled


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge names; component is the least node of its component.

    Each round replaces the edges by stars around local minima; a hub costs one aggregated row
    and a join that adaptive execution may split. Rounds grow with the logarithm of the
    diameter. Every round is written to the shared folder, and the
    round before it deleted. Null ends and loops are left out;
    a table without edges gives no rows.
    """
    kind = edges.schema[src].dataType
    both = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    e = settled(both.select(F.greatest(src, dst).cast(kind).alias("a"), F.least(src, dst).cast(kind).alias("b")).distinct(), "edges")
    seen = _mark(e)
    while seen[0]:
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        before, e = e, settled(
            small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low2.select("a", F.col("m").alias("b"))).distinct(),
            "edges",
        )
        release(before)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
