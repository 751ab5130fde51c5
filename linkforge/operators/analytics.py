"""Counts by type, months with gaps filled, peaks, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilometres, the mean radius of the Earth.
RADIUS = 6371.0088
# The points of the compass from north on.
COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def month_activity(dated: DataFrame, day: str) -> DataFrame:
    """(month, cnt) from the first to the last month, zero where nothing happened."""
    counts = dated.where(F.col(day).isNotNull()).groupBy(F.trunc(F.col(day), "month").alias("month")).agg(F.count("*").alias("cnt"))
    span = counts.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo is not null")
    spine = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def peak(series: DataFrame) -> DataFrame:
    """The first month of the largest count."""
    return series.orderBy(F.desc("cnt"), "month").limit(1)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * RADIUS * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The first direction from one place to the other, in degrees from north."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(degrees / 22.5 + 0.5) % 16 + 1).cast("int"))


def within(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows within km, with the distance: a box of degrees first, which reaches the scan, then the sphere.

    The box is as wide as the circle's farthest meridians; around a pole it holds all longitudes, and across the date line it has two parts.
    """
    import math

    d = math.degrees(km / RADIUS)
    box = F.col("lat").between(lat - d, lat + d)
    if abs(lat) + d < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat))))) + 1e-9
        west, east = lon - wide, lon + wide
        sides = F.col("lon").between(west, east)
        if west < -180:
            sides = sides | (F.col("lon") >= west + 360)
        if east > 180:
            sides = sides | (F.col("lon") <= east - 360)
        box = box & sides
    far = haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return df.where(box).withColumn("km", far).where(F.col("km") <= km)


def worst_item(items: DataFrame, key: str, source: str, intel: str, order: str) -> DataFrame:
    """(key, source, intel) of each report's worst graded item: ten times the source's grade plus the letter's rank, the first of equals."""
    rank = F.col(source) * 10 + F.instr(F.lit("ABCDE"), F.col(intel))
    graded = items.where(F.col(source).isNotNull() & F.col(intel).isNotNull())
    worst = graded.groupBy(key).agg(F.max_by(F.struct(source, intel), F.struct(rank, -F.col(order))).alias("w"))
    return worst.select(key, f"w.{source}", f"w.{intel}")


def coverage(done: DataFrame, subject: str, system: str, systems: list[str]) -> DataFrame:
    """One row a subject with a 0 or 1 for each of the systems named."""
    flags = [F.max((F.col(system) == s).cast("int")).alias(s) for s in systems]
    return done.groupBy(subject).agg(*flags).na.fill(0, systems)
