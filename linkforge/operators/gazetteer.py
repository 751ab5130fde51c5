"""Places by name, airport code and postcode area, places of addresses, and curves between places.

A gazetteer is a table (name, kind, cc, lat, lon, aliases, iata, ord); ord settles which of several records comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.functions.contact import fold_accents, tidy


def folded(c: Column) -> Column:
    """A name as a key: lower case, no accents, single spaces."""
    return tidy(fold_accents(c))


def keys(gazetteer: DataFrame, aliases: bool = True) -> DataFrame:
    """(key, place, ord): each folded name, and alias if asked for, with the first record that has it."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.expr("cast(array() as array<string>)"))) if aliases else F.array("name")
    tall = gazetteer.select(F.explode(names).alias("key"), "ord", F.struct("name", "kind", "cc", "lat", "lon", "iata").alias("place")).withColumn("key", folded(F.col("key")))
    return tall.where("key <> ''").groupBy("key").agg(F.min_by("place", "ord").alias("place"), F.min("ord").alias("ord"))


def _airports(gazetteer: DataFrame, aliases: bool) -> DataFrame:
    """(key, airport): every beginning of airports' names, and aliases if asked for, with the first airport of each."""
    cut = keys(gazetteer.where("kind = 'airport'"), aliases).select(F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"), "key", "ord", "place")
    return cut.select(F.expr("left(key, n)").alias("key"), "ord", "place").groupBy("key").agg(F.min_by("place", "ord").alias("airport"))


def lookup(names: DataFrame, name: str, gazetteer: DataFrame) -> DataFrame:
    """names with a column place (null where there is none): by folded name; "X airport" falls back to X's airport, then to X.

    Equal joins only: an airport is found by prefixes of its names, which a gazetteer has few of.
    """
    key = folded(F.col(name))
    city = F.regexp_extract(key, r"^(.+?) airport$", 1)
    known = keys(gazetteer)
    out = names.withColumn("_k", key).withColumn("_c", F.when(city != "", city))
    out = out.join(known.select(F.col("key").alias("_k"), F.col("place").alias("_exact")), "_k", "left")
    out = out.join(known.select(F.col("key").alias("_c"), F.col("place").alias("_city")), "_c", "left")
    out = out.join(_airports(gazetteer, False).select(F.col("key").alias("_c"), F.col("airport").alias("_port")), "_c", "left")
    found = F.coalesce("_exact", F.when(F.col("_city").isNotNull(), F.coalesce("_port", "_city")))
    return out.select(*names.columns, found.alias("place"))


def airport_of_city(cities: DataFrame, name: str, gazetteer: DataFrame) -> DataFrame:
    """cities with a column airport: the one named after the city, or the first whose name or alias begins with its name."""
    direct = keys(gazetteer).where("place.kind = 'airport'").select(F.col("key").alias("_a"), F.col("place").alias("_direct"))
    out = cities.withColumn("_k", folded(F.col(name))).withColumn("_a", F.concat("_k", F.lit(" airport")))
    out = out.join(direct, "_a", "left").join(_airports(gazetteer, True).withColumnRenamed("key", "_k"), "_k", "left")
    return out.select(*cities.columns, F.coalesce("_direct", "airport").alias("airport"))


def by_iata(codes: DataFrame, code: str, gazetteer: DataFrame) -> DataFrame:
    """codes with a column place: the first record of a three-letter code in either case."""
    known = gazetteer.where("iata <> ''").groupBy(F.upper("iata").alias("_i")).agg(F.min_by(F.struct("name", "kind", "cc", "lat", "lon", "iata"), "ord").alias("place"))
    return codes.withColumn("_i", F.upper(F.col(code))).join(known, "_i", "left").select(*codes.columns, "place")


def postcode_area(postcodes: DataFrame, postcode: str, areas: DataFrame) -> DataFrame:
    """postcodes with columns area, lat and lon; areas: area, lat, lon.

    The area is the one or two letters before the first digit. Unknown areas of two letters take the place of their
    first letter; all three are null where that is unknown too, or no digit follows.
    """
    area = F.upper(F.regexp_extract(F.trim(F.col(postcode)), "(?i)^([A-Z]{1,2})[0-9]", 1))
    out = postcodes.withColumn("_a", F.when(area != "", area)).withColumn("_b", F.when(F.length("_a") == 2, F.substring("_a", 1, 1)))
    spot = lambda k, to: areas.select(F.col("area").alias(k), F.struct("lat", "lon").alias(to))
    out = out.join(spot("_a", "_x"), "_a", "left").join(spot("_b", "_y"), "_b", "left").withColumn("_x", F.coalesce("_x", "_y"))
    return out.select(*postcodes.columns, F.when(F.col("_x").isNotNull(), F.col("_a")).alias("area"), F.col("_x.lat").alias("lat"), F.col("_x.lon").alias("lon"))


def jitter(seed: Column, scale: float) -> Column:
    """A small offset, the same for the same text and within half of scale, that keeps places of one town apart."""
    code = lambda x: F.ascii(x).cast("long")
    step = lambda h, u: F.pmod(h * 31 + u, F.lit(1 << 32))
    # A character outside the basic plane counts as its two surrogates.
    high, low = (lambda u: 55296 + F.floor((u - 65536) / 1024)), (lambda u: 56320 + F.pmod(u - 65536, F.lit(1024)))
    add = lambda h, x: F.when(code(x) < 65536, step(h, code(x))).otherwise(step(step(h, high(code(x))), low(code(x))))
    h = F.aggregate(F.filter(F.split(seed, ""), lambda x: x != ""), F.lit(0).cast("long"), add)
    return ((h % 1000) / 1000 - 0.5) * scale


def address_places(addresses: DataFrame, label: str, locality: str, postcode: str, gazetteer: DataFrame, areas: DataFrame) -> DataFrame:
    """addresses with columns lat, lon and approx: near the locality, else near the postcode's area, else null."""
    out = postcode_area(lookup(addresses, locality, gazetteer), postcode, areas)
    spot = [F.coalesce(f"place.{x}", x) + jitter(seed, scale) for x, seed, scale in (("lat", F.col(label), 0.02), ("lon", F.concat(label, F.lit("|x")), 0.03))]
    approx = F.when(F.col("place").isNotNull(), "locality").when(F.col("area").isNotNull(), "postcode-area")
    return out.select(*addresses.columns, spot[0].alias("lat"), spot[1].alias("lon"), approx.alias("approx"))


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column, parts: int = 24) -> Column:
    """Points (lat, lon) of a curve between two places, bowed to one side; the two ends alone where they are the same."""
    dy, dx = lat2 - lat1, lon2 - lon1
    length = F.sqrt(dy * dy + dx * dx)
    bow = F.greatest(F.lit(0.05), F.least(length * 0.15, F.lit(8.0)))
    cy, cx = (lat1 + lat2) / 2 - dx / length * bow, (lon1 + lon2) / 2 + dy / length * bow

    def at(i: Column) -> Column:
        t = i / F.lit(parts)
        mix = lambda a, c, b: (1 - t) * (1 - t) * a + 2 * (1 - t) * t * c + t * t * b
        return F.struct(mix(lat1, cy, lat2).alias("lat"), mix(lon1, cx, lon2).alias("lon"))

    ends = F.array(F.struct(lat1.alias("lat"), lon1.alias("lon")), F.struct(lat2.alias("lat"), lon2.alias("lon")))
    return F.when(length < 1e-6, ends).otherwise(F.transform(F.sequence(F.lit(0), F.lit(parts)), at))
