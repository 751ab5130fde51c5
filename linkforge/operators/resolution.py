"""Entity resolution by signatures: explode, overlap, watchlist, and masters as connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkforge.operators.components import connected_components


def _norm(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def _tight(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def signatures(entities: DataFrame) -> DataFrame:
    """(id, type, rule, sig) of each entity; entities: id, type, label, attrs (a map).

    People match on strong keys only, organisations also on the name; things fall back to their
    label where nothing better is known.
    """
    a = lambda k: F.nullif(F.trim(F.col("attrs")[k]), F.lit(""))
    name, dob = F.nullif(_norm(F.col("label")), F.lit("")), _norm(a("dob"))
    join = lambda x, y: F.concat(x, F.lit("|"), y)  # noqa: E731  null if either is
    rules = {
        "person": [("name+dob", join(name, dob)), ("cro+dob", join(_tight(a("cro")), dob)), ("pnc", _tight(a("pnc"))), ("nino", _tight(a("nino")))],
        "organisation": [("companyNumber", _tight(a("companyNumber"))), ("name", name)],
        "vehicle": [("vrm", _tight(a("vrm")))],
        "account": [("accountNumber", _tight(a("accountNumber")))],
        "communication": [("number", _tight(a("number")))],
        "cyber": [("identifier", _norm(F.coalesce(a("handle"), a("address"))))],
        "location": [("premise+postcode", join(_norm(a("premiseNumber")), _tight(a("postcode")))), ("postcode", F.when(a("premiseNumber").isNull(), _tight(a("postcode"))))],
    }
    pair = lambda rule, sig: F.struct(F.lit(rule).alias("rule"), sig.alias("sig"))
    found = F.array().cast("array<struct<rule:string,sig:string>>")
    for kind, each in reversed(rules.items()):
        found = F.when(F.col("type") == kind, F.array(*[pair(r, s) for r, s in each])).otherwise(found)
    found = F.filter(found, lambda x: x["sig"].isNotNull())
    weak = F.when((F.size(found) == 0) & name.isNotNull() & ~F.col("type").isin("person", "organisation"), F.array(pair("type+label", name))).otherwise(found)
    return entities.select("id", "type", F.inline(weak))


def masters(entities: DataFrame) -> DataFrame:
    """(id, type, master_id): the closure of shared signatures within a type, named after the least member.

    Entities link to the least one of each signature, so a signature of many costs one edge each.
    """
    sigs = signatures(entities)
    least = sigs.groupBy("type", "rule", "sig").agg(F.min("id").alias("least"))
    edges = sigs.join(least, ["type", "rule", "sig"]).where("id <> least").select(F.col("id").alias("src"), F.col("least").alias("dst"))
    found = connected_components(edges)
    return entities.join(found, entities["id"] == found["node"], "left").select("id", "type", F.concat(F.lit("MTR-"), "type", F.lit("-"), F.coalesce("component", "id")).alias("master_id"))


def overlaps(sigs: DataFrame, urns: DataFrame, urn: str) -> DataFrame:
    """(urn, shared) of other reports by distinct signatures shared with one; urns: id, urn."""
    rows = sigs.join(urns, "id").select("urn", "type", "rule", "sig").distinct()
    own = rows.where(F.col("urn") == urn).select("type", "rule", "sig")
    return rows.where(F.col("urn") != urn).join(own, ["type", "rule", "sig"], "left_semi").groupBy("urn").agg(F.count("*").alias("shared"))


def watch_hits(watch: DataFrame, sigs: DataFrame) -> DataFrame:
    """(watch_id, hits): entities of each watch's type with any of its signatures; watches without a hit stay."""
    hit = watch.join(sigs.select("id", "type", "rule", "sig"), ["type", "rule", "sig"]).groupBy("watch_id").agg(F.countDistinct("id").alias("hits"))
    return watch.select("watch_id").distinct().join(hit, "watch_id", "left").select("watch_id", F.coalesce("hits", F.lit(0)).alias("hits"))
