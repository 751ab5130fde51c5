"""What is known of each master entity over all reports, and what removing an entity from a report means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The types of neighbours that a dossier lists, with the heading of each, and the attributes of identity.
HEADINGS = {"person": "associate", "location": "location", "communication": "comms", "vehicle": "vehicle", "account": "account", "cyber": "cyber"}
IDENTIFIERS = ["pnc", "cro", "nino", "passport"]


def dossier_facts(entities: DataFrame, links: DataFrame, masters: DataFrame) -> DataFrame:
    """(master_id, heading, value, urn): all that is known of each master person, a row for each distinct value.

    entities: id, urn, type, label, role, is_alias, attrs (a map of texts); links: urn, src, dst;
    masters: id, master_id. Headings: name, alias, role, one of each identifier, and those of
    neighbours, by links of the same report. urn is the least report of the value. Facts stay rows, so a master of
    many reports is never one list. Null and empty values are no facts.
    """
    people = entities.where("type = 'person'").join(masters, "id")
    c = F.col
    own = [("name", c("label")), ("role", c("role")), ("alias", F.when(c("is_alias"), c("label"))), *[(k, c("attrs")[k]) for k in IDENTIFIERS]]
    own = [F.struct(F.lit(heading).alias("heading"), value.alias("value")) for heading, value in own]
    facts = people.select("master_id", "urn", F.inline(F.array(*own)))
    ends = links.where("src <> dst").select("urn", F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))))
    other = entities.where(F.col("type").isin(*HEADINGS)).select(F.col("id").alias("other"), "urn", F.col("type").alias("heading"), F.col("label").alias("value"))
    heading = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])[F.col("heading")]
    near = ends.join(people.select("id", "urn", "master_id"), ["id", "urn"]).join(other, ["other", "urn"]).select("master_id", "urn", heading.alias("heading"), "value")
    return facts.unionByName(near).where("value <> ''").groupBy("master_id", "heading", "value").agg(F.min("urn").alias("urn"))


def dossier_heads(entities: DataFrame, masters: DataFrame) -> DataFrame:
    """(master_id, primary_name, dob, reports, appearances) of each master person.

    The name is that of the first entity by urn and id, the date of birth the first one given.
    """
    people = entities.where("type = 'person'").join(masters, "id")
    first = F.struct("urn", "id")
    dob = F.when(F.col("attrs")["dob"] != "", F.col("attrs")["dob"])
    return people.groupBy("master_id").agg(
        F.min_by("label", first).alias("primary_name"), F.min_by(dob, F.when(dob.isNotNull(), first)).alias("dob"),
        F.countDistinct("urn").alias("reports"), F.count("*").alias("appearances"),
    )


def deletion_impacts(entities: DataFrame, links: DataFrame, masters: DataFrame) -> DataFrame:
    """(id, urn, action, elsewhere, links) for every entity: what its removal from its report does.

    detach where another report has an entity of the same master, else delete; elsewhere counts those reports, links
    those of its report that go with it. entities: id, urn; links: id, urn, src, dst; masters: id, master_id.
    An entity without a master stands alone.
    """
    known = entities.select("id", "urn").join(masters.select("id", "master_id"), "id", "left")
    spread = known.where("master_id is not null").groupBy("master_id").agg(F.countDistinct("urn").alias("_n"))
    ends = links.select("urn", F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("urn", "id").agg(F.count("*").alias("links"))
    out = known.join(spread, "master_id", "left").join(ends, ["urn", "id"], "left")
    # The entity's own report counts among its master's, where it has one.
    elsewhere = F.greatest(F.coalesce(F.col("_n"), F.lit(0)) - F.when(F.col("urn").isNotNull(), 1).otherwise(0), F.lit(0))
    return out.select("id", "urn", F.when(elsewhere > 0, "detach").otherwise("delete").alias("action"), elsewhere.cast("long").alias("elsewhere"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
