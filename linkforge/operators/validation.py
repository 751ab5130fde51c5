"""Checks of reports and of their entities and links, and what of them may be shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the graded fields of a report may say.
CONFIDENCE = ["High", "Medium", "Low"]
MARKINGS = ["OFFICIAL", "OFFICIAL-SENSITIVE"]
ACTIONS, SANITISATIONS = ["A1", "A2", "A3"], ["S1", "S2"]


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _not_in(c: Column, known: list[str]) -> Column:
    return ~F.coalesce(c.isin(known), F.lit(False))


def report_errors(statuses: list[str], threats: list[str]) -> Column:
    """The fields of a report that are missing or wrong, in the order of the form.

    Columns: title, date_of_collection, submitted_by_self, threat_area, confidence, protective_marking, code,
    instructions, action_code, sanitisation_code, items (array of structs text, source_eval,
    intel_eval), provenance (a struct of the same fields) and status.
    """
    c = F.col
    code = F.upper(F.coalesce(c("code"), F.lit("")))
    given = lambda x: ~F.coalesce(F.col(x) == "", F.lit(True))
    bad_source = lambda x: _not_in(x.cast("string"), ["1", "2", "3"])
    bad_intel = lambda x: _not_in(x, list("ABCDE"))
    checks = [
        (_blank(c("title")), "title"),
        (_blank(c("date_of_collection")) | ~F.coalesce(c("date_of_collection").rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.lit(False)), "dateOfCollection"),
        (c("submitted_by_self").isNull(), "submittedBySelf"),
        (_blank(c("threat_area")) | _not_in(c("threat_area"), threats), "threatArea"),
        (_not_in(c("confidence"), CONFIDENCE), "confidence"),
        (_not_in(c("protective_marking"), MARKINGS), "protectiveMarking"),
        (~code.isin("P", "C"), "handling.code"),
        ((code == "C") & _blank(c("instructions")), "handling.instructions"),
        (F.when(code == "C", _not_in(c("action_code"), ACTIONS)).otherwise((code == "P") & given("action_code")), "handling.actionCode"),
        (F.when(code == "C", _not_in(c("sanitisation_code"), SANITISATIONS)).otherwise((code == "P") & given("sanitisation_code")), "handling.sanitisationCode"),
    ]
    own = F.filter(F.array(*[F.when(bad, field) for bad, field in checks]), lambda x: x.isNotNull())
    items = F.coalesce(c("items"), F.expr("cast(array() as array<struct<text:string,source_eval:string,intel_eval:string>>)"))

    def item_fields(x: Column, i: Column) -> Column:
        tag = F.concat(F.lit("items["), i.cast("string"), F.lit("]."))
        return F.filter(F.array(*[F.when(bad, F.concat(tag, F.lit(name))) for bad, name in ((_blank(x["text"]), "text"), (bad_source(x["source_eval"]), "sourceEval"), (bad_intel(x["intel_eval"]), "intelEval"))]), lambda y: y.isNotNull())

    of_items = F.when(F.size(items) == 0, F.array(F.lit("items"))).otherwise(F.flatten(F.transform(items, item_fields)))
    p = c("provenance")
    last = F.filter(F.array(*[F.when(bad, name) for bad, name in ((_blank(p["text"]), "provenance.text"), (bad_source(p["source_eval"]), "provenance.sourceEval"), (bad_intel(p["intel_eval"]), "provenance.intelEval"), (_not_in(c("status"), statuses), "status"))]), lambda x: x.isNotNull())
    return F.concat(own, of_items, last)


def effective_share(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, id, share, blocked): an entity is shared if marked Yes and no alias, a link if marked Yes and both its ends are shared.

    entities: id, share (Yes, No, Unknown), is_alias; links: id, src, dst, share. blocked: a link marked Yes whose end holds it back.
    """
    own = entities.select("id", (F.coalesce(F.col("share") == "Yes", F.lit(False)) & ~F.coalesce("is_alias", F.lit(False))).alias("ok"))
    first, second = (own.select(F.col("id").alias(k), F.col("ok").alias(f"ok_{k}")) for k in ("src", "dst"))
    wants = F.coalesce(F.col("share") == "Yes", F.lit(False))
    ends = F.coalesce("ok_src", F.lit(False)) & F.coalesce("ok_dst", F.lit(False))
    of_links = links.join(first, "src", "left").join(second, "dst", "left").select(F.lit("link").alias("kind"), "id", (wants & ends).alias("share"), (wants & ~ends).alias("blocked"))
    return own.select(F.lit("entity").alias("kind"), "id", F.col("ok").alias("share"), F.lit(False).alias("blocked")).unionByName(of_links)


def structure_errors(entities: DataFrame, links: DataFrame, identity: list[str]) -> DataFrame:
    """(id, error): links to entities that aren't there, identity links between aliases, and aliases with more than one identity link."""
    ends = entities.select("id", F.coalesce("is_alias", F.lit(False)).alias("alias"))
    first, second = (ends.select(F.col("id").alias(k), F.col("alias").alias(f"alias_{k}")) for k in ("src", "dst"))
    known = links.join(first, "src", "left").join(second, "dst", "left")
    same = F.col("type").isin(identity)
    found = F.array(
        F.when(F.col("alias_src").isNull(), "from unknown"),
        F.when(F.col("alias_dst").isNull(), "to unknown"),
        F.when(same & F.col("alias_src") & F.col("alias_dst"), "alias to alias"),
    )
    of_links = known.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error"))
    both = links.where(same).select(F.explode(F.array("src", "dst")).alias("id"))
    many = both.groupBy("id").count().where("count > 1").join(ends.where("alias"), "id", "left_semi")
    return of_links.unionByName(many.select("id", F.lit("more than one identity").alias("error")))
