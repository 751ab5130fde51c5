"""Tables and files that other tools read: logs of subjects and enquiries, chart imports, report drafts, hand-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions.contact import csv_safe
from linkforge.functions.grades import grade_code, line_strength, link_meta
from linkforge.session import settled

# Names of directions of links.
DIRECTIONS = {"->": "End 1 to End 2", "<-": "End 2 to End 1", "both": "Both"}
#: Types that a log has no row for.
UNLOGGED = ["note", "date", "event"]


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with a gapless number from 1 in an order, without bringing all rows into one task.

    Rows are ranged and sorted, numbered within their range, and a range's number of rows (one row a
    range) moves those after it up. Ties of the order are numbered in any order. A hot key is one
    range, so an order should end in a key.
    """
    wide = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = settled(wide, "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = kept.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # One row a range, so this window holds as many rows as there are partitions.
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    out = kept.withColumn("_p", part).join(F.broadcast(before), "_p")
    return out.select(*df.columns, (F.col("_before") + place + 1).alias(name))


def first_links(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(id, type, sentence): the earliest link (least ord) of each entity that has one."""
    ends = links.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"), "type", "sentence", "ord")
    first = ends.groupBy("id").agg(F.min_by(F.struct("type", "sentence"), "ord").alias("l"))
    return entities.select("id").join(first, "id").select("id", "l.type", "l.sentence")


def subject_of(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(id, subject): the label of the first person linked to each entity, else a person's own, else empty."""
    ends = links.select(F.inline(F.array(*[F.struct(F.col(a).alias("id"), F.col(b).alias("other"), "ord") for a, b in (("src", "dst"), ("dst", "src"))])))
    people = entities.where("type = 'person'").select(F.col("id").alias("other"), F.col("label").alias("subject"))
    first = ends.join(people, "other").groupBy("id").agg(F.min_by("subject", F.struct("ord", "other")).alias("subject"))
    own = F.when(F.col("type") == "person", F.col("label"))
    return entities.join(first, "id", "left").select("id", F.coalesce("subject", own, F.lit("")).alias("subject"))


def enquiry_log(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(reference, subject, source, entity, result) a row for every entity but notes, dates and events, in order of id.

    entities: id, type, label, source_ref, source, assessment, handling; links: src, dst, type, sentence, ord.
    References are padded to three digits and never cut.
    """
    rows = entities.where(~F.coalesce(F.col("type").isin(UNLOGGED), F.lit(False)))
    told = rows.join(subject_of(entities, links), "id", "left").join(first_links(entities, links).select("id", "sentence"), "id", "left")
    n = F.col("n").cast("string")
    said = F.coalesce(F.when(F.col("sentence") != "", F.col("sentence")), F.lit("Charted"))
    return numbered(told, ["id"]).select(
        F.concat(F.lit("E"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)).alias("reference"), "subject",
        F.coalesce(F.when(F.col("source_ref") != "", F.col("source_ref")), F.lit("open source")).alias("source"), F.col("label").alias("entity"),
        F.concat(said, F.lit("  "), grade_code(F.col("source"), F.col("assessment"), F.col("handling"))).alias("result"),
    )


def chart_entities(entities: DataFrame) -> DataFrame:
    """(identity, label, type, description) of all but notes; the identity is a phone's number or a mail's address, else the label. entities: id, type, label, e164, email, source_text."""
    given = lambda x: F.when(F.col(x) != "", F.col(x))
    return entities.where("type is null or type <> 'note'").select(
        "id", F.coalesce(given("e164"), given("email"), F.col("label")).alias("identity"), "label", "type", F.substring(F.coalesce("source_text", F.lit("")), 1, 200).alias("description")
    )


def chart_links(entities: DataFrame, links: DataFrame) -> DataFrame:
    """(end1, end2, type, meaning, direction, strength, label) of links between two charted entities.

    links: src, dst, type, direction, confidence, negated, amount. What is denied is drawn as tentative.
    """
    known = chart_entities(entities)
    ends = [known.select(F.col("id").alias(e), F.col("identity").alias(f"_{e}")) for e in ("src", "dst")]
    meta, negated = link_meta(F.col("type")), F.coalesce("negated", F.lit(False))
    directions = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    amount = F.when(F.col("amount") != "", F.concat(F.lit(" "), F.col("amount"))).otherwise("")
    return links.join(ends[0], "src").join(ends[1], "dst").select(
        F.col("_src").alias("end1"), F.col("_dst").alias("end2"), meta["label"].alias("type"), meta["meaning"].alias("meaning"),
        F.coalesce(directions[F.col("direction")], F.lit("None")).alias("direction"),
        F.when(negated, "Tentative").otherwise(line_strength(F.col("confidence"))).alias("strength"),
        F.concat(meta["label"], amount, F.when(negated, " (denied)").otherwise("")).alias("label"),
    )


def draft_lines(links: DataFrame, grades: Column) -> DataFrame:
    """(n, line): sentences of links in order of negated and ord, numbered and graded; denied ones come last and count as 2EP. links: sentence, negated, ord."""
    negated = F.coalesce("negated", F.lit(False))
    rows = links.where("sentence <> ''").select("ord", negated.alias("denied"), "sentence", F.when(negated, "[2EP]").otherwise(grades).alias("grade"))
    text = F.trim("sentence")
    said = F.when(text.rlike("[.!?]$"), text).otherwise(F.concat(text, F.lit(".")))
    mark = F.when(F.col("denied"), "[DENIED/NEGATED — handle with care] ").otherwise("")
    return numbered(rows, ["denied", "ord"]).select("n", F.concat(F.col("n").cast("string"), F.lit(". "), mark, said, F.lit("  "), F.col("grade")).alias("line"))


def handoffs(reports: DataFrame) -> DataFrame:
    """(urn, document): each report's contract as JSON, its items graded, its provenance left out.

    reports: urn, title, operation, status, marking, handling and items (an array of structs seq,
    source_type, text, source_eval, intel_eval). A null handling counts as P, null items as none.
    """
    graded = F.transform(
        F.coalesce("items", F.array()),
        lambda x: F.struct(
            x["seq"].alias("seq"), x["source_type"].alias("sourceType"), x["text"].alias("text"), x["source_eval"].alias("sourceEval"), x["intel_eval"].alias("intelEval"),
            grade_code(x["source_eval"].cast("string"), x["intel_eval"], F.coalesce("handling", F.lit("P"))).alias("grade"),
        ),
    )
    report = F.struct("urn", F.coalesce("operation", F.lit("")).alias("operation"), "title", "status", F.col("marking").alias("protectiveMarking"), F.col("handling").alias("handlingCode"))
    return reports.select("urn", F.to_json(F.struct(F.lit("system.ir.v1").alias("schema"), report.alias("report"), graded.alias("items"))).alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV files with all fields quoted, texts guarded against being taken for formulas, nulls empty."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    df.select(*[csv_safe(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]).write.csv(path, header=True, quoteAll=True, escape='"')


def append_activity(entries: DataFrame, path: str) -> None:
    """Entries added to a log folder as new JSON files; those that are there stay."""
    entries.write.mode("append").json(path)
