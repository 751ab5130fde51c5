"""Grades of reports, strengths and kinds of links, as column expressions over fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three parts of a grade, and the grade that a confidence stands for.
SOURCES = {"1": "Reliable", "2": "Untested", "3": "Not reliable"}
ASSESSMENTS = {
    "A": "Known to be true without reservation",
    "B": "Known personally to source but not to officer",
    "C": "Not known personally to source but corroborated",
    "D": "Cannot be judged",
    "E": "Suspected to be false",
}
HANDLING = {"P": "Lawful sharing permitted", "C": "Lawful sharing permitted subject to conditions"}
OF_CONFIDENCE = {"high": "[1AP]", "med": "[2BP]", "low": "[3DP]"}
# The line that a confidence is drawn with.
STRENGTH = {"high": "Confirmed", "med": "Unconfirmed", "low": "Tentative"}
# Kinds of link with their label, chart type, meaning and whether they have a direction.
LINKS = {
    "USES": ("Uses", "Uses", "Uses", True),
    "ASSOCIATE_OF": ("Associate of", "Associate", "Association", False),
    "COMMUNICATED_WITH": ("Communicated with", "Communication", "Communication", False),
    "TRANSACTED_WITH": ("Transacted with", "Transaction", "Transaction", True),
    "TRAVELS_TO": ("Travels to", "Travel", "Travel", True),
    "DEPARTS_FROM": ("Departs from", "Travel", "Travel", True),
    "STAYS_AT": ("Stays at", "Resides At", "Residence", True),
    "LOCATED_IN": ("Located in", "Located At", "Location", True),
    "PHONE_OF": ("Phone of", "Uses", "Uses", True),
    "OWNS": ("Owns", "Owns", "Ownership", True),
    "HOLDS": ("Account holder", "Owns", "Ownership", True),
    "REPRESENTS": ("Acts for", "Associate", "Association", True),
    "POSSESSES": ("In possession of", "Owns", "Ownership", True),
    "EMPLOYS": ("Employs", "Employs", "Employment", True),
    "FAMILY_OF": ("Family of", "Family", "Family", False),
    "CO_LOCATED_WITH": ("Co-located with", "Co-location", "Association", False),
    "JOURNEY_WITH": ("Journey with", "Travelled With", "Association", False),
    "LINKED_TO": ("Linked to", "Link", "Association", False),
}


def _lookup(values: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]


def _letter(c: Column, known: dict[str, str], default: str) -> Column:
    first = F.substring(F.upper(c), 1, 1)
    return F.when(first.isin(*known), first).otherwise(default)


def grade_code(source: Column, assessment: Column, handling: Column) -> Column:
    """[2BP] and the like; what is unknown counts as 2, B and P."""
    return F.concat(F.lit("["), _letter(source, SOURCES, "2"), _letter(assessment, ASSESSMENTS, "B"), _letter(handling, HANDLING, "P"), F.lit("]"))


def grade_valid(code: Column) -> Column:
    return F.coalesce(F.upper(code).rlike(r"^\[[1-3][A-E][PC]\]$"), F.lit(False))


def grade_sentence(code: Column) -> Column:
    """The grade in words, with or without its brackets; empty for what is none."""
    up = F.upper(code)
    part = [F.substring(F.regexp_replace(up, r"^\[", ""), i, 1) for i in (1, 2, 3)]
    text = F.concat(_lookup(SOURCES, part[0]), F.lit("; "), _lookup(ASSESSMENTS, part[1]), F.lit("; "), _lookup(HANDLING, part[2]), F.lit("."))
    return F.coalesce(F.when(up.rlike(r"^\[?[1-3][A-E][PC]\]?$"), text), F.lit(""))


def grade_of_confidence(confidence: Column) -> Column:
    return F.coalesce(_lookup(OF_CONFIDENCE, F.lower(confidence)), F.lit(OF_CONFIDENCE["med"]))


def line_strength(confidence: Column) -> Column:
    return F.coalesce(_lookup(STRENGTH, F.lower(confidence)), F.lit(STRENGTH["med"]))


def link_meta(kind: Column) -> Column:
    """A struct label, chart, meaning, directed; unknown kinds keep their name as label."""
    text = lambda i, default: F.coalesce(_lookup({k: v[i] for k, v in LINKS.items()}, kind), default)
    directed = F.coalesce(kind.isin([k for k, v in LINKS.items() if v[3]]), F.lit(False))
    label = F.coalesce(F.when(kind != "", kind), F.lit("Linked to"))
    return F.struct(text(0, label).alias("label"), text(1, F.lit("Link")).alias("chart"), text(2, F.lit("Association")).alias("meaning"), directed.alias("directed"))
