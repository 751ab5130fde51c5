"""What the columns of an imported sheet hold, by a vote of their first cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.functions import contact

#: Cells that vote in each column (the first that aren't blank), and the shares of votes that make a kind sure and likely.
CELLS, SURE, LIKELY = 50, 0.8, 0.5
# The kinds in the order in which a cell is tried for them, which also settles ties.
KINDS = ["email", "ip", "vehicle", "money", "date", "phone", "location", "person"]
TIES = ["phone", "email", "date", "person", "location", "vehicle", "ip", "money"]


def cell_kind(c: Column, places: list[str] | None = None) -> Column:
    """The kind of a cell; null for what is none. places: lower-case names known as locations."""
    s = F.trim(c)
    number = contact.phone_e164(s)["e164"].isNotNull() & (F.length(contact.digits(s)) >= 9) & ~s.rlike("[^+0-9(). \\t-]")
    two = F.split(s, r",?\s+")
    capital = lambda x: x.rlike(r"^[A-Z][a-z]+$")
    name = (F.size(two) == 2) & F.coalesce(
        (capital(F.get(two, F.lit(0))) & F.get(two, F.lit(1)).rlike("^[A-Z][A-Za-z'’-]+$") & ~s.contains(",")) | (F.get(two, F.lit(0)).rlike("^[A-Z][A-Z'’-]+$") & capital(F.get(two, F.lit(1)))), F.lit(False)
    )
    tests = {
        "email": s.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
        "ip": s.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"),
        "vehicle": s.rlike("^[A-Z]{2}[0-9]{2} ?[A-Z]{3}$"),
        "money": s.rlike(r"^[£€$] ?[0-9][0-9,]*(\.[0-9]{1,2})?$"),
        "date": s.rlike("^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        "phone": number,
        "location": F.lower(s).isin(places) if places else F.lit(False),
        "person": name,
    }
    return F.coalesce(*[F.when(tests[k], k) for k in KINDS])


def column_kinds(sheet: DataFrame, order: str, columns: list[str], places: list[str] | None = None) -> DataFrame:
    """(name, kind, confidence) of each column: the kind that most of its first CELLS filled cells have, or text. order: the rows' order.

    Blank cells don't vote. A column without any is text of low confidence.
    """
    rows = []
    for c in columns:  # the first cells of each column alone leave their tasks
        filled = sheet.where(F.trim(F.col(c)) != "").select(F.lit(c).alias("name"), F.col(order).alias("at"), F.col(c).cast("string").alias("cell"))
        rows.append(filled.orderBy("at", "cell").limit(CELLS))
    cells = rows[0]
    for r in rows[1:]:
        cells = cells.unionByName(r)
    votes = cells.select("name", cell_kind(F.col("cell"), places).alias("kind")).groupBy("name", "kind").agg(F.count("*").alias("n"))
    own = Window.partitionBy("name")
    rank = F.array_position(F.array(*map(F.lit, TIES)), F.col("kind"))
    best = votes.withColumn("all", F.sum("n").over(own)).where("kind is not null").groupBy("name", "all").agg(F.max_by(F.struct("kind", "n"), F.struct("n", -rank)).alias("b"))
    share = F.col("b.n") / F.col("all")
    named = sheet.sparkSession.createDataFrame([(c,) for c in columns], "name string").join(best, "name", "left")
    kind = F.when(share >= LIKELY, F.col("b.kind")).otherwise("text")
    return named.select("name", kind.alias("kind"), F.when(share >= SURE, "high").when(share >= LIKELY, "med").otherwise("low").alias("confidence"))
