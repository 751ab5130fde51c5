"""Queries of extraction from texts over the driver's tables: claims, names of a dictionary, relations told; with their SQL.

The SQL queries make one text a row of orders or customers, whose parts SQL knows; document_claims reads all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions import contact, dates, identifiers
from linkforge.operators import claims, clauses, dictionary
from linkforge.plans.register import query
from linkforge.session import spread, table

# --- claims --------------------------------------------------------------------------------------

#: Parts of a text about an order: kind, SQL of both engines for the part as written, for its value and for its note.
_DAY = {"spark": "date_format(o_orderdate, 'dd/MM/yyyy')", "duck": "strftime(o_orderdate, '%d/%m/%Y')"}
_LAST = {"spark": "date_format(date_sub(to_date(o_orderdate), 1), 'yyyy-MM-dd')", "duck": "strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d')"}


def _order_text(engine: str) -> str:
    return (
        f"'On ' || {_DAY[engine]} || ' u' || o_custkey || '+x@Example.com rang +4477009' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0') || ' about a red Ford AB' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')"
        " || ' XYZ for £' || CAST(o_orderkey % 9000 + 100 AS STRING) || ' yesterday, see SAR 07700900123 and 2024 GBP.'"
    )


_CLAIM_SQL = [
    ("date", _DAY["duck"], "strftime(o_orderdate, '%Y-%m-%d')", "CASE WHEN day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) THEN 'day or month' ELSE '' END"),
    ("email", "'u' || o_custkey || '+x@Example.com'", "'u' || o_custkey || '@example.com'", "''"),
    ("phone", "'+4477009' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0')", "'+4477009' || lpad(CAST(o_custkey % 100000 AS STRING), 5, '0')", "''"),
    ("vehicle", "'AB' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || ' XYZ'", "'AB' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || 'XYZ'", "'red Ford'"),
    ("money", "'£' || CAST(o_orderkey % 9000 + 100 AS STRING)", "'£' || CAST(o_orderkey % 9000 + 100 AS STRING)", "''"),
    ("relative", "'yesterday'", _LAST["duck"], "'relative'"),
]


@query(f"WITH t AS (SELECT *, {_order_text('duck')} AS text FROM orders) " + " UNION ALL ".join(
    f"SELECT o_orderkey, '{kind}' AS kind, CAST(strpos(text, {raw}) - 1 AS INT) AS s, CAST(strpos(text, {raw}) - 1 + length({raw}) AS INT) AS e, {raw} AS raw, {value} AS value, {note} AS note FROM t" for kind, raw, value, note in _CLAIM_SQL))
def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes claim in a text about each order; numbers behind SAR and a year beside a currency are left alone."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    texts = orders.selectExpr("o_orderkey", "to_date(o_orderdate) AS day", f"{_order_text('spark')} AS text")
    return claims.claims(texts, "text", F.col("day")).drop("day")


@query()
def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all documents; the ledger is checked against a plain one in the tests."""
    return claims.claims(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- names of a dictionary -----------------------------------------------------------------------

#: Texts about customers, with names in capitals and not, a shorter name within a longer one, a surname and a handle.
_PLACE_TEXT = "c_name || ' of ' || {n} || ' ships to ' || {r} || ', United Nations and united states; Asia MURPHY, @' || {n} || '.'"
_PLACE_NAMES = "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT 'United' UNION ALL SELECT 'UK'"


def _proper(c: str, engine: str) -> str:
    return f"initcap(lower({c}))" if engine == "spark" else f"list_aggregate(list_transform(string_split({c}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ')"


@query(f"""WITH t AS (SELECT c_custkey, {_PLACE_TEXT.format(n=_proper('n_name', 'duck'), r=_proper('r_name', 'duck'))} AS text FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
k AS (SELECT DISTINCT lower(name) AS key FROM ({_PLACE_NAMES}) WHERE length(name) >= 4),
h AS (SELECT c_custkey, text, key, i.range AS s, i.range + length(key) AS e FROM t, k, range(0, 200) i WHERE substr(lower(text), CAST(i.range AS INT) + 1, length(key)) = key),
b AS (SELECT * FROM h WHERE NOT regexp_matches(substr(text, CAST(s AS INT), CASE WHEN s = 0 THEN 0 ELSE 1 END), '[A-Za-z0-9@/.]') AND NOT regexp_matches(substr(text, CAST(e AS INT) + 1, 1), '[A-Za-z0-9]')
 AND regexp_matches(substr(text, CAST(s AS INT) + 1, 1), '[A-Z]') AND NOT (regexp_full_match(substr(text, CAST(s AS INT) + 1, length(key)), '[A-Z][a-z]+') AND regexp_matches(substr(text, CAST(e AS INT) + 1), '^\\s+[A-Z][A-Z]{{2,}}\\b')))
SELECT c_custkey, CAST(s AS INT) AS s, CAST(e AS INT) AS e, key FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.c_custkey = b.c_custkey AND o.s < b.e AND b.s < o.e AND length(o.key) > length(b.key))""")
def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the nations' and regions' tables in a text about each customer."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    texts = rows.selectExpr("c_custkey", _PLACE_TEXT.format(n=_proper("n_name", "spark"), r=_proper("r_name", "spark")) + " AS text")
    names = n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name"))).unionByName(spark.createDataFrame([("United",), ("UK",)], "name string"))
    found = dictionary.mentions(texts, "text", names)
    return found.select("c_custkey", F.explode("found").alias("f")).select("c_custkey", "f.s", "f.e", "f.key")


# --- relations -----------------------------------------------------------------------------------

_A = "'Ann Q' || translate(CAST(o_custkey AS STRING), '0123456789', 'ABCDEFGHIJ')"
_B = "'Ben Z' || translate(CAST(o_orderkey AS STRING), '0123456789', 'ABCDEFGHIJ')"
_SUM = "'£' || CAST(o_orderkey % 9000 + 100 AS STRING)"
#: Texts by the order's key modulo 6, and what each tells.
_TOLD_TEXT = f"""CASE o_orderkey % 6 WHEN 0 THEN {_A} || ' met ' || {_B} || '.' WHEN 1 THEN {_A} || ' was contacted by ' || {_B} || '.' WHEN 2 THEN {_A} || ' denies meeting ' || {_B} || '.'
WHEN 3 THEN {_A} || ' will travel to ' || {{n}} || '.' WHEN 4 THEN {_A} || ' paid ' || {_SUM} || ' to ' || {_B} || ', but ' || {_B} || ' did not call.' ELSE {_A} || ' works for ' || {_B} || '. He allegedly flew to ' || {{n}} || ' and stayed at ' || {{n}} || '.' END"""
_FACTS = [
    # (modulo, sentence, source, kind, relation, target, kind, tense, negated, passive, amount, confidence)
    (0, 0, _A, "person", "ASSOCIATE_OF", _B, "person", "past", False, False, None, "high"),
    (1, 0, _B, "person", "COMMUNICATED_WITH", _A, "person", "past", False, True, None, "high"),
    (2, 0, _A, "person", "ASSOCIATE_OF", _B, "person", "present", True, False, None, "low"),
    (3, 0, _A, "person", "TRAVELS_TO", "lower(n_name)", "location", "future", False, False, None, "high"),
    (4, 0, _A, "person", "TRANSACTED_WITH", _B, "person", "past", False, False, _SUM, "high"),
    (5, 0, _B, "person", "EMPLOYS", _A, "person", "present", False, False, None, "high"),
    (5, 1, _A, "person", "TRAVELS_TO", "lower(n_name)", "location", "past", False, False, None, "low"),
    (5, 1, _A, "person", "STAYS_AT", "lower(n_name)", "location", "past", False, False, None, "low"),
]


@query("WITH o AS (SELECT o_orderkey, o_custkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) " + " UNION ALL ".join(
    f"SELECT o_orderkey, {n} AS sentence, {a} AS source, '{ak}' AS source_kind, '{rel}' AS relation, {b} AS target, '{bk}' AS target_kind, '{tense}' AS tense, {neg} AS negated, {pas} AS passive, {tense == 'future'} AS planned, {amount or 'NULL'} AS amount, '{conf}' AS confidence FROM o WHERE o_orderkey % 6 = {k}"
    for k, n, a, ak, rel, b, bk, tense, neg, pas, amount, conf in _FACTS))
def told_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who did what to whom in a text about each order."""
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = spread(o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "o_custkey", "n_name"))
    texts = rows.selectExpr("o_orderkey", _TOLD_TEXT.format(n=_proper("n_name", "spark")) + " AS text")
    names = [x for r in n.select("n_name").limit(dictionary.LIMIT).collect() if (x := dictionary.usable(r[0]))]  # LIMIT names at most
    return clauses.relations(claims.claimed(texts, "text", names=names)).drop("cue_s", "cue_e", "day")


_C = "'Ben ZOR' || translate(CAST(o_orderkey AS STRING), '0123456789', 'ABCDEFGHIJ')"
_MEANT_TEXT = f"{_A} || ' met ' || {_C} || '. Then the ZOO saw ' || substring({_C}, 5) || ', who sold a car to him.'"


@query(f"WITH t AS (SELECT o_orderkey, {_C} AS label, {_MEANT_TEXT} AS text, substring({_C}, 5) AS sur FROM orders) "
       "SELECT o_orderkey, label, CAST(strpos(text, 'saw ' || sur) + 3 AS INT) AS s, CAST(strpos(text, 'saw ' || sur) + 3 + length(sur) AS INT) AS e FROM t UNION ALL SELECT o_orderkey, label, CAST(strpos(text, ' to him.') + 3 AS INT), CAST(strpos(text, ' to him.') + 6 AS INT) FROM t")
def meant_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare surnames and pronouns with the persons they mean, in a text about each order."""
    texts = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).selectExpr("o_orderkey", f"{_MEANT_TEXT} AS text")
    return clauses.mentioned(claims.claimed(texts))


_SIGNAL_TEXT = f"""CASE o_orderkey % 4 WHEN 0 THEN {_A} || ' was arrested in possession of a knife.' WHEN 1 THEN {_A} || ' met ' || {_B} || '. He has access to firearms.' WHEN 2 THEN 'A firearm was recovered near ' || {_A} || '.'
ELSE {_A} || ' and ' || {_B} || ' were charged with assault.' END"""
_SIGNALS = [(0, 0, _A, "status", "ARRESTED"), (0, 0, _A, "warning", "WEAPONS"), (1, 1, _A, "warning", "FIREARMS"), *((3, 0, who, kind, code) for who in (_A, _B) for kind, code in (("status", "CHARGED"), ("warning", "VIOLENT")))]


@query(" UNION ALL ".join(f"SELECT o_orderkey, {n}::INT AS sentence, {who} AS person, '{kind}' AS kind, '{code}' AS code FROM orders WHERE o_orderkey % 4 = {k}" for k, n, who, kind, code in _SIGNALS))
def told_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings and warnings of the persons that a text about each order tells them of."""
    texts = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).selectExpr("o_orderkey", f"{_SIGNAL_TEXT} AS text")
    return clauses.attributed(claims.claimed(texts))


# --- written forms -------------------------------------------------------------------------------

_IMEI = "lpad(CAST((o_orderkey * 7919 + o_custkey) % 1000000000000000 AS STRING), 15, '0')"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate AS d, o_custkey, {_IMEI} AS imei FROM orders)
SELECT o_orderkey, CAST(d AS DATE) AS taken, strftime(d, '%d/%m/%Y') AS day, strftime(d, '%d.%m.%Y') AS dots, strftime(d, '%Y%m%d') AS day_key,
 list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(imei, CAST(i AS INT), 1) AS INT) ELSE 2 * CAST(substr(imei, CAST(i AS INT), 1) AS INT) - CASE WHEN CAST(substr(imei, CAST(i AS INT), 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS imei_ok,
 'avenida zed' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS address FROM o""")
def written_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera dates, worded days in three forms, the check of device numbers and the keys of addresses, for every order."""
    o = table(spark, sf_dir, "orders")
    raw = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss").alias("camera"), F.date_format("o_orderdate", "d MMMM yyyy").alias("worded"), F.expr(_IMEI).alias("imei"),
                   F.expr("'12, Avenida Zed' || translate(CAST(o_custkey AS STRING), '0123456789', 'abcdefghij') || ' street'").alias("street"))
    keys = dates.day_keys(F.col("worded"))
    return raw.select("o_orderkey", dates.camera_date(F.col("camera")).alias("taken"), dates.day_text(F.col("worded")).alias("day"), keys["dots"].alias("dots"), keys["key"].alias("day_key"),
                      identifiers.imei_valid(F.col("imei")).alias("imei_ok"), contact.address_key(F.col("street")).alias("address"))
