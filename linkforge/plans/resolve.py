"""Queries of resolution over the driver's tables: duplicates of all types, merges of entities and their undo; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.operators import duplicates, merging
from linkforge.operators.workflow import LIFECYCLE
from linkforge.plans import views as v
from linkforge.plans.register import query
from linkforge.session import settled, table
from linkforge.streaming import requests

#: A customer's number in nine digits at least, never cut, so no two customers share a phone; behind 07 longer ones would be no British numbers.
_PHONE = "lpad(CAST(c_custkey AS STRING), greatest(9, length(CAST(c_custkey AS STRING))), '0')"


@query("""WITH e AS (SELECT 'A' || c_custkey AS a, 'B' || c_custkey AS b FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <> 0 UNION ALL SELECT 'E' || c_custkey, 'F' || c_custkey FROM customer WHERE c_custkey % 3 = 0),
n AS (SELECT 'L' || n_nationkey AS id, n_regionkey AS r, min('L' || n_nationkey) OVER (PARTITION BY n_regionkey) AS rep FROM nation)
SELECT a, b, 1.0::DOUBLE AS score, 'exact' AS tier, 'class' AS rule FROM e UNION ALL SELECT rep, id, 1.0::DOUBLE, 'exact', 'gazetteer' FROM n WHERE id <> rep""")
def duplicate_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones and mails of customers written in two ways, and nations by their region's number as gazetteer id; every tenth pair of phones is told apart."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    maps = "cast(map() AS map<string,string>) AS attrs"

    def part(rows: DataFrame, key: str, kind: str, label: str, ids: str = "cast(map() AS map<string,string>)") -> DataFrame:
        return rows.selectExpr(f"'{key}' || {rows.columns[0]} AS id", f"'{kind}' AS type", f"{label} AS label", maps, f"{ids} AS ids")

    rows = part(c, "A", "phone", f"'+447' || {_PHONE}").unionByName(part(c.where("c_custkey % 2 = 0"), "B", "phone", f"CASE WHEN c_custkey < 1000000000 THEN '07' ELSE '0044 7' END || {_PHONE}"))
    rows = rows.unionByName(part(c, "E", "email", "'u.' || c_custkey || '+t@gmail.com'")).unionByName(part(c.where("c_custkey % 3 = 0"), "F", "email", "'u' || c_custkey || '@googlemail.com'"))
    rows = rows.unionByName(part(n, "L", "location", "'Town ' || translate(CAST(n_nationkey AS STRING), '0123456789', 'abcdefghij')", "map('gaz', CAST(n_regionkey AS STRING))"))
    told = c.where("c_custkey % 10 = 0").selectExpr("'B' || c_custkey AS a", "'A' || c_custkey AS b")
    return duplicates.duplicates(rows, told).drop("reasons")


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as entities, and merges: of each four the third absorbs the fourth, then the first the second and the third. Balances are in whole cents, rounded: 3452.03 * 100 is less than 345203."""
    s = table(spark, sf_dir, "supplier")
    attrs = "CASE WHEN s_suppkey % 2 = 0 THEN map('balance', CAST(CAST(rint(s_acctbal * 100) AS BIGINT) AS STRING)) ELSE cast(map() AS map<string,string>) END AS attrs"
    rows = s.selectExpr("'S:' || s_suppkey AS id", "'organisation' AS type", "s_name AS label", attrs, "map('nation', CAST(s_nationkey AS STRING)) AS ids", "cast(NULL AS array<double>) AS geo", "'' AS source_text")
    first = s.where("s_suppkey % 4 = 1")
    asked = [first.selectExpr(f"s_suppkey + {at} AS seq", f"'S:' || (s_suppkey + {keep}) AS keep", f"'S:' || (s_suppkey + {drop}) AS drop") for at, keep, drop in ((0, 2, 3), (10_000_000, 0, 1), (20_000_000, 0, 2))]
    return rows, asked[0].unionByName(asked[1]).unionByName(asked[2])


@query("""SELECT 'S:' || a.s_suppkey AS id, CAST(coalesce(CASE WHEN a.s_suppkey % 2 = 0 THEN CAST(a.s_acctbal * 100 AS BIGINT) END, CAST(b.s_acctbal * 100 AS BIGINT), CAST(d.s_acctbal * 100 AS BIGINT)) AS VARCHAR) AS balance, CAST(a.s_nationkey AS VARCHAR) AS nation,
CASE WHEN b.s_name IS NULL THEN NULL WHEN c.s_name IS NULL THEN b.s_name ELSE b.s_name || '; ' || c.s_name END AS aka
FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 AND a.s_suppkey > 0 LEFT JOIN supplier c ON c.s_suppkey = a.s_suppkey + 2 AND a.s_suppkey > 0 LEFT JOIN supplier d ON d.s_suppkey = a.s_suppkey + 3 AND a.s_suppkey > 0
WHERE a.s_suppkey % 4 = 1 OR a.s_suppkey = 0""")
def merged_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers after merges in chains: what the first lacks comes from those that it absorbs, in order."""
    rows, asked = _suppliers(spark, sf_dir)
    links = spark.createDataFrame([], "id string, src string, dst string, type string")
    events = spark.createDataFrame([], "id string, members array<string>")
    held, _, _ = merging.merge(rows, links, events, asked)
    return held.select("id", F.col("attrs")["balance"].alias("balance"), F.col("ids")["nation"].alias("nation"), F.col("attrs")["aka"].alias("aka"))


@query(f"""WITH m AS (SELECT 'S:' || s_suppkey AS id, 'S:' || CASE WHEN s_suppkey = 0 THEN 0 ELSE s_suppkey - (s_suppkey - 1) % 4 END AS root FROM supplier), l AS (SELECT * FROM ({v.LINKS_SQL})),
t AS (SELECT DISTINCT coalesce(a.root, l.src) AS src, coalesce(b.root, l.dst) AS dst, l.type FROM l LEFT JOIN m a ON a.id = l.src LEFT JOIN m b ON b.id = l.dst)
SELECT 'merged' AS state, src, dst, type FROM t WHERE src <> dst UNION ALL SELECT DISTINCT 'undone', src, dst, type FROM l""")
def merged_and_undone_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after the merges of suppliers, and after these have been undone."""
    rows, asked = _suppliers(spark, sf_dir)
    # Links, what became of them and what changed are each read several times, so they are written once.
    links = settled(v.links(spark, sf_dir).select(F.concat_ws(">", "src", "dst", "type").alias("id"), "src", "dst", "type"), "links")
    events = spark.createDataFrame([], "id string, members array<string>")
    _, after, _ = merging.merge(rows, links, events, asked)
    after = settled(after, "merged")
    back = merging.undo(after, settled(merging.images(links, after, 1), "images"))
    return after.select(F.lit("merged").alias("state"), "src", "dst", "type").unionByName(back.select(F.lit("undone").alias("state"), "src", "dst", "type"))


_STEPS = ", ".join(f"('{s}', '{a}', '{to}')" for s, moves in LIFECYCLE.items() for a, to in moves.items())
_ACTION = "CASE doc_id % 4 WHEN 0 THEN 'AUTHORISE' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'SUPPRESS' ELSE 'RETURN_TO_DRAFT' END"


@query(f"""WITH t(s, a, after) AS (VALUES {_STEPS}), d AS (SELECT 'IR' || doc_id AS urn, {_ACTION} AS act, doc_id % 3 <> 0 AS ready, doc_id % 5 <> 0 AS told FROM documents),
one AS (SELECT d.*, r.status AS s0, t.after AS a1 FROM d JOIN ({v.REPORTS_SQL}) r USING (urn) LEFT JOIN t ON t.s = r.status AND t.a = 'SUBMIT'),
two AS (SELECT *, coalesce(a1, s0) AS s1, CASE WHEN a1 IS NULL THEN 0 ELSE 1 END AS v1 FROM one),
three AS (SELECT two.*, t.after AS a2, CASE WHEN t.after IS NULL THEN 'Cannot ' || act || ' from status ' || s1 WHEN act = 'AUTHORISE' AND NOT ready THEN 'Not ready to authorise.' WHEN act = 'REJECT' AND NOT told THEN 'Rejection reason required.'
 WHEN act = 'SUPPRESS' AND NOT told THEN 'Suppression reason required.' END AS e2 FROM two LEFT JOIN t ON t.s = s1 AND t.a = act)
SELECT urn, 1::BIGINT AS seq, a1 IS NOT NULL AS ok, s1 AS status, v1::BIGINT AS version, CASE WHEN a1 IS NULL THEN 'Cannot SUBMIT from status ' || s0 END AS error FROM three
UNION ALL SELECT urn, 2, e2 IS NULL, CASE WHEN e2 IS NULL THEN a2 ELSE s1 END, v1 + CASE WHEN e2 IS NULL THEN 1 ELSE 0 END, e2 FROM three""")
def streamed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests on each report in one stream: the second is judged against what the first made of it."""
    kind = table(spark, sf_dir, "documents").schema
    docs = spark.readStream.schema(kind).parquet(f"{sf_dir}/documents*.parquet")
    each = "inline(array(struct(2L AS seq, " + _ACTION + " AS action), struct(1L AS seq, 'SUBMIT' AS action)))"
    asked = docs.selectExpr("'IR' || doc_id AS urn", "doc_id % 3 <> 0 AS ready", "CASE WHEN doc_id % 5 <> 0 THEN 'why' END AS reason", each)
    stream = asked.selectExpr("urn", "seq", "'ACT' AS kind", "'who' AS who", "0L AS at", "action", "reason", "ready", "CAST(NULL AS BIGINT) AS base")
    standing = v.reports(spark, sf_dir).selectExpr("urn", "status", "0L AS version", "CAST(NULL AS STRING) AS holder", "CAST(NULL AS BIGINT) AS taken_at")
    return requests.run(requests.verdicts(stream, standing)).select("urn", "seq", "ok", "status", "version", "error")
