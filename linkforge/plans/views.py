"""The domain views over the driver's tables, each as a DataFrame and as the same SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.session import small_tasks, table

REPORTS_SQL = """
SELECT 'IR' || d.doc_id AS urn, d.source AS operation, d.lang AS threat,
  CASE WHEN l.doc_id IS NULL THEN 'DRAFT' WHEN l.toxic = 1 THEN 'SUPPRESSED' WHEN l.quality = 1 THEN 'AUTHORISED' ELSE 'REJECTED' END AS status,
  CASE WHEN d.n_chars > 3000 THEN 'OFFICIAL-SENSITIVE' ELSE 'OFFICIAL' END AS marking,
  [d.source, 'lang-' || d.lang] AS source_types, d.text AS haystack, d.n_chars AS n_chars,
  CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE '2024' || lpad(CAST(d.doc_id % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS date_key
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

ENTITIES_SQL = """
SELECT 'C:' || c_custkey AS id, 'organisation' AS type, c_name AS label, c_nationkey AS nk FROM customer
UNION ALL SELECT 'S:' || s_suppkey, 'organisation', s_name, s_nationkey FROM supplier
UNION ALL SELECT 'P:' || p_partkey, 'note', p_name, NULL FROM part
UNION ALL SELECT 'N:' || n_nationkey, 'location', n_name, n_nationkey FROM nation
UNION ALL SELECT 'R:' || r_regionkey, 'location', r_name, NULL FROM region
"""

LINKS_SQL = """
SELECT 'C:' || o_custkey AS src, 'S:' || l_suppkey AS dst, 'TRANSACTED_WITH' AS type, CAST(min(o_orderdate) AS DATE) AS day
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey
UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'LOCATED_IN', NULL FROM supplier
UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'LOCATED_IN', NULL FROM customer
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'LOCATED_IN', NULL FROM nation
"""


def _id(prefix: str, c: str):  # noqa: ANN202
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    day = F.concat(F.lit("2024"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    return d.join(lab, d["doc_id"] == lab["l_id"], "left").select(
        _id("IR", "doc_id").alias("urn"), F.col("source").alias("operation"), F.col("lang").alias("threat"),
        F.when(F.col("l_id").isNull(), "DRAFT").when(F.col("toxic") == 1, "SUPPRESSED").when(F.col("quality") == 1, "AUTHORISED").otherwise("REJECTED").alias("status"),
        F.when(F.col("n_chars") > 3000, "OFFICIAL-SENSITIVE").otherwise("OFFICIAL").alias("marking"),
        F.array(F.col("source"), F.concat(F.lit("lang-"), F.col("lang"))).alias("source_types"), F.col("text").alias("haystack"), "n_chars",
        F.when(F.col("doc_id") % 10 == 0, "").otherwise(day).alias("date_key"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_tasks(spark)

    def part(name: str, prefix: str, key: str, kind: str, label: str, nk: str | None) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(prefix, key).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"), (F.col(nk) if nk else F.lit(None)).cast("int").alias("nk"))

    out = part("customer", "C:", "c_custkey", "organisation", "c_name", "c_nationkey")
    out = out.unionByName(part("supplier", "S:", "s_suppkey", "organisation", "s_name", "s_nationkey")).unionByName(part("part", "P:", "p_partkey", "note", "p_name", None))
    return out.unionByName(part("nation", "N:", "n_nationkey", "location", "n_name", "n_nationkey")).unionByName(part("region", "R:", "r_regionkey", "location", "r_name", None))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_tasks(spark)
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    deals = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_custkey", "l_suppkey").agg(F.min("o_orderdate").alias("day"))
    out = deals.select(_id("C:", "o_custkey").alias("src"), _id("S:", "l_suppkey").alias("dst"), F.lit("TRANSACTED_WITH").alias("type"), F.to_date("day").alias("day"))

    def located(name: str, a: str, x: str, b: str, y: str) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(a, x).alias("src"), _id(b, y).alias("dst"), F.lit("LOCATED_IN").alias("type"), F.lit(None).cast("date").alias("day"))

    for x in (("supplier", "S:", "s_suppkey", "N:", "s_nationkey"), ("customer", "C:", "c_custkey", "N:", "c_nationkey"), ("nation", "N:", "n_nationkey", "R:", "n_regionkey")):
        out = out.unionByName(located(*x))
    return out


PLACES_SQL = f"""
v AS (SELECT id FROM ({ENTITIES_SQL}) WHERE substr(id, 1, 2) IN ('N:', 'R:', 'S:')),
e AS (SELECT DISTINCT src AS a, dst AS b FROM ({LINKS_SQL}) WHERE type = 'LOCATED_IN' AND substr(src, 1, 2) IN ('N:', 'S:')),
adj AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
"""
