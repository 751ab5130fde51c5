"""Dates, amounts, names, changes of records, spans and betweenness, on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from linkforge.functions import dates, names
from linkforge.operators import analytics, graph, mutation, spans


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-02-29", (2024, 2, 29)),
        ("2023-02-29", None),
        (" 4/9/1983 ", (1983, 9, 4)),
        ("31/02/2020", None),
        ("1.2.30", (2030, 2, 1)),
        ("1.2.31", (1931, 2, 1)),
        ("4 SEPTEMBER 1983", (1983, 9, 4)),
        ("March 12, 2024", (2024, 3, 12)),
        ("12 Smarch 2024", None),
        ("12th Mar. 24", (2024, 3, 12)),
        ("Sept 3rd 1999", (1999, 9, 3)),
        ("2024/3/1", (2024, 3, 1)),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(dates.parse_date(F.col("raw"))).first()[0]
    assert got == (want and datetime.date(*want))


def test_parse_amount(spark):
    raws = ["£1,234.50", "(12 usd)", "minus €3", "GBP 250.50", "-$7", "none", "the 5", None]
    got = [r["p"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").orderBy("i").select(dates.parse_amount(F.col("raw")).alias("p")).collect()]
    assert [g and (g["code"], float(g["amount"])) for g in got] == [("GBP", 1234.5), ("USD", -12.0), ("EUR", -3.0), ("GBP", 250.5), ("USD", -7.0), None, (None, 5.0), None]
    want = ["GBP 1234.50", "USD -12", "EUR -3", "GBP 250.50", "USD -7", "none", "the 5", None]
    assert [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raws)], "i int, raw string").orderBy("i").select(dates.amount_text(F.col("raw"))).collect()] == want


def test_name_similarity(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("dwayne", "duane"), ("abcx", "abqw"), ("a", "a"), ("", "a"), (None, "a"), ("SMITH", "smith"), ("", "")], "a string, b string")
    got = [r[0] for r in rows.coalesce(1).select(names.name_similarity("a", "b")).collect()]
    assert [g if g is None else round(g, 3) for g in got] == [0.961, 0.84, 0.733, 1.0, 0.0, None, 1.0, 1.0]


def test_upsert_and_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    new = spark.createDataFrame([(2, "c"), (3, None), (None, "m")], "k int, x string")
    got = {tuple(r) for r in mutation.upsert(old, new, "k").collect()}
    assert got == {(1, "a"), (2, "c"), (3, None), (None, "n"), (None, "m")}
    known = [d.where("k is not null") for d in (old, new)]
    assert {tuple(r) for r in mutation.field_diff(*known, "k", ["x"]).collect()} == {(1, "x", "a", None), (2, "x", "b", "c")}


def test_merge_entities(spark):
    ent = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    links = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("a", "c", "t"), ("d", "z", "t")], "src string, dst string, type string")
    left, moved = mutation.merge_entities(ent, links, spark.createDataFrame([("a", "b")], "keep string, drop string"))
    assert {r["id"] for r in left.collect()} == set("acd")
    assert [tuple(r) for r in moved.collect()] == [("a", "c", "t")]


def test_spans(spark):
    a = spark.createDataFrame([("d", 0, 3), ("d", 3, 5), ("d", 8, 9), ("e", 0, 3)], "g string, s int, e int")
    b = spark.createDataFrame([("d", 2, 6), (None, 0, 9)], "g string, s int, e int")
    assert {tuple(r) for r in spans.contained(a, b, "g").collect()} == {("d", 3, 5, 2, 6)}
    assert {tuple(r) for r in spans.free_of(a, b, "g").collect()} == {("d", 8, 9), ("e", 0, 3)}


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        (["ab", "bc", "cd", "de"], {"a": 0, "b": 3, "c": 4, "d": 3, "e": 0, "f": 0}),
        (["ab", "bc", "cd", "da", "ba", "aa", "az"], {"a": 0.5, "b": 0.5, "c": 0.5, "d": 0.5, "e": 0, "f": 0}),
        (["ab", "ac", "bc", "cd"], {"a": 0, "b": 0, "c": 2, "d": 0, "e": 0, "f": 0}),
        ([], dict.fromkeys("abcdef", 0)),
    ],
)
def test_betweenness(spark, edges, want):
    v = spark.createDataFrame([(i,) for i in "abcdef"], "id string")
    links = spark.createDataFrame([tuple(e) for e in edges], "src string, dst string")
    assert {r["id"]: r["score"] for r in graph.betweenness(v, links).collect()} == want


def test_worst_item_and_coverage(spark):
    items = spark.createDataFrame([("r", 1, 2, "B"), ("r", 2, 3, "A"), ("r", 3, 3, "A"), ("s", 1, None, "E"), ("t", 1, 1, "E"), ("t", 2, 1, "C")], "urn string, seq int, source int, intel string")
    assert {tuple(r) for r in analytics.worst_item(items, "urn", "source", "intel", "seq").collect()} == {("r", 3, "A"), ("t", 1, "E")}
    done = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "z"), ("b", None)], "who string, system string")
    assert {tuple(r) for r in analytics.coverage(done, "who", "system", ["x", "y"]).collect()} == {("a", 1, 0), ("b", 0, 0)}


def test_first_linked(spark):
    v = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q"), ("d", "q")], "id string, type string")
    links = spark.createDataFrame([("a", "d", 2), ("c", "a", 1), ("a", "a", 0), ("b", "a", 3), ("b", "z", 1)], "src string, dst string, ord int")
    got = {tuple(r) for r in graph.first_linked(v, links).collect()}
    assert got == {("a", "q", "c"), ("a", "p", "b"), ("b", "p", "a"), ("c", "p", "a"), ("d", "p", "a")}


def test_references_of_a_large_owner(spark, tmp_path):
    from linkforge.plans import registry

    spark.range(1, 10021).selectExpr("id as o_orderkey", "1 as o_custkey").write.parquet(f"file://{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["ref"] for r in registry.queries()["sequence_refs"](spark, f"file://{tmp_path}").collect()}
    assert got == {i: f"E{i:04}" for i in range(1, 10021)} and len(set(got.values())) == 10020
