"""Workflow, dossiers, removals, places and exports: rules and edges on small tables, and each query against its SQL."""

import datetime
import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from linkforge.operators import dossier, gazetteer, workflow
from linkforge.plans import casework, registry
from linkforge.sources import exports

NAMES = [n for n in registry.queries() if hasattr(casework, n)]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(repr(dict(sorted(zip(columns, row)))) for row in cursor.fetchall())
    got = sorted(repr(dict(sorted(r.asDict().items()))) for r in registry.queries()[name](spark, small).collect())
    assert got == want and got


def test_actions(spark):
    reports = spark.createDataFrame([("a", "DRAFT", True), ("b", "PENDING_AUTH", None), ("c", "PENDING_AUTH", True), ("d", None, True)], "urn string, status string, ready boolean")
    asked = [("a", "SUBMIT", None), ("a", "AUTHORISE", None), ("b", "AUTHORISE", ""), ("c", "AUTHORISE", ""), ("c", "REJECT", "  "), ("c", "REJECT", "thin"), ("d", "SUBMIT", ""), ("z", "SUBMIT", ""), (None, None, None)]
    got = [tuple(r)[2:] for r in workflow.apply_actions(reports, spark.createDataFrame(asked, "urn string, action string, reason string").coalesce(1)).orderBy(F.col("urn").asc_nulls_last(), "action", "reason").collect()]
    assert got == [
        (False, "DRAFT", "Cannot AUTHORISE from status DRAFT"), (True, "PENDING_AUTH", None), (False, "PENDING_AUTH", "Not ready to authorise."), (True, "AUTHORISED", None),
        (False, "PENDING_AUTH", "Rejection reason required."), (True, "REJECTED", None), (False, None, "Cannot SUBMIT from status "), (False, None, "No such report."), (False, None, "No such report."),
    ]


def test_locks_conflicts_and_moves(spark):
    at = datetime.datetime(2024, 1, 1, 12)
    rows = [(None, at, True), ("me", at, True), ("x", None, True), ("x", at - datetime.timedelta(minutes=30), False), ("x", at - datetime.timedelta(minutes=30, seconds=1), True)]
    df = spark.createDataFrame([(h, t, w, at) for h, t, w in rows], "h string, t timestamp, want boolean, at timestamp")
    assert not df.where(workflow.can_lock(F.col("h"), F.col("t"), F.lit("me"), F.col("at")) != F.col("want")).count()
    pairs = spark.createDataFrame([(1, None), (None, 2), (2, 2), (1, 2)], "b int, s int").coalesce(1)
    assert [r[0] for r in pairs.select(workflow.conflict(F.col("b"), F.col("s"))).collect()] == ["new", "no-base", "unchanged", "conflict"]
    moves = spark.createDataFrame([("action", "Open", "Complete"), ("action", "Complete", "Open"), ("decision", "Logged", "Logged"), (None, None, None)], "k string, a string, b string").coalesce(1)
    assert [r[0] for r in moves.select(workflow.can_move(F.col("k"), F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    records = spark.createDataFrame([(1, "Open", "ann", None, 1), (2, "Closed", None, "ann", 2), (3, None, "bob", "bob", 3)], "id int, status string, owner string, assignee string, modified_at int")
    assert {r["id"] for r in workflow.open_items(records).collect()} == {1, 3}
    assert [r["id"] for r in workflow.work_of(records, "ann").collect()] == [2, 1]
    assert [r["id"] for r in workflow.newest(records, 2, "modified_at").collect()] == [3, 2] and workflow.newest(records.limit(0), 2, "id").count() == 0


def test_dossiers_and_removals(spark):
    cols = "id string, urn string, type string, label string, role string, is_alias boolean, attrs map<string,string>"
    e = spark.createDataFrame(
        [("a", "r1", "person", "Ann", "", True, {"pnc": "9", "dob": ""}), ("b", "r2", "person", "Ann", "lead", None, {"dob": "1990"}), ("c", "r2", "vehicle", "AB12", None, None, None), ("d", "r1", "note", "n", None, None, None), ("e", None, "person", None, None, None, None)],
        cols,
    )
    links = spark.createDataFrame([("l1", "r2", "b", "c"), ("l2", "r1", "b", "c"), ("l3", "r1", "a", "d"), ("l4", "r1", "a", "a"), ("l5", "r2", "c", "b")], "id string, urn string, src string, dst string")
    m = spark.createDataFrame([("a", "M"), ("b", "M"), ("c", "C"), ("e", "E")], "id string, master_id string")
    facts = {tuple(r) for r in dossier.dossier_facts(e, links, m).collect()}
    assert facts == {("M", "name", "Ann", "r1"), ("M", "alias", "Ann", "r1"), ("M", "pnc", "9", "r1"), ("M", "role", "lead", "r2"), ("M", "vehicle", "AB12", "r2")}
    assert {tuple(r) for r in dossier.dossier_heads(e, m).collect()} == {("M", "Ann", "1990", 2, 2), ("E", None, None, 0, 1)}
    got = {tuple(r) for r in dossier.deletion_impacts(e, links, m).collect()}
    assert got == {("a", "r1", "detach", 1, 2), ("b", "r2", "detach", 1, 2), ("c", "r2", "delete", 0, 2), ("d", "r1", "delete", 0, 1), ("e", None, "delete", 0, 0)}
    assert dossier.dossier_facts(e.limit(0), links, m).count() == 0


def test_places(spark):
    gaz = spark.createDataFrame(
        [("Málaga", "city", "ES", 36.7, -4.4, None, None, 1), ("Malaga Airport", "airport", "ES", 36.6, -4.5, ["AGP field"], "AGP", 2), ("Leeds Bradford", "airport", "GB", 53.8, -1.6, None, "LBA", 3), ("Leeds", "city", "GB", 53.8, -1.5, None, "", 4), ("York", "city", "GB", 54.0, -1.1, ["Jorvik"], None, 5)],
        "name string, kind string, cc string, lat double, lon double, aliases array<string>, iata string, ord int",
    )
    asked = ["MALAGA", "malaga  airport", "Leeds airport", "York Airport", "jorvik", "Atlantis", "Atlantis airport", "", None]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    got = [r["place"] and r["place"]["name"] for r in gazetteer.lookup(rows, "q", gaz).orderBy("i").collect()]
    assert got == ["Málaga", "Malaga Airport", "Leeds Bradford", "York", "York", None, None, None, None]
    got = [r["airport"] and r["airport"]["iata"] for r in gazetteer.airport_of_city(rows.withColumn("q", F.regexp_replace("q", " +(?i)airport", "")), "q", gaz).orderBy("i").collect()]
    assert got == ["AGP", "AGP", "LBA", None, None, None, None, None, None]
    codes = spark.createDataFrame([(0, "agp"), (1, "XXX"), (2, None)], "i int, c string")
    assert [r["place"] and r["place"]["name"] for r in gazetteer.by_iata(codes, "c", gaz).orderBy("i").collect()] == ["Malaga Airport", None, None]


def test_jitter_is_that_of_utf16_units(spark):
    def brute(s: str, scale: float) -> float:
        data, h = s.encode("utf-16-le"), 0
        for i in range(0, len(data), 2):
            h = (h * 31 + data[i] + 256 * data[i + 1]) % 2**32
        return (h % 1000 / 1000 - 0.5) * scale

    texts = ["", "a", "12 High Street, Leeds", "Šimek", "x" * 5000, "𝒳y🚗"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(gazetteer.jitter(F.col("t"), 0.02)).collect()]
    assert got == pytest.approx([brute(t, 0.02) for t in texts], abs=1e-12)


def test_arc(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double").coalesce(1)
    bowed, same = [r[0] for r in df.select(gazetteer.arc(*[F.col(c) for c in "abcd"])).collect()]
    assert len(bowed) == 25 and tuple(bowed[0]) == (0, 0) and tuple(bowed[24]) == pytest.approx((0, 10)) and bowed[12]["lat"] == pytest.approx(-0.75) and bowed[12]["lon"] == pytest.approx(5)
    assert [tuple(p) for p in same] == [(1, 1), (1, 1)]


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 11 END AS k")
    got = exports.numbered(df, ["k", "id"]).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 5001)) and [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)
    assert exports.numbered(df.limit(0), ["id"]).count() == 0


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 1), ('say "hi"', 2), (None, 3)], "a string, b int").coalesce(1)
    exports.write_csv(rows, f"file://{tmp_path}/out")
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ['"a","b"', '"\'=1+1","1"', '"say ""hi""","2"', '"","3"']
    for i in (1, 2):
        exports.append_activity(spark.createDataFrame([(i,)], "i int"), f"file://{tmp_path}/log")
    assert {r["i"] for r in spark.read.json(f"file://{tmp_path}/log").collect()} == {1, 2}


def test_handoff(spark):
    cols = "urn string, title string, operation string, status string, marking string, handling string, provenance string, items array<struct<seq:int,source_type:string,text:string,source_eval:string,intel_eval:string>>"
    rows = spark.createDataFrame([("r1", "T", None, "DRAFT", "OFFICIAL", "C", "hidden", [(1, "call", "He left", "1", "E")]), ("r2", None, "op", None, None, None, "hidden", None)], cols)
    one, two = [json.loads(r["document"]) for r in exports.handoffs(rows).orderBy("urn").collect()]
    assert one["schema"] == "system.ir.v1" and one["items"][0]["grade"] == "[1EC]" and one["report"]["operation"] == "" and "hidden" not in json.dumps([one, two])
    assert two["items"] == [] and two["report"] == {"urn": "r2", "operation": "op"}
