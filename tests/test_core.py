"""Scalars by vectors, and resolution by union-find."""

import random

import pytest
from pyspark.sql import functions as F

from linkforge.functions import contact, dates, grades, identifiers, names, vocabulary
from linkforge.operators import analytics, graph, matching, resolution, search
from linkforge.operators.components import connected_components


def one(spark, f, raw):
    return spark.createDataFrame([(raw,)], "raw string").select(f(F.col("raw"))).first()[0]


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [
        (contact.email_canonical, " Jo.Ann+x@GoogleMail.com", "joann@gmail.com"),
        (contact.email_canonical, "a.b+c@d.org", "a.b@d.org"),
        (contact.email_canonical, "nobody", None),
        (contact.email_canonical, None, None),
        (contact.phone_national, "+44 7700 900123", "07700900123"),
        (contact.phone_national, "+34 612345678", "0034612345678"),
        (contact.phone_national, "", ""),
        (contact.canonical_name, "  O'Brien & Sons Limited ", "o brien sons ltd"),
        (contact.csv_safe, "=1+1", "'=1+1"),
        (contact.phone_national, "0044 7700", "07700"),
        (contact.phone_national, "7700 900123", "07700900123"),
        (contact.phone_national, "44 7700 900123", "07700900123"),
        (contact.phone_national, "44123", "044123"),
        (contact.phone_valid, "+34 612345678", True),
        (contact.phone_valid, "12", False),
        (contact.canonical_name, "Šimek Nováková", "simek novakova"),
        (contact.canonical_name, "e\u0301mile ÇELIK", "emile celik"),
        (contact.organisation_caps, "Acme  Public Limited Company", "ACME PLC"),
        (contact.address_key, "12 Long Road", "long"),
        (dates.day_text, "12th Mar 24", "12/03/2024"),
        (dates.day_text, "31/02/2020", ""),
        (dates.time_text, "12:05 am (local)", "00:05 (Local)"),
        (dates.time_text, "24:00", ""),
        (names.title_case, "ANNE-marie o'neil mcdonald MACLEOD", "Anne-Marie O'Neil McDonald MacLeod"),
        (names.person_label, "Dr. ludwig van beethoven jr", "Ludwig VAN BEETHOVEN Jr"),
        (names.person_label, "O'NEIL, mr anne marie", "Anne Marie O'NEIL"),
        (names.person_label, "smith", "SMITH"),
        (grades.grade_sentence, "2bp", "Untested; Known personally to source but not to officer; Lawful sharing permitted."),
        (grades.grade_of_confidence, "HIGH", "[1AP]"),
        (grades.line_strength, None, "Unconfirmed"),
        (vocabulary.status, "He was Wanted; two victims", ["WANTED", "VICTIM"]),
        (vocabulary.warnings, "In Burgundy without guns, self-harm", ["FIREARMS", "SELF_HARM"]),
        (identifiers.account, "12 34", "00001234"),
        (identifiers.nino_valid, "AB 12 34 56 C", True),
        (identifiers.nino_valid, "GB123456A", False),
        (identifiers.iban_valid, "GB82 WEST 1234 5698 7654 32", True),
        (identifiers.iban_valid, "GB82 WEST 1234 5698 7654 33", False),
        (identifiers.luhn, "4539 1488 0343 6467", True),
        (identifiers.luhn, "4539 1488 0343 6468", False),
        (identifiers.postcode, "sw1a1aa", "SW1A 1AA"),
        (identifiers.postcode_valid, "M1 2BB", True),
        (identifiers.postcode_valid, "12345", False),
        (identifiers.vin_valid, "1M8GDM9AXKP042788", True),
        (identifiers.company_valid, "sc123456", True),
        (identifiers.company_valid, "XX123456", False),
        (identifiers.vrm_format_valid, "ab12 cde", True),
        (identifiers.ip_valid, "256.1.1.1", False),
        (identifiers.ip_valid, "fe80::1", True),
    ],
)
def test_scalars(spark, f, raw, want):
    assert one(spark, f, raw) == want


@pytest.mark.parametrize(
    ("family", "raw", "want"),
    [
        ("vrm", "vrm ab12 cde", ("AB12CDE", True, "VRM AB12CDE")),
        ("vin", "VIN 1M8GDM9AXKP042788", ("1M8GDM9AXKP042788", True, "VIN 1M8GDM9AXKP042788")),
        ("driverLicence", "drv MORGA657054SM9IJ", ("MORGA657054SM9IJ", True, "DRV MORGA657054SM9IJ")),
        ("driverLicence", "MORGA613354SM9IJ", ("MORGA613354SM9IJ", False, "DRV MORGA613354SM9IJ")),
        ("cro", "s 123/07 k", ("S123/07K", True, "SCRO S123/07K")),
        ("serial", "Serial ab-1", ("AB1", True, "Serial AB1")),
        ("jabber", "Jabber Ann @X.org", ("ann@x.org", True, "Jabber ann@x.org")),
        ("skype", "skype Li", ("Li", False, "Skype Li")),
        ("twitter", "twitter @Ann_1", ("Ann_1", True, "Twitter Ann_1")),
        ("ip", "IP address 10.0.0.256", ("10.0.0.256", False, "IP Address 10.0.0.256")),
        ("ip", "fe80::1", ("fe80::1", True, "IP Address fe80::1")),
        ("shoe", " size  9 ", ("size 9", False, "size 9")),
    ],
)
def test_identifier_families(spark, family, raw, want):
    got = one(spark, lambda c: identifiers.identify(family, c), raw)
    assert tuple(got)[1:] == want and one(spark, lambda c: identifiers.identify(family, c), None) is None


def test_wallets(spark):
    eth, btc = "0x" + "aB" * 20, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT"
    assert [tuple(x) for x in one(spark, vocabulary.wallets, f"pay {btc}, or {eth}.")] == [("ETH", eth), ("BTC", btc)]


def test_duplicates_equal_all_pairs(spark):
    """Against every pair, over surnames one or two letters apart and forenames of all kinds."""
    r = random.Random(6)
    base = ["richardson", "andersson", "oneil", "ng", "christopherson", "villanueva", "featherstonehaugh", "li"]
    last = base + ["".join(c for i, c in enumerate(x) if i != r.randrange(len(x))) or x for x in base] + [x[0] + x[:1:-1] for x in base] + [x.replace("s", "z") for x in base] + ["x" + x[1:] for x in base]
    rows = sorted({f"{r.choice(['ann', 'bill', 'william', 'b', 'jon', 'johnny', 'catherine', 'katherine'])} {r.choice(last)}" for _ in range(250)} | {"ann", "richardson"})
    got = {(x["a"], x["b"]): x["score"] for x in matching.duplicate_people(spark.createDataFrame([(x,) for x in [*rows, rows[3], None, ""]], "name string")).collect()}
    want = {(a, b): round(names.person_score(a, b), 6) for a in rows for b in rows if a < b and " " in a and " " in b and names.person_score(a, b) >= 0.85}
    assert got == want and len(want) > 20


def test_radius_across_the_date_line_and_at_a_pole(spark):
    df = spark.createDataFrame([(i, float(la), float(lo)) for i, (la, lo) in enumerate((a, b) for a in range(-90, 91, 6) for b in range(-180, 180, 7))], "i int, lat double, lon double")
    for lat, lon, km in ((10, 179, 1500), (10, -179, 1500), (84, 20, 900), (51.5, 0, 2500), (-89, 0, 400)):
        far = analytics.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
        assert {x["i"] for x in analytics.within(df, lat, lon, km).collect()} == {x["i"] for x in df.where(far <= km).collect()}


@pytest.mark.parametrize(("raw", "want"), [("07700 900123", ("+447700900123", "44", True)), ("0034 612 345 678", ("+34612345678", "34", True)), ("123456789", ("123456789", None, False)), ("12", (None, None, False)), (None, (None, None, False))])
def test_phone_e164(spark, raw, want):
    assert tuple(one(spark, contact.phone_e164, raw)) == want


def test_masters_equal_union_find(spark):
    r = random.Random(2)
    rows = [(f"E{i:03}", r.choice(["person", "organisation", "vehicle"]), r.choice(["Ann B", "Bob  C", "", None]), {k: str(r.randrange(25)) for k in r.sample(["dob", "nino", "pnc", "companyNumber", "vrm"], 2)}) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, type string, label string, attrs map<string,string>")
    sigs = resolution.signatures(df).collect()
    up = {x[0]: x[0] for x in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for s in sigs:
        k = (s["type"], s["rule"], s["sig"])
        a, b = sorted((root(first.setdefault(k, s["id"])), root(s["id"])))
        up[b] = a
    got = {x["id"]: x["master_id"] for x in resolution.masters(df).collect()}
    assert got == {x[0]: f"MTR-{x[1]}-{root(x[0])}" for x in rows}


def test_facets_leave_out_their_own_selection(spark):
    rows = [("a", "x", ["p", "q", "p"], "word one", "20240101"), ("b", "x", ["q"], "word two", ""), ("b", "y", [None, ""], "other", "20240301"), (None, "y", ["p"], "word", "20240201")]
    df = spark.createDataFrame(rows, "k string, s string, m array<string>, haystack string, date_key string")
    c = search.Criteria(filters={"k": ["a"], "s": ["x"]}, text="WORD", date_to="2024-02-15")
    got = {(r[0], r[1]): (r[2], r[3]) for r in search.facet_counts(df, ["k", "s", "m"], c).collect()}
    assert got == {("k", "a"): (1, True), ("k", "b"): (1, False), ("s", "x"): (1, True), ("m", "p"): (1, False), ("m", "q"): (1, False)}
    assert search.matched(df, ["k"], search.Criteria(date_from="2024-01-01")).count() == 3
    assert [r["k"] for r in search.page(df.where("k is not null"), search.Criteria(sort=("date_key", -1), page=9, page_size=2), "k").collect()] == ["b"]


def test_graph_on_a_small_case(spark):
    ents = spark.createDataFrame([(x,) for x in "abcdefz"], "id string")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "d"), ("f", "f"), ("a", "missing")], "src string, dst string")
    assert {r[0]: r[1] for r in graph.degree(ents, links).collect()} == {"a": 2, "b": 2, "c": 2, "d": 2, "e": 2, "f": 0, "z": 0}
    assert {r[0]: r[1] for r in graph.bfs_levels(ents, links, "a").collect()} == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 2, "f": 99, "z": 99}
    assert [r["id"] for r in graph.shortest_path(ents, links, "a", "d").orderBy("pos").collect()] == ["a", "e", "d"]
    assert graph.shortest_path(ents, links, "a", "z").count() == 0
    assert [r["id"] for r in graph.shortest_path(ents, links, "a", "a").collect()] == ["a"]


def test_months_are_filled(spark):
    df = spark.sql("select * from values (date'2024-01-05'), (date'2024-04-01'), (date'2024-04-30'), (null) t(day)")
    months = analytics.month_activity(df, "day")
    assert [(str(r[0]), r[1]) for r in months.orderBy("month").collect()] == [("2024-01-01", 1), ("2024-02-01", 0), ("2024-03-01", 0), ("2024-04-01", 2)]
    assert str(analytics.peak(months).first()["month"]) == "2024-04-01"


def test_entry_and_registry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sheet_and_case_folder(spark, tmp_path):
    from linkforge.sources import sheets

    (tmp_path / "c.csv").write_text('Name,Mobile\n"Ann ""A"" B",07700\n , \nBo,\n')
    assert {r["Name"] for r in sheets.read_sheet(spark, f"file://{tmp_path}/c.csv").collect()} == {'Ann "A" B', "Bo"}
    folder = tmp_path / "case" / "entities"
    folder.mkdir(parents=True)
    for name, body in (("a.json", '{"id": "1"}'), ("bad.json", '{"id": '), ("_skip.json", '{"id": "2"}')):
        (folder / name).write_text(body)
    assert [r["id"] for r in sheets.read_case_folder(spark, f"file://{tmp_path}/case", "id string").collect()] == ["1"]


@pytest.mark.parametrize("name", ["case_summary", "tidy_text", "event_dedup", "stream_activity", "identifier_forms", "grade_codes", "link_styles", "subject_signals", "written_times", "duplicate_people", "canonical_name", "extract_iso_dates", "bfs_levels", "record_diff", "sequence_refs", "report_checks", "effective_share", "structure_errors", "column_kinds"])
def test_query_equals_its_sql(spark, small, name):
    import duckdb

    from linkforge.plans import registry

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = registry.queries()[name](spark, small)
    rel = con.sql(registry.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(got.columns) == cols
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())


def _named(df, word):
    """How often a query's plan names a function: so often it is worked out for a row."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_cue_text_is_made_once_and_by_all_cores(spark, small):
    from linkforge.plans import registry

    notes = spark.createDataFrame([("Armed; on  bail",), ("no cue",), ("",), (None,)], "t string").select(vocabulary.status(F.col("t")).alias("s"), vocabulary.warnings(F.col("t")).alias("w"))
    assert [tuple(r) for r in notes.collect()] == [(["ON_BAIL"], ["FIREARMS"]), ([], []), ([], []), ([], [])]
    assert _named(notes, "regexp_replace(") == 2
    assert registry.queries()["subject_signals"](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_canonical_forms_are_made_once_and_by_all_cores(spark, small):
    from linkforge.plans import registry

    rows = spark.createDataFrame([("ppt 123456a",)], "t string").select(identifiers.identify("passport", F.col("t")).alias("x"))
    assert tuple(rows.first()["x"]) == ("passport", "123456A", True, "PPT 123456A")
    assert _named(rows, "regexp_replace(") == 2 and _named(rows, "regexp_extract(") == 1
    assert registry.queries()["identifier_forms"](spark, small).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 1)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            s, t = sorted((root(a), root(b)))
            up[t] = s
    got = {x[0]: x[1] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in up}


def test_small_tasks_bound_what_a_shuffle_task_takes(spark):
    """Sessions without a size of their own, or with a larger one, get TASK_BYTES; a smaller one stays."""
    from linkforge import session

    size, parts = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {k: spark.conf.get(k, None) for k in (size, parts)}
    try:
        for own, then in ((None, f"{session.TASK_BYTES}b"), ("64MB", f"{session.TASK_BYTES}b"), ("8m", "8m"), ("16k", "16k")):
            spark.conf.unset(size) if own is None else spark.conf.set(size, own)
            session.small_tasks(spark)
            assert spark.conf.get(size) == then
        assert int(spark.conf.get(parts)) >= session.PARTS
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
