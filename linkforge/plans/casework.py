"""Queries of case work over the driver's tables: workflow, dossiers, removals, places and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions import grades
from linkforge.operators import dossier, gazetteer, workflow
from linkforge.plans import views as v
from linkforge.plans.register import query
from linkforge.session import table
from linkforge.sources import exports


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in values)


# --- workflow ------------------------------------------------------------------------------------

_ACTION = "CASE doc_id % 7 WHEN 0 THEN 'SUBMIT' WHEN 1 THEN 'AUTHORISE' WHEN 2 THEN 'REJECT' WHEN 3 THEN 'RETURN_TO_DRAFT' WHEN 4 THEN 'SUPPRESS' WHEN 5 THEN 'LOSE' END"
_REASON = "CASE doc_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'stale' END"
_AT = "CASE WHEN status = 'DRAFT' AND length(urn) % 2 = 0 THEN 'PENDING_AUTH' ELSE status END"
_STEPS = [(s, a, to) for s, moves in workflow.LIFECYCLE.items() for a, to in moves.items()]


@query(f"""WITH t(s, a, after) AS (VALUES {_rows(_STEPS)}), q AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'X' ELSE '' END || 'IR' || doc_id AS urn, {_ACTION} AS action, {_REASON} AS reason FROM documents),
r AS (SELECT urn, {_AT} AS old, n_chars % 2 = 0 AS ready FROM ({v.REPORTS_SQL})),
j AS (SELECT q.*, r.urn IS NOT NULL AS there, r.old, r.ready, t.after FROM q LEFT JOIN r ON r.urn = q.urn LEFT JOIN t ON t.s = r.old AND t.a = q.action),
e AS (SELECT *, CASE WHEN NOT there THEN 'No such report.' WHEN after IS NULL THEN 'Cannot ' || coalesce(action, '') || ' from status ' || old WHEN action = 'AUTHORISE' AND NOT ready THEN 'Not ready to authorise.'
 WHEN action = 'REJECT' AND trim(coalesce(reason, '')) = '' THEN 'Rejection reason required.' WHEN action = 'SUPPRESS' AND trim(coalesce(reason, '')) = '' THEN 'Suppression reason required.' END AS error FROM j)
SELECT urn, action, error IS NULL AS ok, CASE WHEN error IS NULL THEN after ELSE old END AS status, error FROM e""")
def report_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = v.reports(spark, sf_dir).selectExpr("urn", f"{_AT} AS status", "n_chars % 2 = 0 AS ready")
    requests = table(spark, sf_dir, "documents").selectExpr("CASE WHEN doc_id % 11 = 0 THEN 'X' ELSE '' END || 'IR' || doc_id AS urn", f"{_ACTION} AS action", f"{_REASON} AS reason")
    return workflow.apply_actions(reports, requests)


_KINDS = list(workflow.MOVES)
_STATUSES = sorted({s for moves in workflow.MOVES.values() for s in moves} | set(workflow.DONE))
_PICK = lambda names, n: "CASE " + " ".join(f"WHEN {n} % {len(names)} = {i} THEN '{x}'" for i, x in enumerate(names)) + " END"
_RECORD = f"o_orderkey, {_PICK(_KINDS, 'o_orderkey')} AS kind, {_PICK(_STATUSES, '(o_orderkey + o_custkey)')} AS status, {_PICK(_STATUSES, 'o_custkey')} AS wanted"
_ALLOWED = [(k, a, b) for k, moves in workflow.MOVES.items() for a, to in moves.items() for b in to]


@query(f"""WITH r AS (SELECT {_RECORD} FROM orders), m(k, a, b) AS (VALUES {_rows(_ALLOWED)})
SELECT o_orderkey, m.k IS NOT NULL AS allowed, status IN ({", ".join(f"'{x}'" for x in workflow.DONE)}) AS done FROM r LEFT JOIN m ON k = kind AND a = status AND b = wanted""")
def record_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(*_columns(_RECORD))
    return rows.select("o_orderkey", workflow.can_move(F.col("kind"), F.col("status"), F.col("wanted")).alias("allowed"), workflow.is_done(F.col("status")).alias("done"))


def _columns(sql: str) -> list[str]:
    """The expressions of a select list that has no comma inside of one."""
    return [x.strip() for x in sql.split(",")]


_LOCK = """c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'me' ELSE 'them' END AS holder,
CASE WHEN c_custkey % 9 <> 0 THEN TIMESTAMP '2024-01-01 12:00:00' - INTERVAL '1' MINUTE * (c_custkey % 60) END AS taken_at,
CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 END AS base, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 END AS stored"""


@query(f"""WITH l AS (SELECT {_LOCK} FROM customer)
SELECT c_custkey, holder IS NULL OR holder = 'me' OR taken_at IS NULL OR TIMESTAMP '2024-01-01 12:00:00' - taken_at > INTERVAL '30' MINUTE AS may_lock,
 CASE WHEN stored IS NULL THEN 'new' WHEN base IS NULL THEN 'no-base' WHEN base = stored THEN 'unchanged' ELSE 'conflict' END AS saving FROM l""")
def lock_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(*_columns(_LOCK))
    may = workflow.can_lock(F.col("holder"), F.col("taken_at"), F.lit("me"), F.expr("TIMESTAMP '2024-01-01 12:00:00'"))
    return rows.select("c_custkey", may.alias("may_lock"), workflow.conflict(F.col("base"), F.col("stored")).alias("saving"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def newest_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 500 entries of a log: a top-k report."""
    return workflow.newest(table(spark, sf_dir, "events").select("event_id", "ts"), 500, "ts", "event_id").select("event_id")


# --- dossiers and removals -----------------------------------------------------------------------

_NOMINALS = """SELECT 'E' || c_custkey AS id, 'IR' || (c_custkey % 97) AS urn, CASE c_custkey % 5 WHEN 0 THEN 'vehicle' WHEN 1 THEN 'location' WHEN 2 THEN 'note' ELSE 'person' END AS type,
 'L' || (c_custkey % 41) AS label, CASE c_custkey % 3 WHEN 0 THEN 'subject' WHEN 1 THEN '' END AS role, c_custkey % 7 = 0 AS is_alias, CASE WHEN c_custkey % 4 = 0 THEN 'P' || (c_custkey % 50) END AS pnc,
 CASE WHEN c_custkey % 6 = 1 THEN '19' || (50 + c_custkey % 40) || '-01-01' END AS dob, 'M' || (c_custkey % 53) AS master_id FROM customer"""
_TIES = "SELECT 'K' || c_custkey AS id, 'IR' || (c_custkey % 97) AS urn, 'E' || c_custkey AS src, 'E' || (c_custkey + 97 * (c_custkey % 3)) AS dst FROM customer"


def _nominals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = spark.sql(_NOMINALS.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))
    links = spark.sql(_TIES.replace("FROM customer", "FROM {c}"), c=table(spark, sf_dir, "customer"))
    attrs = F.create_map(F.lit("pnc"), F.col("pnc"), F.lit("dob"), F.col("dob"))
    return rows.withColumn("attrs", attrs).drop("pnc", "dob", "master_id"), links, rows.select("id", "master_id")


@query(f"""WITH e AS ({_NOMINALS}), p AS (SELECT * FROM e WHERE type = 'person'), l AS ({_TIES}), n AS (SELECT urn, src AS id, dst AS other FROM l WHERE src <> dst UNION ALL SELECT urn, dst, src FROM l WHERE src <> dst),
f AS (SELECT master_id, urn, 'name' AS heading, label AS value FROM p UNION ALL SELECT master_id, urn, 'role', role FROM p UNION ALL SELECT master_id, urn, 'alias', label FROM p WHERE is_alias
 UNION ALL SELECT master_id, urn, 'pnc', pnc FROM p
 UNION ALL SELECT p.master_id, p.urn, CASE o.type WHEN 'person' THEN 'associate' ELSE o.type END, o.label FROM n JOIN p USING (id, urn) JOIN e o ON o.id = n.other AND o.urn = p.urn WHERE o.type <> 'note')
SELECT master_id, heading, value, min(urn) AS urn FROM f WHERE value <> '' GROUP BY ALL""")
def dossier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.dossier_facts(*_nominals(spark, sf_dir))


@query(f"""WITH p AS (SELECT * FROM ({_NOMINALS}) WHERE type = 'person')
SELECT master_id, arg_min(label, [urn, id]) AS primary_name, arg_min(dob, [urn, id]) FILTER (dob IS NOT NULL) AS dob, count(DISTINCT urn) AS reports, count(*) AS appearances FROM p GROUP BY master_id""")
def dossier_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, _, masters = _nominals(spark, sf_dir)
    return dossier.dossier_heads(entities, masters)


@query(f"""WITH e AS ({_NOMINALS}), l AS ({_TIES}), m AS (SELECT master_id, count(DISTINCT urn) - 1 AS n FROM e GROUP BY master_id),
x AS (SELECT urn, id, count(*) AS links FROM (SELECT urn, src AS id FROM l UNION ALL SELECT urn, dst FROM l WHERE src <> dst) GROUP BY ALL)
SELECT e.id, e.urn, CASE WHEN n > 0 THEN 'detach' ELSE 'delete' END AS action, n AS elsewhere, coalesce(links, 0) AS links FROM e JOIN m USING (master_id) LEFT JOIN x ON x.id = e.id AND x.urn = e.urn""")
def deletion_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dossier.deletion_impacts(*_nominals(spark, sf_dir))


# --- places --------------------------------------------------------------------------------------

# Some postcode areas with their centres.
_AREAS = [("B", 52.49, -1.89), ("BR", 51.40, 0.05), ("E", 51.53, -0.05), ("M", 53.48, -2.24), ("SW", 51.46, -0.17)]
_GAZ = """SELECT n_name AS name, 'country' AS kind, 'C' || n_nationkey AS cc, n_nationkey * 2.5 - 30 AS lat, n_nationkey * 5.5 - 60 AS lon, 'Land ' || n_nationkey AS alias, '' AS iata, CAST(n_nationkey AS INT) AS ord FROM nation
UNION ALL SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' International' ELSE ' Airport' END, 'airport', 'C' || n_nationkey, n_nationkey * 2.5 - 29, n_nationkey * 5.5 - 59, NULL, 'A' || (n_nationkey + 10), CAST(100 + n_nationkey AS INT) FROM nation WHERE n_nationkey % 3 <> 0"""
_ASKED = "CASE c_custkey % 6 WHEN 0 THEN lower(n_name) WHEN 1 THEN n_name || '  AIRPORT' WHEN 2 THEN 'Land ' || n_nationkey WHEN 3 THEN 'Nowhere' WHEN 4 THEN 'Nowhere airport' END"
_POST = "CASE c_custkey % 5 WHEN 0 THEN 'sw1a 1aa' WHEN 1 THEN ' M1 2AB' WHEN 2 THEN 'EX4 4QJ' WHEN 3 THEN 'ZZ1' ELSE 'none' END"
_GAZ_SQL = f"""g AS ({_GAZ}), k AS (SELECT key, arg_min(name, ord) AS name FROM (SELECT lower(name) AS key, name, ord FROM g UNION ALL SELECT lower(alias), name, ord FROM g WHERE alias IS NOT NULL) GROUP BY key),
c AS (SELECT c_custkey, c_name, {_ASKED} AS asked, {_POST} AS post FROM customer JOIN nation ON n_nationkey = c_nationkey),
q AS (SELECT *, regexp_replace(lower(asked), ' +', ' ', 'g') AS f FROM c), w AS (SELECT *, nullif(regexp_extract(f, '^(.+?) airport$', 1), '') AS city FROM q),
found AS (SELECT w.*, coalesce(x.name, CASE WHEN y.name IS NOT NULL THEN coalesce((SELECT arg_min(a.name, a.ord) FROM g a WHERE a.kind = 'airport' AND starts_with(lower(a.name), w.city)), y.name) END) AS place
 FROM w LEFT JOIN k x ON x.key = w.f LEFT JOIN k y ON y.key = w.city)"""


def _gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_GAZ.replace("FROM nation", "FROM {n}"), n=table(spark, sf_dir, "nation"))
    return rows.withColumn("aliases", F.when(F.col("alias").isNotNull(), F.array("alias"))).withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")}).drop("alias")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).selectExpr("c_custkey", "c_name", f"{_ASKED} AS asked", f"{_POST} AS post")


@query(f"WITH {_GAZ_SQL} SELECT c_custkey, place FROM found")
def place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer.lookup(_asked(spark, sf_dir), "asked", _gazetteer(spark, sf_dir)).select("c_custkey", F.col("place.name").alias("place"))


_HASH = lambda x: f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({x}, ''), lambda u: unicode(u)::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296)"
_JIT = lambda x, scale: f"(({_HASH(x)} % 1000) / 1000.0 - 0.5) * {scale}"


@query(f"""WITH {_GAZ_SQL}, a(area, alat, alon) AS (VALUES {", ".join(map(str, _AREAS))}),
z AS (SELECT found.*, upper(regexp_extract(trim(post), '^([A-Za-z]{{1,2}})[0-9]', 1)) AS ar FROM found),
s AS (SELECT z.c_custkey, z.c_name, coalesce(g.lat, x.alat, y.alat)::DOUBLE AS lat, coalesce(g.lon, x.alon, y.alon)::DOUBLE AS lon, CASE WHEN g.name IS NOT NULL THEN 'locality' WHEN x.area IS NOT NULL OR y.area IS NOT NULL THEN 'postcode-area' END AS approx
 FROM z LEFT JOIN g ON g.name = z.place LEFT JOIN a x ON x.area = z.ar LEFT JOIN a y ON length(z.ar) = 2 AND y.area = z.ar[1])
SELECT c_custkey, round(lat + {_JIT("c_name", 0.02)}, 6) AS lat, round(lon + {_JIT("c_name || '|x'", 0.03)}, 6) AS lon, approx FROM s""")
def address_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = spark.createDataFrame(_AREAS, "area string, lat double, lon double")
    out = gazetteer.address_places(_asked(spark, sf_dir), "c_name", "asked", "post", _gazetteer(spark, sf_dir), areas)
    return out.select("c_custkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "approx")


# --- exports -------------------------------------------------------------------------------------

_MORE = f"SELECT *, CASE WHEN id LIKE '%3' THEN 'sheet ' || urn END AS source_ref, substr('123x', CAST(length(id) % 4 + 1 AS INT), 1) AS source, CASE WHEN role IS NULL THEN 'C' END AS assessment, CASE WHEN is_alias THEN 'C' ELSE 'P' END AS handling FROM ({_NOMINALS}) AS n"
_SAID = f"""SELECT *, CAST(substr(id, 2, 20) AS BIGINT) AS ord, CASE length(dst) % 3 WHEN 0 THEN 'OWNS' WHEN 1 THEN 'ASSOCIATE_OF' ELSE 'HINTS_AT' END AS type, CASE WHEN id LIKE '%7' THEN '' WHEN id LIKE '%1' THEN 'They met ' || dst || '.' ELSE src || ' knows ' || dst END AS sentence,
 CASE WHEN src LIKE '%5' THEN true WHEN src LIKE '%6' THEN false END AS negated, CASE WHEN src LIKE '%2' THEN '->' WHEN src LIKE '%3' THEN 'both' END AS direction, CASE WHEN src LIKE '%4' THEN 'high' WHEN src LIKE '%8' THEN 'low' END AS confidence, CASE WHEN src LIKE '%9' THEN 'GBP 5' END AS amount FROM ({_TIES}) AS t"""
_G = lambda s, a, h: f"'[' || CASE WHEN {s} IN ('1', '2', '3') THEN {s} ELSE '2' END || coalesce({a}, 'B') || {h} || ']'"


def _charted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    return spark.sql(_MORE.replace("FROM customer", "FROM {c}"), c=c), spark.sql(_SAID.replace("FROM customer", "FROM {c}"), c=c)


@query(f"""WITH e AS ({_MORE}), l AS ({_SAID}), n AS (SELECT src AS id, dst AS other, sentence, ord FROM l UNION ALL SELECT dst, src, sentence, ord FROM l WHERE src <> dst),
s AS (SELECT n.id, arg_min(p.label, n.ord) AS subject FROM n JOIN e p ON p.id = n.other AND p.type = 'person' GROUP BY n.id), f AS (SELECT id, arg_min(sentence, ord) AS sentence FROM n GROUP BY id),
k AS (SELECT e.*, row_number() OVER (ORDER BY id)::VARCHAR AS n FROM e WHERE type <> 'note')
SELECT 'E' || CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END AS reference, coalesce(subject, CASE WHEN type = 'person' THEN label END, '') AS subject, coalesce(source_ref, 'open source') AS source, label AS entity,
 coalesce(nullif(sentence, ''), 'Charted') || '  ' || {_G("source", "assessment", "handling")} AS result FROM k LEFT JOIN s USING (id) LEFT JOIN f USING (id)""")
def enquiry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.enquiry_log(*_charted(spark, sf_dir))


_META = lambda i, other: "CASE l.type " + " ".join(f"WHEN '{k}' THEN '{m[i]}'" for k, m in grades.LINKS.items() if k in ("OWNS", "ASSOCIATE_OF")) + f" ELSE {other} END"


@query(f"""WITH e AS (SELECT * FROM ({_MORE}) WHERE type <> 'note'), l AS ({_SAID})
SELECT a.label AS end1, b.label AS end2, {_META(0, "l.type")} AS type, {_META(2, "'Association'")} AS meaning, CASE direction WHEN '->' THEN 'End 1 to End 2' WHEN 'both' THEN 'Both' ELSE 'None' END AS direction,
 CASE WHEN negated THEN 'Tentative' ELSE CASE confidence WHEN 'high' THEN 'Confirmed' WHEN 'low' THEN 'Tentative' ELSE 'Unconfirmed' END END AS strength,
 {_META(0, "l.type")} || coalesce(' ' || amount, '') || CASE WHEN negated THEN ' (denied)' ELSE '' END AS label FROM l JOIN e a ON a.id = l.src JOIN e b ON b.id = l.dst""")
def chart_import_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, links = _charted(spark, sf_dir)
    blank = {c: F.lit(None).cast("string") for c in ("e164", "email", "source_text")}
    return exports.chart_links(entities.withColumns(blank), links)


@query(f"""WITH l AS (SELECT ord, coalesce(negated, false) AS denied, sentence FROM ({_SAID}) WHERE sentence <> ''), k AS (SELECT *, row_number() OVER (ORDER BY denied, ord) AS n FROM l)
SELECT n, n || '. ' || CASE WHEN denied THEN '[DENIED/NEGATED — handle with care] ' ELSE '' END || sentence || CASE WHEN sentence LIKE '%.' THEN '' ELSE '.' END || '  ' || CASE WHEN denied THEN '[2EP]' ELSE '[2CP]' END AS line FROM k""")
def report_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.draft_lines(_charted(spark, sf_dir)[1], F.lit("[2CP]"))
