"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.functions import contact, dates, grades, identifiers, names, vocabulary
from linkforge.operators import analytics, columns, graph, matching, mutation, recognise, resolution, search, spans, validation
from linkforge.plans import casework, extraction, resolve  # noqa: F401
from linkforge.plans import views as v
from linkforge.plans.register import QUERIES, SQL, Query
from linkforge.plans.register import query as _query
from linkforge.session import spread, table
from linkforge.streaming import activity

# --- report search -------------------------------------------------------------------------------

FACETS = ["operation", "threat", "status", "marking", "source_types"]
SEARCH = search.Criteria(filters={"threat": ["en", "fr"], "status": ["AUTHORISED", "DRAFT"]}, text="the on", date_to="2024-11-30", sort=("n_chars", -1))
_BASE = f"WITH r AS ({v.REPORTS_SQL}), b AS (SELECT * FROM r WHERE date_key <= '20241130' AND contains(lower(haystack), 'the') AND contains(lower(haystack), 'on'))"
_T, _S = "threat IN ('en', 'fr')", "status IN ('AUTHORISED', 'DRAFT')"


@_query(f"""{_BASE}, f AS (
  SELECT 'operation' AS facet, operation AS value FROM b WHERE {_T} AND {_S}
  UNION ALL SELECT 'threat', threat FROM b WHERE {_S}
  UNION ALL SELECT 'status', status FROM b WHERE {_T}
  UNION ALL SELECT 'marking', marking FROM b WHERE {_T} AND {_S}
  UNION ALL SELECT 'source_types', unnest(list_distinct(source_types)) FROM b WHERE {_T} AND {_S})
SELECT facet, value, count(*) AS cnt, (facet = 'threat' AND value IN ('en', 'fr')) OR (facet = 'status' AND value IN ('AUTHORISED', 'DRAFT')) AS selected
FROM f WHERE value IS NOT NULL AND value <> '' GROUP BY facet, value""")
def facet_counts_excl_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet_counts(v.reports(spark, sf_dir), FACETS, SEARCH)


@_query(f"WITH r AS ({v.REPORTS_SQL}) SELECT urn FROM r WHERE list_has_any(source_types, ['lang-de', 'src3'])")
def facet_multivalue_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matched(v.reports(spark, sf_dir), FACETS, search.Criteria(filters={"source_types": ["lang-de", "src3"], "unknown": ["x"], "status": []})).select("urn")


@_query(f"WITH r AS ({v.REPORTS_SQL}) SELECT urn FROM r WHERE contains(lower(haystack), 'ther') AND contains(lower(haystack), 'ing')")
def text_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matched(v.reports(spark, sf_dir), FACETS, search.Criteria(text=" Ther ING ")).select("urn")


@_query(f"WITH r AS ({v.REPORTS_SQL}) SELECT urn, 'to' AS bound FROM r WHERE date_key <= '20240315' UNION ALL SELECT urn, 'from' FROM r WHERE date_key >= '20240910'")
def date_range_quirk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = v.reports(spark, sf_dir)
    upper = search.matched(r, FACETS, search.Criteria(date_to="2024-03-15")).select("urn", F.lit("to").alias("bound"))
    return upper.unionByName(search.matched(r, FACETS, search.Criteria(date_from="2024-09-10")).select("urn", F.lit("from").alias("bound")))


@_query(f"{_BASE} SELECT operation, count(*) AS cnt, max(CASE marking WHEN 'OFFICIAL' THEN 1 WHEN 'OFFICIAL-SENSITIVE' THEN 2 END)::INT AS highest FROM b WHERE {_T} AND {_S} GROUP BY operation")
def matched_markings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("marking") == "OFFICIAL", 1).when(F.col("marking") == "OFFICIAL-SENSITIVE", 2)
    return search.matched(v.reports(spark, sf_dir), FACETS, SEARCH).groupBy("operation").agg(F.count("*").alias("cnt"), F.max(rank).alias("highest"))


@_query(f"{_BASE} SELECT urn, n_chars FROM b WHERE {_T} AND {_S} ORDER BY n_chars DESC, urn LIMIT 50 OFFSET 50")
def paged_sorted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty: the page is the feature."""
    c = search.Criteria(**{**SEARCH.__dict__, "page": 2})
    return search.page(search.matched(v.reports(spark, sf_dir), FACETS, c), c, "urn").select("urn", "n_chars")


# --- scalars -------------------------------------------------------------------------------------

_MAIL = "CASE c_custkey % 4 WHEN 0 THEN '  User.' || c_custkey || '+tag@GMail.com' WHEN 1 THEN 'a.b' || c_custkey || '+x@Mail.example.ORG ' WHEN 2 THEN 'no at ' || c_custkey ELSE 'q.r' || c_custkey || '@googlemail.com' END"
_PHONE = "CASE c_custkey % 6 WHEN 0 THEN '07700 900' || lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0') WHEN 1 THEN '+34 (612) 345-' || lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0') WHEN 2 THEN '0044 7700 900' || lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0') WHEN 3 THEN CAST(c_custkey AS VARCHAR(20)) WHEN 4 THEN '447700900' || lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0') ELSE '+353 87 123 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR(9)), 4, '0') END"


def _raw(spark: SparkSession, sf_dir: str, expr: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(expr).alias("raw"))


@_query(f"""WITH r AS (SELECT c_custkey, lower(trim({_MAIL})) AS s FROM customer),
p AS (SELECT c_custkey, s, split_part(split_part(s, '@', 1), '+', 1) AS u, split_part(s, '@', 2) AS d, regexp_full_match(s, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AS ok FROM r)
SELECT c_custkey, CASE WHEN NOT ok THEN NULL WHEN d IN ('gmail.com', 'googlemail.com') THEN replace(u, '.', '') || '@gmail.com' ELSE u || '@' || d END AS email FROM p""")
def email_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _MAIL).select("c_custkey", contact.email_canonical(F.col("raw")).alias("email"))


@_query(f"""WITH r AS (SELECT c_custkey, {_PHONE} AS raw FROM customer),
s AS (SELECT c_custkey, regexp_replace(regexp_replace(trim(raw), '[\\s(). -]+', '', 'g'), '^00', '+') AS o FROM r),
d AS (SELECT c_custkey, o, regexp_replace(o, '[^0-9]', '', 'g') AS n FROM s),
e AS (SELECT c_custkey, CASE WHEN starts_with(o, '+') THEN '+' || n WHEN regexp_full_match(n, '07[0-9]{{9}}|0[12][0-9]{{8,9}}|0[89][0-9]{{8,9}}') THEN '+44' || substr(n, 2) WHEN length(n) BETWEEN 9 AND 15 THEN n END AS x FROM d),
f AS (SELECT c_custkey, CASE WHEN length(replace(x, '+', '')) BETWEEN 8 AND 15 THEN x END AS e164 FROM e),
g AS (SELECT c_custkey, e164, CASE WHEN starts_with(e164, '+353') THEN '353' WHEN starts_with(e164, '+44') THEN '44' WHEN starts_with(e164, '+34') THEN '34' END AS cc FROM f)
SELECT c_custkey, e164, cc, coalesce((cc = '44' AND length(e164) = 13) OR (cc = '34' AND length(e164) = 12) OR (cc = '353' AND length(e164) = 13), false) AS valid FROM g""")
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _PHONE).select("c_custkey", contact.phone_e164(F.col("raw")).alias("p")).select("c_custkey", "p.e164", "p.cc", "p.valid")


@_query(f"""WITH r AS (SELECT c_custkey, {_PHONE} AS raw FROM customer), d AS (SELECT c_custkey, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS n FROM r)
SELECT c_custkey, CASE WHEN starts_with(raw, '+') AND starts_with(n, '44') THEN '0' || substr(n, 3) WHEN starts_with(raw, '+') THEN '00' || n WHEN starts_with(n, '0044') THEN '0' || substr(n, 5)
 WHEN starts_with(n, '00') THEN n WHEN starts_with(n, '44') AND length(n) >= 11 THEN '0' || substr(n, 3) WHEN starts_with(n, '0') THEN n ELSE '0' || n END AS phone FROM d""")
def phone_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _PHONE).select("c_custkey", contact.phone_national(F.col("raw")).alias("phone"))


_NAME = "CASE c_custkey % 5 WHEN 3 THEN 'Šimek Nováková-Źdź ' || c_name WHEN 4 THEN 'ĀNNA   Çelik-Ōno' WHEN 0 THEN '  Müller-Lüdenscheid   Limited' WHEN 1 THEN 'ACME ' || c_custkey || ' Public Limited  Company' ELSE c_name || ' Incorporated' END"


@_query(f"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents({_NAME})), '[^a-z\\s''-]', ' ', 'g'), '[\\s''-]+', ' ', 'g')), '\\bpublic limited company\\b', 'plc', 'g'), '\\blimited\\b', 'ltd', 'g'), '\\bincorporated\\b', 'inc', 'g') AS name FROM customer""")
def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _NAME).select("c_custkey", contact.canonical_name(F.col("raw")).alias("name"))


_PAD = "lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR(9)), 6, '0')"
_FAMILIES = {
    "nino": (f"substr('QABGCEZZDT', CAST(c_custkey % 9 AS INT) + 1, 2) || ' ' || {_PAD} || ' c'", identifiers.nino, identifiers.nino_valid),
    "sort_code": (f"CASE WHEN c_custkey % 5 = 0 THEN '12-3' ELSE substr({_PAD}, 1, 2) || '-' || substr({_PAD}, 3, 2) || '-' || substr({_PAD}, 5, 2) END", identifiers.sort_code, identifiers.sort_code_valid),
    "vrm": (f"CASE c_custkey % 3 WHEN 0 THEN 'ab' || substr({_PAD}, 1, 2) || ' cde' WHEN 1 THEN 'VRM A' || c_custkey || 'BCD' ELSE 'toolong' || c_custkey END", identifiers.vrm, identifiers.vrm_format_valid),
    "vin": (f"CASE c_custkey % 2 WHEN 0 THEN 'wvwzzz1jz3w' || {_PAD} ELSE 'OIQ' || {_PAD} || 'AAAAAAAA' END", identifiers.vin, identifiers.vin_valid),
    "company": (f"CASE c_custkey % 4 WHEN 0 THEN '12' || {_PAD} WHEN 1 THEN 'sc' || {_PAD} WHEN 2 THEN 'XX' || {_PAD} ELSE 'R1' || {_PAD} END", identifiers.alnum, identifiers.company_valid),
    "vat": (f"'GB 1' || {_PAD} || substr({_PAD}, 1, 2)", identifiers.sort_code, identifiers.vat_valid),
    "card": (f"'4539 14' || {_PAD} || substr({_PAD}, 3, 4)", identifiers.sort_code, identifiers.luhn),
    "iban": (f"'GB82 WEST 1234 56' || CASE WHEN c_custkey % 3 = 0 THEN '98 7654 32' ELSE {_PAD} || '32' END", identifiers.alnum, identifiers.iban_valid),
    "postcode": (f"CASE c_custkey % 3 WHEN 0 THEN 'sw1a 1aa' WHEN 1 THEN 'M' || CAST(c_custkey % 99 AS VARCHAR(9)) || '2bb' ELSE {_PAD} END", identifiers.postcode, identifiers.postcode_valid),
}


@_query()
def identifier_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's canonical form and check over raw forms made of the customers' keys; the vectors are in the tests."""
    each = [F.struct(F.lit(k).alias("family"), canonical(F.expr(expr)).alias("canonical"), valid(F.expr(expr)).alias("valid")) for k, (expr, canonical, valid) in _FAMILIES.items()]
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(F.array(*each)))


_FORMS = {
    "account": f"CASE c_custkey % 2 WHEN 0 THEN '12-' || (c_custkey % 9999) ELSE 'roll ' || {_PAD} || ' x' END",
    "sortCode": _FAMILIES["sort_code"][0],
    "creditCard": f"'4539 14' || {_PAD} || '99'",
    "cro": f"CASE c_custkey % 3 WHEN 0 THEN 'cro s ' || (c_custkey % 999) || ' / 07 k' WHEN 1 THEN 'CRO ' || (c_custkey % 9999) || '/99X' ELSE 'cro none ' || {_PAD} END",
    "pnc": f"CASE c_custkey % 3 WHEN 0 THEN 'pnc 1999/' || (c_custkey % 9999) || 'a' WHEN 1 THEN '07 / ' || (c_custkey % 99) || ' z' ELSE 'PNC ' || {_PAD} END",
    "nino": _FAMILIES["nino"][0],
    "nib": "CASE c_custkey % 2 WHEN 0 THEN 'nib ' || (c_custkey % 999) || '/24' ELSE 'nib ' || (c_custkey % 999) END",
    "passport": f"CASE c_custkey % 3 WHEN 0 THEN 'ppt 123' || {_PAD} WHEN 1 THEN {_PAD} || 'b' ELSE 'ppt ' || (c_custkey % 99) END",
    "vat": f"'GB 1' || {_PAD} || CASE c_custkey % 2 WHEN 0 THEN '12' ELSE '1' END",
    "hmrc": "'hmrc a/' || (c_custkey % 500)",
    "companiesHouse": f"CASE c_custkey % 3 WHEN 0 THEN 'ch 12' || {_PAD} WHEN 1 THEN 'Companies House sc' || {_PAD} ELSE {_PAD} END",
    "charity": f"CASE c_custkey % 2 WHEN 0 THEN 'charity ' || {_PAD} ELSE 'sc' || (c_custkey % 99) END",
    "engine": "'Engine ' || (c_custkey % 200) || '-x'",
    "icq": "'icq ' || (c_custkey * 31)",
}
_UP, _NUM = "regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g')", "regexp_replace(raw, '[^0-9]', '', 'g')"
_BARE = lambda words: f"regexp_replace({_UP}, '^({words})', '')"
_AT = lambda shape, i: f"regexp_extract(upper(raw), '{shape}', {i})"
_CRO, _PNC, _NIB = r"(S?)\s*([0-9]{1,7})\s*/\s*([0-9]{2})\s*([A-Z])", r"([0-9]{2,4})\s*/\s*([0-9]{1,7})\s*([A-Z])", r"([0-9]{1,6})\s*/\s*([0-9]{2})"
#: By family: canonical form, check over it (c) and the raw text, and free text, in SQL.
_FORMS_SQL = {
    "account": (f"CASE WHEN length({_NUM}) BETWEEN 1 AND 8 THEN lpad({_NUM}, 8, '0') ELSE left({_UP}, 18) END", f"length({_UP}) BETWEEN 1 AND 18", "'AC ' || c"),
    "sortCode": (f"left({_NUM}, 6)", f"length({_NUM}) = 6", "'SC ' || c"),
    "creditCard": (f"left({_NUM}, 18)", f"length({_NUM}) BETWEEN 12 AND 18", "'CC ' || c"),
    "cro": (f"CASE WHEN regexp_matches(upper(raw), '{_CRO}') THEN {_AT(_CRO, 1)} || {_AT(_CRO, 2)} || '/' || {_AT(_CRO, 3)} || {_AT(_CRO, 4)} ELSE {_BARE('SCRO|CRO')} END", "regexp_full_match(c, 'S?[0-9]{1,7}/[0-9]{2}[A-Z]')", "CASE WHEN starts_with(c, 'S') THEN 'SCRO ' ELSE 'CRO ' END || c"),
    "pnc": (f"CASE WHEN regexp_matches(upper(raw), '{_PNC}') THEN CASE WHEN length({_AT(_PNC, 1)}) = 4 THEN right({_AT(_PNC, 1)}, 2) ELSE {_AT(_PNC, 1)} END || '/' || {_AT(_PNC, 2)} || {_AT(_PNC, 3)} ELSE {_BARE('PNC')} END", "regexp_full_match(c, '[0-9]{2}/[0-9]{1,7}[A-Z]')", "'PNC ' || c"),
    "nino": (f"left({_BARE('NINO')}, 9)", "regexp_full_match(c, '[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z][0-9]{6}[A-D]') AND left(c, 2) NOT IN ('BG', 'GB', 'NK', 'KN', 'TN', 'NT', 'ZZ')", r"'NINO ' || regexp_replace(c, '^([A-Z]{2})([0-9]{2})([0-9]{2})([0-9]{2})([A-D])$', '\1 \2 \3 \4 \5')"),
    "nib": (f"CASE WHEN regexp_matches(upper(raw), '{_NIB}') THEN {_AT(_NIB, 1)} || '/' || {_AT(_NIB, 2)} ELSE {_BARE('NIB')} END", "regexp_full_match(c, '[0-9]{1,6}/[0-9]{2}')", "'NIB ' || c"),
    "passport": (f"coalesce(nullif(regexp_extract({_BARE('PPT')}, '[0-9]{{9}}|[0-9]{{6}}[A-Z]'), ''), {_BARE('PPT')})", "regexp_full_match(c, '[0-9]{9}|[0-9]{6}[A-Z]')", "'PPT ' || c"),
    "vat": (f"left({_NUM}, 12)", f"length({_NUM}) IN (9, 12)", "'VAT ' || c"),
    "hmrc": (_BARE("HMRC"), "length(c) >= 4", "'HMRC ' || c"),
    "companiesHouse": (f"left({_BARE('COMPANIESHOUSE|CH')}, 8)", "regexp_full_match(c, '[0-9]{8}|[A-Z]{2}[0-9]{6}')", "'Companies House ' || c"),
    "charity": (_BARE("REGISTEREDCHARITYNUMBER|CHARITY"), "regexp_full_match(c, '[0-9]{6,8}|SC[0-9]{6}')", "'Registered Charity Number ' || c"),
    "engine": (_BARE("ENGINE"), "length(c) >= 3", "'Engine ' || c"),
    "icq": (_NUM, "length(c) >= 5", "'ICQ ' || c"),
}


@_query(" UNION ALL ".join(f"SELECT c_custkey, '{k}' AS family, c AS canonical, {valid} AS valid, {text} AS free_text FROM (SELECT *, {canonical} AS c FROM (SELECT c_custkey, {_FORMS[k]} AS raw FROM customer))" for k, (canonical, valid, text) in _FORMS_SQL.items()))
def identifier_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form, check and free text of fourteen families, all from one scan; the other families have vectors in the tests."""
    each = [identifiers.identify(k, F.expr(expr)) for k, expr in _FORMS.items()]
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", F.inline(F.array(*each)))


_GRADE = "CASE c_custkey % 7 WHEN 0 THEN '9' WHEN 1 THEN '' ELSE CAST(c_custkey % 3 + 1 AS VARCHAR(9)) END", "substr('abcdefz', CAST(c_custkey % 7 AS INT) + 1, 1)", "CASE c_custkey % 3 WHEN 0 THEN 'cond' WHEN 1 THEN 'p' ELSE 'x' END"
_WORDS = lambda values, at: "CASE " + at + "".join(f" WHEN '{k}' THEN '{t}'" for k, t in values.items()) + " END"


@_query(f"""WITH r AS (SELECT c_custkey, {_GRADE[0]} AS s, {_GRADE[1]} AS a, {_GRADE[2]} AS h FROM customer),
g AS (SELECT c_custkey, CASE WHEN left(s, 1) IN ('1', '2', '3') THEN left(s, 1) ELSE '2' END AS s, CASE WHEN upper(a) IN ('A', 'B', 'C', 'D', 'E') THEN upper(a) ELSE 'B' END AS a, CASE WHEN upper(left(h, 1)) IN ('P', 'C') THEN upper(left(h, 1)) ELSE 'P' END AS h FROM r)
SELECT c_custkey, '[' || s || a || h || ']' AS grade, {_WORDS(grades.SOURCES, 's')} || '; ' || {_WORDS(grades.ASSESSMENTS, 'a')} || '; ' || {_WORDS(grades.HANDLING, 'h')} || '.' AS sentence FROM g""")
def grade_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = grades.grade_code(*map(F.expr, _GRADE))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("grade"), grades.grade_sentence(code).alias("sentence"))


@_query(f"""SELECT type, {_WORDS({k: x[0] for k, x in grades.LINKS.items()}, 'type')} AS label, {_WORDS({k: x[1] for k, x in grades.LINKS.items()}, 'type')} AS chart, CASE WHEN dated THEN 'Confirmed' ELSE 'Tentative' END AS strength, count(*) AS cnt
FROM (SELECT type, day IS NOT NULL AS dated FROM ({v.LINKS_SQL})) GROUP BY ALL""")
def link_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How links are drawn: dated ones count as sure, others as doubtful."""
    meta = grades.link_meta(F.col("type"))
    rows = v.links(spark, sf_dir).select("type", meta["label"].alias("label"), meta["chart"].alias("chart"), grades.line_strength(F.when(F.col("day").isNotNull(), "HIGH").otherwise("low")).alias("strength"))
    return rows.groupBy("type", "label", "chart", "strength").agg(F.count("*").alias("cnt"))


_NOTE = "CASE c_custkey % 8 WHEN 0 THEN 'Was WANTED; suspects, armed with a gun.' WHEN 1 THEN 'In Burgundy, on  bail since May' WHEN 2 THEN 'self-harm risk; found-dead cat' WHEN 3 THEN 'supply of drug, knives and a knife' WHEN 4 THEN 'released under investigation (RUI)' WHEN 5 THEN '' WHEN 6 THEN 'No further action: witness ' || c_name ELSE c_name END"
_CUES = " UNION ALL ".join(f"SELECT c_custkey, '{kind}' AS kind, '{code}' AS code FROM t WHERE " + " OR ".join(f"contains(s, '{f}')" for cue in cues for f in vocabulary.cue_forms(cue)) for kind, words in (("status", vocabulary.STATUS), ("warning", vocabulary.WARNINGS)) for code, cues in words.items())


@_query(f"WITH t AS (SELECT c_custkey, ' ' || trim(regexp_replace(lower({_NOTE}), '[^a-z0-9]+', ' ', 'g')) || ' ' AS s FROM customer) {_CUES}")
def subject_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings and warning signals by their cues."""
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), f(F.expr(_NOTE)).alias("codes")) for kind, f in (("status", vocabulary.status), ("warning", vocabulary.warnings))])
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select("c_custkey", F.inline(found)).select("c_custkey", "kind", F.explode("codes").alias("code"))


_TIME = "CASE c_custkey % 6 WHEN 0 THEN 'at ' || (c_custkey % 14) || ':05 pm' WHEN 1 THEN (c_custkey % 26) || ':59:' || lpad(CAST(c_custkey % 70 AS VARCHAR(9)), 2, '0') || ' (zulu)' WHEN 2 THEN '12:' || (10 + c_custkey % 60) || ' AM (Local)' WHEN 3 THEN 'noon' WHEN 4 THEN '7:30' ELSE '9:3' END"


@_query(f"""WITH r AS (SELECT c_custkey, lower({_TIME}) AS s FROM customer),
p AS (SELECT c_custkey, s, regexp_extract(s, '([0-9]{{1,2}}):([0-9]{{2}})(:([0-9]{{2}}))? *([ap]m)?', ['h', 'm', 'x', 'sec', 'ap']) AS g FROM r),
q AS (SELECT c_custkey, TRY_CAST(g.h AS INT) AS h0, TRY_CAST(g.m AS INT) AS m, TRY_CAST(g.sec AS INT) AS sec, g.ap AS ap, regexp_extract(s, '[(](local|zulu|utc|bst|gmt)[)]', 1) AS z FROM p),
t AS (SELECT *, CASE WHEN ap = 'pm' AND h0 < 12 THEN h0 + 12 WHEN ap = 'am' AND h0 = 12 THEN 0 ELSE h0 END AS h FROM q)
SELECT c_custkey, CASE WHEN h IS NULL OR h > 23 OR m > 59 OR coalesce(sec, 0) > 59 THEN '' ELSE lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || coalesce(':' || lpad(CAST(sec AS VARCHAR), 2, '0'), '') || CASE z WHEN '' THEN '' WHEN 'local' THEN ' (Local)' ELSE ' (' || upper(z) || ')' END END AS clock FROM t""")
def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _TIME).select("c_custkey", dates.time_text(F.col("raw")).alias("clock"))


_FIRST = ["Bill", "william", "Ann", "B.", "Jon", "Jonathan", "Katie", "Catherine", "Zoë", "Tomas", "Thomas"]
_LAST = ["Šimek", "Simek", "Richardson", "Richardsen", "O'Neil", "Oneill", "Ng", "Andersson", "Anderson", "Novak", "Ricardson", "de la Cruz", "Cruz"]
_PERSON = f"{_FIRST}[CAST(c_custkey % 11 AS INT) + 1] || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE ' ' || {_LAST}[CAST(c_custkey // 11 % 13 AS INT) + 1] END"
_JW = lambda x, y: f"(CASE WHEN {x} = {y} THEN 1 ELSE jaro_similarity({x}, {y}) + (1 - jaro_similarity({x}, {y})) * 0.1 * CASE WHEN left({x}, 4) = left({y}, 4) AND least(length({x}), length({y})) >= 4 THEN 4 WHEN left({x}, 3) = left({y}, 3) AND least(length({x}), length({y})) >= 3 THEN 3 WHEN left({x}, 2) = left({y}, 2) AND least(length({x}), length({y})) >= 2 THEN 2 WHEN left({x}, 1) = left({y}, 1) THEN 1 ELSE 0 END END)"


@_query(f"""WITH g AS (SELECT unnest(string_split(l, ' ')) AS w, i FROM (SELECT unnest({[x for x in names.NICKNAMES.strip().splitlines()]}) AS l, unnest(range({len(names.NICKNAMES.strip().splitlines())})) AS i)),
n AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(strip_accents({_PERSON.replace("O'Neil", "O''Neil").replace('"', "'")})), '[^a-z\\s''-]', ' ', 'g'), '[\\s''-]+', ' ', 'g')) AS c FROM customer),
t AS (SELECT c, string_split(c, ' ') AS w FROM n WHERE contains(c, ' ')), p AS (SELECT c, w[len(w)] AS s, w[:len(w) - 1] AS f FROM t),
k AS (SELECT a.c AS a, b.c AS b, a.s AS sa, b.s AS sb, unnest(a.f) AS fa, b.f AS bf FROM p a JOIN p b ON a.c < b.c), k2 AS (SELECT * EXCLUDE bf, unnest(bf) AS fb FROM k),
e AS (SELECT a, b, sa, sb, max(CASE WHEN fa = fb THEN 1 WHEN EXISTS (SELECT 1 FROM g x JOIN g y ON x.i = y.i WHERE x.w = fa AND y.w = fb) THEN 0.97 WHEN least(length(fa), length(fb)) = 1 THEN CASE WHEN left(fa, 1) = left(fb, 1) THEN 0.9 ELSE 0 END
  WHEN {_JW('fa', 'fb')} >= 0.92 THEN 0.95 * {_JW('fa', 'fb')} ELSE 0 END::DOUBLE) AS fs FROM k2 GROUP BY a, b, sa, sb),
o AS (SELECT a, b, round(0.62 * (CASE WHEN sa = sb THEN 1 WHEN {_JW('sa', 'sb')} >= 0.94 THEN 0.9 ELSE 0.5 END * {_JW('sa', 'sb')}) + 0.38 * fs, 6) AS score FROM e)
SELECT * FROM o WHERE score >= 0.85""")
def duplicate_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely duplicates among names made of the customers' keys; SQL compares all distinct names with all."""
    first, last = (F.array(*map(F.lit, x)) for x in (_FIRST, _LAST))
    key = F.col("c_custkey")
    name = F.concat(F.get(first, (key % 11).cast("int")), F.when(key % 9 == 0, "").otherwise(F.concat(F.lit(" "), F.get(last, (F.floor(key / 11) % 13).cast("int")))))
    return matching.duplicate_people(table(spark, sf_dir, "customer").select(name.alias("name")))


_D = lambda k: f"CAST(substr(n, {k}, 1) AS INT)"


@_query(f"""WITH r AS (SELECT c_custkey, regexp_replace({_FAMILIES['vat'][0]}, '[^0-9]', '', 'g') AS n FROM customer),
s AS (SELECT c_custkey, {" + ".join(f"{9 - i} * {_D(i)}" for i in range(1, 8)).replace("9 - i", "")} + CAST(substr(n, 8, 2) AS INT) AS t FROM r)
SELECT c_custkey, t % 97 = 0 OR (t + 55) % 97 = 0 AS valid FROM s""")
def vat_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _FAMILIES["vat"][0]).select("c_custkey", identifiers.vat_valid(F.col("raw")).alias("valid"))


@_query(f"""WITH r AS (SELECT c_custkey, regexp_replace({_FAMILIES['card'][0]}, '[^0-9]', '', 'g') AS n FROM customer),
s AS (SELECT c_custkey, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(n[i] AS INT) WHEN CAST(n[i] AS INT) > 4 THEN 2 * CAST(n[i] AS INT) - 9 ELSE 2 * CAST(n[i] AS INT) END)) AS t FROM r)
SELECT c_custkey, t % 10 = 0 AS valid FROM s""")
def luhn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _FAMILIES["card"][0]).select("c_custkey", identifiers.luhn(F.col("raw")).alias("valid"))


# --- analytics and graph -------------------------------------------------------------------------


@_query(f"SELECT type, count(*) AS cnt FROM ({v.ENTITIES_SQL}) GROUP BY type")
def entity_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.entities(spark, sf_dir).groupBy("type").agg(F.count("*").alias("cnt"))


@_query(f"SELECT type, count(*) AS cnt, count(day) AS dated FROM ({v.LINKS_SQL}) GROUP BY type")
def link_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.links(spark, sf_dir).groupBy("type").agg(F.count("*").alias("cnt"), F.count("day").alias("dated"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, and events a year on, so that months between them are empty."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return o.unionByName(table(spark, sf_dir, "events").select(F.add_months(F.to_date("ts"), 12).alias("day")))


_MONTHS = """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT CAST(CAST(ts AS DATE) + INTERVAL 12 MONTH AS DATE) FROM events),
c AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS cnt FROM d GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM c)::TIMESTAMP, (SELECT max(month) FROM c)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month)
SELECT s.month, coalesce(c.cnt, 0) AS cnt FROM s LEFT JOIN c USING (month)"""


@_query(_MONTHS)
def activity_month_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.month_activity(_dated(spark, sf_dir), "day")


@_query(f"SELECT * FROM ({_MONTHS}) ORDER BY cnt DESC, month LIMIT 1")
def peak_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.peak(analytics.month_activity(_dated(spark, sf_dir), "day"))


@_query(f"""WITH v AS (SELECT id FROM ({v.ENTITIES_SQL})), e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({v.LINKS_SQL}) WHERE src <> dst),
n AS (SELECT a AS id FROM e UNION ALL SELECT b FROM e) SELECT v.id, count(n.id) AS degree FROM v LEFT JOIN n ON n.id = v.id GROUP BY v.id""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(v.entities(spark, sf_dir), v.links(spark, sf_dir))


@_query(f"SELECT id FROM ({v.ENTITIES_SQL}) WHERE id NOT IN (SELECT src FROM ({v.LINKS_SQL}) UNION SELECT dst FROM ({v.LINKS_SQL}))")
def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphans(v.entities(spark, sf_dir), v.links(spark, sf_dir)).select("id")


@_query(f"""WITH g AS (SELECT id FROM ({v.ENTITIES_SQL}) WHERE nk IN (3, 7)), l AS (SELECT * FROM ({v.LINKS_SQL}) WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g))
SELECT type AS kind, count(*) AS cnt FROM l GROUP BY type UNION ALL SELECT 'entity', count(*) FROM ({v.ENTITIES_SQL}) WHERE id NOT IN (SELECT id FROM g)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ent = v.entities(spark, sf_dir)
    left, lk = graph.cascade(ent, v.links(spark, sf_dir), ent.where("nk in (3, 7)").select("id"))
    return lk.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("cnt")).unionByName(left.agg(F.count("*").alias("cnt")).select(F.lit("entity").alias("kind"), "cnt"))


@_query("SELECT 'C:' || o_custkey AS src, 'S:' || l_suppkey AS dst, 'TRANSACTED_WITH' AS type, min(l_orderkey * 10 + l_linenumber) AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey")
def link_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    raw = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.concat(F.lit("C:"), "o_custkey").alias("src"), F.concat(F.lit("S:"), "l_suppkey").alias("dst"), F.lit("TRANSACTED_WITH").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph.dedupe_links(raw, v.entities(spark, sf_dir))


@_query(f"""WITH RECURSIVE v AS (SELECT id FROM ({v.ENTITIES_SQL})), e AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM ({v.LINKS_SQL}) WHERE src <> dst), adj AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(id, level) AS (SELECT 'R:1', 0 UNION SELECT DISTINCT adj.b, w.level + 1 FROM w JOIN adj ON adj.a = w.id WHERE w.level < 9)
SELECT v.id, coalesce(min(w.level), 99)::INT AS level FROM v LEFT JOIN w ON w.id = v.id GROUP BY v.id""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all entities and links; its SQL walks nine steps, more than any of these tables has."""
    return graph.bfs_levels(v.entities(spark, sf_dir), v.links(spark, sf_dir), "R:1")


@_query(f"""WITH RECURSIVE {v.PLACES_SQL}, w(id, path) AS (SELECT 'S:1', ['S:1'] UNION SELECT adj.b, list_append(w.path, adj.b) FROM w JOIN adj ON adj.a = w.id WHERE len(w.path) < 4 AND NOT list_contains(w.path, adj.b)),
best AS (SELECT path FROM w WHERE id = (SELECT 'R:' || n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey = 1) ORDER BY len(path), path LIMIT 1)
SELECT (unnest(range(len(path))))::INT AS pos, unnest(path) AS id FROM best""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    region = s.where("s_suppkey = 1").join(n, s["s_nationkey"] == n["n_nationkey"]).first()["n_regionkey"]
    return graph.shortest_path(v.entities(spark, sf_dir), v.links(spark, sf_dir), "S:1", f"R:{region}")


# --- resolution ----------------------------------------------------------------------------------

_PEOPLE = """SELECT 'E' || doc_id AS id, 'IR' || (doc_id % 97) AS urn, CASE doc_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'organisation' WHEN 2 THEN 'vehicle' ELSE 'location' END AS type,
 substr(text, 1, 6) AS label, CAST(1950 + n_chars % 50 AS VARCHAR(9)) AS dob, CASE WHEN n_chars % 3 = 0 THEN 'AB ' || (n_chars % 211) END AS code FROM documents"""
_SIGS = f"""p AS ({_PEOPLE}), q AS (SELECT *, nullif(trim(regexp_replace(lower(label), '\\s+', ' ', 'g')), '') AS nm, lower(replace(code, ' ', '')) AS k FROM p),
sig AS (SELECT id, type, 'name+dob' AS rule, nm || '|' || dob AS sig FROM q WHERE type = 'person' AND nm IS NOT NULL
 UNION ALL SELECT id, type, 'nino', k FROM q WHERE type = 'person' AND k IS NOT NULL
 UNION ALL SELECT id, type, 'companyNumber', k FROM q WHERE type = 'organisation' AND k IS NOT NULL
 UNION ALL SELECT id, type, 'name', nm FROM q WHERE type = 'organisation' AND nm IS NOT NULL
 UNION ALL SELECT id, type, 'vrm', k FROM q WHERE type = 'vehicle' AND k IS NOT NULL
 UNION ALL SELECT id, type, 'postcode', k FROM q WHERE type = 'location' AND k IS NOT NULL
 UNION ALL SELECT id, type, 'type+label', nm FROM q WHERE type IN ('vehicle', 'location') AND k IS NULL AND nm IS NOT NULL)"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("lf_documents")
    rows = spark.sql(_PEOPLE.replace("FROM documents", "FROM lf_documents"))
    key = F.when(F.col("type") == "person", "nino").when(F.col("type") == "organisation", "companyNumber").when(F.col("type") == "vehicle", "vrm").otherwise("postcode")
    return rows.withColumn("attrs", F.create_map(F.lit("dob"), F.col("dob"), key, F.col("code"))).drop("dob", "code")


@_query(f"WITH {_SIGS} SELECT * FROM sig")
def signature_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.signatures(_people(spark, sf_dir))


@_query(f"WITH {_SIGS}, r AS (SELECT DISTINCT urn, sig.type, rule, sig FROM sig JOIN p USING (id)) SELECT b.urn, count(*) AS shared FROM r a JOIN r b ON a.type = b.type AND a.rule = b.rule AND a.sig = b.sig WHERE a.urn = 'IR5' AND b.urn <> 'IR5' GROUP BY b.urn")
def signature_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _people(spark, sf_dir)
    return resolution.overlaps(resolution.signatures(people), people.select("id", "urn"), "IR5")


_WATCH = [("W1", "organisation", "companyNumber", "ab7"), ("W1", "person", "nino", "ab9"), ("W2", "vehicle", "vrm", "ab30"), ("W3", "person", "nino", "none")]


@_query(f"WITH {_SIGS}, w(watch_id, type, rule, sig) AS (VALUES {', '.join(map(str, _WATCH))}) SELECT w.watch_id, count(DISTINCT sig.id) AS hits FROM w LEFT JOIN sig ON sig.type = w.type AND sig.rule = w.rule AND sig.sig = w.sig GROUP BY w.watch_id")
def watchlist_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    watch = spark.createDataFrame(_WATCH, "watch_id string, type string, rule string, sig string")
    return resolution.watch_hits(watch, resolution.signatures(_people(spark, sf_dir)))


@_query()
def master_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked against union-find in the tests: SQL's recursion over these chains is too slow."""
    return resolution.masters(_people(spark, sf_dir))


# --- places --------------------------------------------------------------------------------------

_PLACE = "SELECT c_custkey, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 101 % 36000) / 100.0 - 180 AS lon FROM customer"
_HAV = "2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h))"
_H = "pow(sin(radians(lat - 51.5) / 2), 2) + cos(radians(51.5)) * cos(radians(lat)) * pow(sin(radians(lon + 0.12) / 2), 2)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((c * 37 % 18000) / 100.0 - 90).alias("lat"), ((c * 101 % 36000) / 100.0 - 180).alias("lon"))


@_query(f"WITH p AS ({_PLACE}), q AS (SELECT c_custkey, {_H} AS h FROM p) SELECT c_custkey, round({_HAV}, 6) AS km FROM q WHERE {_HAV} <= 2500")
def haversine_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.within(_places(spark, sf_dir), 51.5, -0.12, 2500).select("c_custkey", F.round("km", 6).alias("km"))


@_query(f"""WITH p AS ({_PLACE}), b AS (SELECT c_custkey, (degrees(atan2(sin(radians(lon + 0.12)) * cos(radians(lat)), cos(radians(51.5)) * sin(radians(lat)) - sin(radians(51.5)) * cos(radians(lat)) * cos(radians(lon + 0.12)))) + 360) AS x FROM p),
c AS (SELECT c_custkey, CASE WHEN x >= 360 THEN x - 360 ELSE x END AS deg FROM b)
SELECT c_custkey, round(deg, 4) AS deg, {analytics.COMPASS}[CAST(floor(deg / 22.5 + 0.5) AS INT) % 16 + 1] AS point FROM c""")
def bearing_compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    deg = analytics.bearing(F.lit(51.5), F.lit(-0.12), F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).select("c_custkey", deg.alias("x")).select("c_custkey", F.round("x", 4).alias("deg"), analytics.compass(F.col("x")).alias("point"))


# --- text twins and records ----------------------------------------------------------------------

_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}"}


def _found(kind: str) -> None:
    # Documents hold no such dates, so each third one ends with two of its own.
    text = "text || CASE WHEN doc_id % 3 = 0 THEN ' due 20' || (10 + doc_id % 20) || '-0' || (1 + doc_id % 9) || '-15, not 2024-1-1 or 1999-12-31.' ELSE '' END" if kind == "iso_date" else "text"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = F.regexp_extract_all(F.expr(text), F.lit(_PATTERNS[kind]), F.lit(0))
        out = table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("value"))
        return out.where(identifiers.ip_valid(F.col("value"))) if kind == "ip" else out

    query.__name__ = f"extract_{kind}s"
    check = " WHERE list_aggregate(list_transform(string_split(value, '.'), lambda o: CAST(o AS INT)), 'max') <= 255" if kind == "ip" else ""
    _query(f"SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all({text}, '{_PATTERNS[kind]}')) AS value FROM documents){check}")(query)


for _k in _PATTERNS:
    _found(_k)


@_query("""SELECT o_orderkey, 'E' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS ref FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)""")
def sequence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running references by owner, padded to four digits at least."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", F.concat(F.lit("E"), F.lpad("n", F.greatest(F.lit(4), F.length("n")), F.lit("0"))).alias("ref"))


@_query("""SELECT u.user_id, count(DISTINCT e.event_type) AS done, CASE count(DISTINCT CASE WHEN e.event_type IN ('click', 'view', 'purchase') THEN e.event_type END) WHEN 0 THEN 'red' WHEN 3 THEN 'green' ELSE 'amber' END AS rag
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e USING (user_id) GROUP BY u.user_id""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many systems cover each subject, and whether all of the core ones do."""
    core = F.array(*map(F.lit, ("click", "view", "purchase")))
    done = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    n = F.size(F.array_intersect("s", core))
    return done.select("user_id", F.size("s").cast("long").alias("done"), F.when(n == 0, "red").when(n == 3, "green").otherwise("amber").alias("rag"))


# --- summaries, tidied text, streams -------------------------------------------------------------


@_query(f"""SELECT 'entities' AS what, count(*) AS cnt FROM ({v.ENTITIES_SQL}) UNION ALL SELECT 'links', count(*) FROM ({v.LINKS_SQL})
UNION ALL SELECT 'dated_links', count(day) FROM ({v.LINKS_SQL}) UNION ALL SELECT 'events', count(*) FROM events""")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = {"entities": v.entities(spark, sf_dir).agg(F.count("*").alias("cnt")), "events": table(spark, sf_dir, "events").agg(F.count("*").alias("cnt"))}
    both = v.links(spark, sf_dir).agg(F.count("*").alias("links"), F.count("day").alias("dated_links"))
    out = both.select(F.expr("stack(2, 'links', links, 'dated_links', dated_links) as (what, cnt)"))
    for name, df in counts.items():
        out = out.unionByName(df.select(F.lit(name).alias("what"), "cnt"))
    return out


@_query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM documents")
def tidy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", contact.tidy(F.col("text")).alias("text"))


@_query("SELECT CAST(ts AS DATE) AS day, event_type AS label, min(event_id) AS event_id FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undated events go; of those with one day and label the first stays."""
    e = table(spark, sf_dir, "events").where("ts is not null")
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("label")).agg(F.min("event_id").alias("event_id"))


@_query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS cnt FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, counted by day and type."""
    kind = table(spark, sf_dir, "events").schema
    arriving = spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = activity.windowed_counts(arriving.where("ts is not null"), "ts", "event_type")
    return activity.drained(counts, "activity").select(F.to_date("start").alias("day"), "event_type", "cnt")


# --- dates, amounts, names -----------------------------------------------------------------------

_DAY = "lpad(CAST(c_custkey % 31 + 1 AS VARCHAR(9)), 2, '0')"
_MON = "lpad(CAST(c_custkey % 13 + 1 AS VARCHAR(9)), 2, '0')"
_YEAR = "CAST(1950 + c_custkey % 80 AS VARCHAR(9))"
_DATE = f"CASE c_custkey % 6 WHEN 0 THEN {_YEAR} || '-' || {_MON} || '-' || {_DAY} WHEN 1 THEN {_DAY} || '/' || {_MON} || '/' || {_YEAR} WHEN 2 THEN {_DAY} || '.' || {_MON} || '.' || substr({_YEAR}, 3, 2) WHEN 3 THEN {_DAY} || ' march ' || {_YEAR} WHEN 4 THEN 'February ' || {_DAY} || ', ' || {_YEAR} ELSE 'soon' END"


@_query(f"""WITH r AS (SELECT c_custkey, {_DATE} AS raw FROM customer),
p AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN try_strptime(raw, '%Y-%m-%d') WHEN 1 THEN try_strptime(raw, '%d/%m/%Y')
 WHEN 2 THEN try_strptime(substr(raw, 1, 6) || CASE WHEN CAST(substr(raw, 7, 2) AS INT) <= 30 THEN '20' ELSE '19' END || substr(raw, 7, 2), '%d.%m.%Y')
 WHEN 3 THEN try_strptime(replace(raw, 'march', '03'), '%d %m %Y') WHEN 4 THEN try_strptime(raw, '%B %d, %Y') END AS t FROM r)
SELECT c_custkey, CAST(t AS DATE) AS day,
 c_custkey % 6 IN (1, 2) AND c_custkey % 31 + 1 <= 12 AND c_custkey % 13 + 1 <= 12 AND c_custkey % 31 <> c_custkey % 13 AS swappable FROM p""")
def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _DATE).select("c_custkey", dates.parse_date(F.col("raw")).alias("day"), dates.day_month_swappable(F.col("raw")).alias("swappable"))


_SUM = "CASE c_custkey % 5 WHEN 0 THEN 'GBP ' || CAST(c_custkey AS VARCHAR(9)) || '.50' WHEN 1 THEN '-$' || CAST(c_custkey AS VARCHAR(9)) WHEN 2 THEN '(1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0') || ' eur)' WHEN 3 THEN 'minus £' || CAST(c_custkey AS VARCHAR(9)) || '.25' ELSE 'nothing' END"


@_query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' END AS code,
CAST(CASE c_custkey % 5 WHEN 0 THEN c_custkey + 0.5 WHEN 1 THEN -c_custkey WHEN 2 THEN -1000 - c_custkey % 1000 WHEN 3 THEN -c_custkey - 0.25 END AS DOUBLE) AS amount FROM customer""")
def written_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dates.parse_amount(F.col("raw"))
    return _raw(spark, sf_dir, _SUM).select("c_custkey", p.alias("p")).select("c_custkey", "p.code", F.col("p.amount").cast("double").alias("amount"))


@_query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'GBP ' || c_custkey || '.50' WHEN 1 THEN 'USD -' || c_custkey WHEN 2 THEN 'EUR -' || (1000 + c_custkey % 1000) WHEN 3 THEN 'GBP -' || c_custkey || '.25' ELSE 'nothing' END AS amount FROM customer""")
def amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, _SUM).select("c_custkey", dates.amount_text(F.col("raw")).alias("amount"))


@_query()
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked by vectors and against all pairs in the tests: DuckDB's Jaro rounds half transpositions down."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(names.name_similarity("p_name", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_type"))), 6).alias("score"))


# --- records: upserts, merges, differences -------------------------------------------------------

_AMENDED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 5 < 2"


def _amended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    status, cust = F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    return o, o.where("o_orderkey % 5 < 2").select("o_orderkey", status.alias("o_orderstatus"), cust.alias("o_custkey"))


@_query(f"SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_AMENDED})) UNION ALL {_AMENDED}")
def record_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.upsert(*_amended(spark, sf_dir), "o_orderkey")


@_query(f"""WITH n AS ({_AMENDED}), j AS (SELECT o.o_orderkey, o.o_orderstatus AS s, o.o_custkey AS c, n.o_orderstatus AS s2, n.o_custkey AS c2 FROM orders o LEFT JOIN n USING (o_orderkey))
SELECT o_orderkey, 'o_orderstatus' AS field, s AS before, s2 AS after FROM j WHERE s IS DISTINCT FROM s2
UNION ALL SELECT o_orderkey, 'o_custkey', CAST(c AS VARCHAR), CAST(c2 AS VARCHAR) FROM j WHERE c IS DISTINCT FROM c2""")
def record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against the amended ones: a record on one side only differs in each field that it has."""
    old, new = _amended(spark, sf_dir)
    return mutation.field_diff(old, new, "o_orderkey", ["o_orderstatus", "o_custkey"])


_MASTERS = f"SELECT id, CASE WHEN nk IS NULL OR id LIKE 'N:%' THEN id ELSE 'MTR-' || nk END AS master_id FROM ({v.ENTITIES_SQL})"


def _masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("nk").isNull() | F.col("id").startswith("N:")
    return v.entities(spark, sf_dir).select("id", F.when(own, F.col("id")).otherwise(F.concat(F.lit("MTR-"), "nk")).alias("master_id"))


@_query(f"WITH m AS ({_MASTERS}) SELECT DISTINCT a.master_id AS src, b.master_id AS dst, l.type FROM ({v.LINKS_SQL}) l JOIN m a ON a.id = l.src JOIN m b ON b.id = l.dst WHERE a.master_id <> b.master_id")
def links_to_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation.remap_links(v.links(spark, sf_dir), _masters(spark, sf_dir))


@_query(f"""WITH m AS ({_MASTERS}), a AS (SELECT 'C:' || c_custkey AS id, unnest(['segment', 'phone']) AS key, unnest([CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, 'n' || c_custkey]) AS value FROM customer)
SELECT master_id, key, arg_min(value, id) AS value FROM a JOIN m USING (id) WHERE value <> '' GROUP BY master_id, key""")
def master_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pair = lambda k, x: F.struct(F.lit(k).alias("key"), x.alias("value"))
    both = F.array(pair("segment", F.when(key % 2 == 0, F.col("c_mktsegment")).otherwise("")), pair("phone", F.concat(F.lit("n"), key)))
    return mutation.merge_attributes(c.select(F.concat(F.lit("C:"), key).alias("id"), F.inline(both)), _masters(spark, sf_dir))


@_query(f"""WITH m AS (SELECT id, CASE WHEN id LIKE 'S:%' AND CAST(substr(id, 3) AS INT) % 2 = 0 THEN 'S:' || (CAST(substr(id, 3) AS INT) - 1) ELSE id END AS t FROM ({v.ENTITIES_SQL}))
SELECT DISTINCT a.t AS src, b.t AS dst, l.type FROM ({v.LINKS_SQL}) l JOIN m a ON a.id = l.src JOIN m b ON b.id = l.dst WHERE a.t <> b.t""")
def merged_entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second supplier merged into the one before it."""
    key = F.col("s_suppkey")
    pairs = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S:"), (key - 1).cast("string")).alias("keep"), F.concat(F.lit("S:"), key.cast("string")).alias("drop"))
    return mutation.merge_entities(v.entities(spark, sf_dir), v.links(spark, sf_dir), pairs)[1]


# --- positions, grouping sets, brokers -----------------------------------------------------------


@_query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM events""")
def nearest_click_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans.nearest_before(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "click", "event_id")
    return rows.select("event_id", "nearest")


_SPANS = "SELECT l_orderkey AS g, CAST(l_linenumber * 7 % 20 AS INT) AS s, CAST(l_linenumber * 7 % 20 + l_quantity % 9 + 1 AS INT) AS e, l_linenumber % 2 AS side FROM lineitem"


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("l_linenumber") * 7 % 20
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), n.cast("int").alias("s"), (n + F.col("l_quantity") % 9 + 1).cast("int").alias("e"), (F.col("l_linenumber") % 2).alias("side"))
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


@_query(f"WITH r AS ({_SPANS}) SELECT i.g, i.s, i.e, o.s AS outer_s, o.e AS outer_e FROM r i JOIN r o ON i.g = o.g AND o.s <= i.s AND i.e <= o.e WHERE i.side = 0 AND o.side = 1")
def spans_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.contained(*_spans(spark, sf_dir), "g")


@_query(f"WITH r AS ({_SPANS}) SELECT g, s, e FROM r i WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM r o WHERE o.side = 1 AND o.g = i.g AND i.s < o.e AND o.s < i.e)")
def spans_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.free_of(*_spans(spark, sf_dir), "g")


@_query(f"SELECT type, day IS NOT NULL AS dated, count(*) AS cnt FROM ({v.LINKS_SQL}) GROUP BY GROUPING SETS ((type), (day IS NOT NULL))")
def chart_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by type, and by whether they are dated, in one pass."""
    rows = v.links(spark, sf_dir).select("type", F.col("day").isNotNull().alias("dated"))
    return rows.groupingSets([[F.col("type")], [F.col("dated")]], "type", "dated").agg(F.count("*").alias("cnt"))


@_query()
def brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of all entities over all links; a tree's closed form and small graphs with cycles are in the tests."""
    return graph.betweenness(v.entities(spark, sf_dir), v.links(spark, sf_dir))


@_query("""SELECT l_orderkey, arg_max(src, [src * 10 + rk, -l_linenumber])::INT AS source, arg_max(substr('ABCDE', rk, 1), [src * 10 + rk, -l_linenumber]) AS intel
FROM (SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 3 + 1 AS INT) AS src, CAST(l_partkey % 5 + 1 AS INT) AS rk FROM lineitem) GROUP BY l_orderkey""")
def report_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit("ABCDE"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3 + 1).cast("int").alias("source"), letter.alias("intel"))
    return analytics.worst_item(items, "l_orderkey", "source", "intel", "l_linenumber")


@_query("SELECT user_id, max((event_type = 'click')::INT) AS click, max((event_type = 'view')::INT) AS view, max((event_type = 'purchase')::INT) AS purchase FROM events GROUP BY user_id")
def coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.coverage(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "purchase"])


@_query(f"""WITH l AS (SELECT src, dst, coalesce(CAST(day AS VARCHAR), '') AS ord FROM ({v.LINKS_SQL})), e AS (SELECT src AS id, dst AS other, ord FROM l UNION ALL SELECT dst, src, ord FROM l)
SELECT e.id, v.type, arg_min(e.other, [e.ord, e.other]) AS other FROM e JOIN ({v.ENTITIES_SQL}) v ON v.id = e.other GROUP BY e.id, v.type""")
def first_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Undated links come first, as nulls do.
    return graph.first_linked(v.entities(spark, sf_dir), v.links(spark, sf_dir).withColumnRenamed("day", "ord"))


# --- checks of reports, shares, columns of sheets ------------------------------------------------

_REPORT = {
    "title": "CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END",
    "date_of_collection": "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '2024-01-01' ELSE '01/02/2024' END",
    "submitted_by_self": "CASE WHEN c_custkey % 13 <> 0 THEN true END",
    "threat_area": "CASE c_custkey % 5 WHEN 0 THEN 'weather' ELSE 'drugs' END",
    "confidence": "CASE c_custkey % 6 WHEN 0 THEN 'high' ELSE 'High' END",
    "protective_marking": "CASE c_custkey % 8 WHEN 0 THEN NULL ELSE 'OFFICIAL' END",
    "code": "CASE c_custkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'P' WHEN 2 THEN 'x' ELSE 'C' END",
    "instructions": "CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'ask first' END",
    "action_code": "CASE c_custkey % 2 WHEN 0 THEN 'A1' ELSE CASE c_custkey % 5 WHEN 1 THEN 'A9' ELSE '' END END",
    "sanitisation_code": "CASE c_custkey % 3 WHEN 0 THEN 'S2' END",
    "status": "CASE c_custkey % 17 WHEN 0 THEN 'LOST' ELSE 'DRAFT' END",
}
_R_SQL = f"r AS (SELECT c_custkey, {', '.join(f'{e} AS {k}' for k, e in _REPORT.items())} FROM customer)"
_WRONG = {
    "title": "trim(title) = ''",
    "dateOfCollection": "date_of_collection IS NULL OR NOT regexp_full_match(date_of_collection, '[0-9]{2}/[0-9]{2}/[0-9]{4}')",
    "submittedBySelf": "submitted_by_self IS NULL",
    "threatArea": "threat_area <> 'drugs'",
    "confidence": "confidence <> 'High'",
    "protectiveMarking": "protective_marking IS NULL",
    "handling.code": "upper(code) NOT IN ('P', 'C')",
    "handling.instructions": "upper(code) = 'C' AND instructions = ''",
    "handling.actionCode": "(upper(code) = 'C' AND action_code <> 'A1') OR (upper(code) = 'P' AND action_code <> '')",
    "handling.sanitisationCode": "(upper(code) = 'C' AND sanitisation_code IS NULL) OR (upper(code) = 'P' AND sanitisation_code IS NOT NULL)",
    "items": "c_custkey % 9 = 0",
    "items[0].text": "c_custkey % 9 <> 0 AND c_custkey % 4 = 0",
    "items[0].sourceEval": "c_custkey % 9 <> 0 AND c_custkey % 10 = 0",
    "items[0].intelEval": "c_custkey % 9 <> 0 AND c_custkey % 10 = 1",
    "provenance.intelEval": "c_custkey % 19 = 0",
    "status": "status = 'LOST'",
}


@_query(f"WITH {_R_SQL} " + " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS field FROM r WHERE {w}" for k, w in _WRONG.items()))
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing or wrong in reports made of the customers' keys."""
    k = F.col("c_custkey")
    item = F.struct(F.when(k % 4 == 0, " ").otherwise("seen").alias("text"), F.when(k % 10 == 0, "4").otherwise("2").alias("source_eval"), F.when(k % 10 == 1, "F").otherwise("B").alias("intel_eval"))
    given = F.struct(F.lit("told").alias("text"), F.lit("1").alias("source_eval"), F.when(k % 19 != 0, "A").alias("intel_eval"))
    rows = table(spark, sf_dir, "customer").withColumns({n: F.expr(e) for n, e in _REPORT.items()} | {"items": F.when(k % 9 != 0, F.array(item)), "provenance": given})
    return rows.select("c_custkey", F.explode(validation.report_errors(["DRAFT", "AUTHORISED"], ["drugs"])).alias("field"))


_SHARES = f"SELECT id, CASE abs(length(id) * 7 + coalesce(nk, 1)) % 4 WHEN 0 THEN 'No' WHEN 1 THEN NULL ELSE 'Yes' END AS share, coalesce(nk, 0) % 9 = 4 AS is_alias FROM ({v.ENTITIES_SQL})"
_LINKED = f"SELECT src || '>' || dst || type AS id, src, dst, type, CASE WHEN length(src || dst) % 3 = 0 THEN 'No' ELSE 'Yes' END AS share FROM ({v.LINKS_SQL})"


def _shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mark, nk = F.abs(F.length("id") * 7 + F.coalesce("nk", F.lit(1))) % 4, F.coalesce("nk", F.lit(0))
    ent = v.entities(spark, sf_dir).select("id", F.when(mark == 0, "No").when(mark != 1, "Yes").alias("share"), (nk % 9 == 4).alias("is_alias"))
    lk = v.links(spark, sf_dir).select(F.concat("src", F.lit(">"), "dst", "type").alias("id"), "src", "dst", "type", F.when(F.length(F.concat("src", "dst")) % 3 == 0, "No").otherwise("Yes").alias("share"))
    return ent, lk


@_query(f"""WITH e AS (SELECT id, coalesce(share = 'Yes', false) AND NOT is_alias AS ok FROM ({_SHARES})), l AS ({_LINKED})
SELECT 'entity' AS kind, id, ok AS share, false AS blocked FROM e
UNION ALL SELECT 'link', l.id, l.share = 'Yes' AND a.ok AND b.ok, l.share = 'Yes' AND NOT (a.ok AND b.ok) FROM l JOIN e a ON a.id = l.src JOIN e b ON b.id = l.dst""")
def effective_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.effective_share(*_shared(spark, sf_dir))


@_query(f"""WITH e AS ({_SHARES}), l AS ({_LINKED}), j AS (SELECT l.id, l.type, l.src, l.dst, a.is_alias AS x, b.is_alias AS y FROM l LEFT JOIN e a ON a.id = l.src AND a.id <> 'N:3' LEFT JOIN e b ON b.id = l.dst AND b.id <> 'N:3')
SELECT id, 'from unknown' AS error FROM j WHERE x IS NULL UNION ALL SELECT id, 'to unknown' FROM j WHERE y IS NULL UNION ALL SELECT id, 'alias to alias' FROM j WHERE type = 'LOCATED_IN' AND x AND y
UNION ALL SELECT id, 'more than one identity' FROM (SELECT unnest([src, dst]) AS id FROM l WHERE type = 'LOCATED_IN') WHERE id IN (SELECT id FROM e WHERE is_alias AND id <> 'N:3') GROUP BY id HAVING count(*) > 1""")
def structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nation is left out of the entities; LOCATED_IN stands for a link of identity."""
    ent, lk = _shared(spark, sf_dir)
    return validation.structure_errors(ent.where("id <> 'N:3'"), lk, ["LOCATED_IN"])


_CELLS = {
    "mail": "CASE WHEN c_custkey % 10 = 3 THEN 'none' ELSE 'u' || c_custkey || '@example.org' END",
    "tel": "CASE WHEN c_custkey % 3 = 0 THEN 'ask' ELSE '07700 900' || lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0') END",
    "born": "CASE c_custkey % 2 WHEN 0 THEN '2024-01-0' || (c_custkey % 9 + 1) ELSE '1/2/' || (1950 + c_custkey % 50) END",
    "who": "CASE c_custkey % 4 WHEN 0 THEN 'Ann Oneil' WHEN 1 THEN 'NOVAK, Jan' WHEN 2 THEN '' ELSE 'FRANCE' END",
    "paid": "CASE c_custkey % 2 WHEN 0 THEN '$ ' || c_custkey || '.50' ELSE 'free' END",
    "blank": "CAST(NULL AS VARCHAR(9))",
}
_KIND = r"""CASE WHEN regexp_full_match(x, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'email' WHEN regexp_full_match(x, '[£€$] ?[0-9][0-9,]*(\.[0-9]{1,2})?') THEN 'money'
WHEN regexp_full_match(x, '[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN regexp_full_match(x, '0[0-9 ]{9,}') THEN 'phone' WHEN lower(x) IN (SELECT lower(n_name) FROM nation) THEN 'location'
WHEN regexp_full_match(x, '[A-Z][a-z]+ [A-Z][A-Za-z''-]+|[A-Z][A-Z''-]+,? [A-Z][a-z]+') THEN 'person' END"""


@_query(f"""WITH c AS ({" UNION ALL ".join(f"SELECT '{k}' AS name, c_custkey AS ord, trim({e}) AS x FROM customer" for k, e in _CELLS.items())}),
f AS (SELECT name, x FROM c WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) <= 50), n AS (SELECT name, {_KIND} AS kind, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT name, arg_max(kind, [n, -list_position({columns.TIES}, kind)]) FILTER (kind IS NOT NULL) AS kind, max(n) FILTER (kind IS NOT NULL) / sum(n) AS share FROM n GROUP BY name)
SELECT k.name, CASE WHEN share >= 0.5 THEN kind ELSE 'text' END AS kind, CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.5 THEN 'med' ELSE 'low' END AS confidence FROM (SELECT unnest({list(_CELLS)}) AS name) k LEFT JOIN b USING (name)""")
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote of a sheet's first fifty filled cells: the sample is the feature."""
    sheet = table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(e).alias(k) for k, e in _CELLS.items()])
    places = [r[0] for r in table(spark, sf_dir, "nation").select(F.lower("n_name")).collect()]  # one row a nation
    return columns.column_kinds(sheet, "c_custkey", list(_CELLS), places)


@_query()
def typed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, contacts, money and names in all documents; checked on planted texts and by a plain sweep in the tests."""
    return recognise.typed_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
