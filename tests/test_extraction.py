"""Claims, names of a dictionary, clauses and relations, against plain scans and planted sentences."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkforge.functions import contact
from linkforge.operators import claims, clauses, dictionary

NAMES = ["malaga", "seville", "bristol", "lisbon", "new york", "york", "new york city"]


def claimed(text, names=(), towns=(), dropped=()):
    table = claims.passes(list(names), list(towns))
    found = [{"nth": n, "kind": p.kind, "s": f.s, "e": f.e, "raw": text[f.s : f.e], "value": f.value, "note": f.note, "again": f.again} for n, p in enumerate(table) for f in list(p.look(text, claims._R[p.shape]))[: 1 if p.once else None] if p.kind not in dropped]
    return claims.stand(found, table), found, table


def test_ledger_equals_a_plain_list():
    r = random.Random(1)
    for _ in range(300):
        ledger, held = claims.Ledger(), []
        for _ in range(40):
            s = r.randrange(60)
            e = s + r.randrange(1, 9)
            assert ledger.free(s, e) == (not any(a < e and s < b for a, b in held))
            if r.random() < 0.5:
                ledger.claim(s, e)
                held.append((s, e))


def test_passes_equal_a_plain_sweep_on_texts_that_overlap():
    r = random.Random(2)
    bits = ["12/03/2024", "+44 7700 900123", "geoff@mail.com", "IMEI 356807058241332", "passport 503842156", "SAR 07700900123", "account 41028833, sort code 09-01-26", "NINO AB 12 34 56 C", "AB12 XYZ", "black BMW", "the BMW",
            "£1,200", "2024 GBP", "5 May 2023", "last Tuesday", "14 Acacia Avenue, Bristol BS5 9TY", "10.0.0.1", "Geoff BAINES", "PNR K7T2QL", "XX-AB", "[2 A P]", "IBAN GB29NWBK60161331926819", "New York City", "Malaga airport", "2023-04-05", "07700 900 456", " ", "\n", "ref 12/345678-9", "0x" + "a1" * 20]
    for _ in range(200):
        text = "".join(r.choice(bits) + r.choice([" ", ", ", "", "\n"]) for _ in range(r.randrange(1, 12)))
        got, found, table = claimed(text, NAMES, ["bristol"])
        held, want, seen = [], [], []
        for f in found:
            p = table[f["nth"]]
            if p.asks and any(a < f["e"] and f["s"] < b for a, b in held):
                continue
            if p.claims:
                held.append((f["s"], f["e"]))
            if f["kind"] == "vehicle" and f["again"] and any(f["value"].upper() in v for v in seen):
                continue
            if f["kind"] == "vehicle":
                seen.append(f"{f['note']} {f['value']}".upper())
            want.append(f)
        assert got == want
        solid = sorted((f["s"], f["e"]) for f in got if table[f["nth"]].claims and table[f["nth"]].asks)
        assert all(a[1] <= b[0] for a, b in zip(solid, solid[1:]))


@pytest.mark.parametrize(("text", "want"), [
    ("Seen 31/12/2024 and 12/31/2024, 99/99/2024.", [("date", "2024-12-31", ""), ("date", "2024-12-31", "")]),
    ("On 03/04/2024 or March 5th, 2024 or 6 April 2024 or 2024-07-08.", [("date", "2024-04-03", "day or month"), ("date", "2024-03-05", ""), ("date", "2024-04-06", ""), ("date", "2024-07-08", "")]),
    ("tags XX-ABC graded [ 2 · A · P ] and [1 B C]", [("tag", "XX-ABC", ""), ("grading", "2AP", "")]),
    ("PNR K7T2QL but locator ABCDEF", [("booking", "K7T2QL", "")]),
    ("passport number 503842156 (Spain) CRO 123456/04A PNC ID 04/1234567B", [("passport", "503842156 Spain", ""), ("cro", "123456/04A", ""), ("pnc", "04/1234567B", "")]),
    ("SC 123456 AC 98765432 SC 12AB56", [("account", "123456", "sort code"), ("account", "98765432", "account")]),
    ("sort code 09-01-26 a/c 41028833; account 41028833, sort code 09-01-26; Barclays a/c ending 4421; account no. 1234567", [("account", "09012641028833", "account"), ("account", "09012641028833", "account"), ("account", "Barclays4421", "account"), ("account", "1234567", "account")]),
    ("lives at 14 Acacia Avenue, Bristol BS5 9TY and works.\nCrown Court.\nBaker Street, London", [("address", "14 Acacia Avenue, Bristol BS5 9TY", ""), ("address", "Baker Street, London", "doubtful")]),
    ("Address: 14 BRACKENFIELD ROAD, STOCKPORT, SK4 2RH", [("address", "14 BRACKENFIELD ROAD, STOCKPORT, SK4 2RH", "")]),
    ("a black BMW, registration VK21 ABC, then the BMW and a white van", [("vehicle", "VK21ABC", "black BMW"), ("vehicle", "van", "white")]),
    ("4,980\nGBP and 2024 GBP, GBP 24, 1500 GBP, £5k", [("money", "1500 GBP", ""), ("money", "£5k", "")]),
    ("Development Geoff BAINES met Mary-Jane O'NEIL LTD at Malaga airport", [("person", "Geoff BAINES", ""), ("person", "Mary-Jane O'NEIL", ""), ("place", "Malaga airport", "airport")]),
    (None or "", []),
])
def test_claims_of_planted_texts(text, want):
    got = [(f["kind"], f["value"], f["note"]) for f in claimed(text, ["malaga"], [], ("relative",))[0]]
    assert sorted(got) == sorted(want)


def test_claims_as_a_query(spark):
    rows = [(1, "Call 020 7946 0958 yesterday or last Tuesday, next friday, this morning, next month. u+x@Googlemail.com", "x"), (2, None, "x"), (3, "", "x"), (1, "nothing", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string").withColumn("day", F.to_date(F.lit("2024-05-15")))
    got = [(r["doc_id"], r["kind"], r["value"]) for r in claims.claims(df.drop("found"), "text", F.col("day")).collect()]
    assert sorted(got) == sorted([(1, "phone", "+442079460958"), (1, "relative", "2024-05-14"), (1, "relative", "2024-05-14"), (1, "relative", "2024-05-17"), (1, "relative", "2024-05-15"), (1, "relative", "2024-06-14"), (1, "email", "u@gmail.com")])
    assert claims.claims(df.where("false").drop("found"), "text").count() == 0
    assert not [k for _, k, _ in [(r["doc_id"], r["kind"], r["value"]) for r in claims.claims(df.drop("found"), "text").collect()] if k == "relative"]


BITS = ["12/03/2024", "+44 7700 900123", "geoff@mail.com", "IMEI 356807058241332", "passport 503842156 (Spain)", "SAR 07700900123", "account 41028833, sort code 09-01-26", "s/c 09-01-26 a/c 41028833", "NINO AB 12 34 56 C", "AB12 XYZ", "black BMW", "the BMW", "a White VAN",
        "£1,200", "2024 GBP", "5 May 2023", "last Tuesday", "YESTERDAY", "14 Acacia Avenue, Bristol BS5 9TY", "10.0.0.1", "Geoff BAINES", "PNR K7T2QL", "XX-AB", "[2 A P]", "[2 · B · C]", "IBAN GB29NWBK60161331926819", "New York City", "Malaga airport", "2023-04-05", "07700 900 456", " ", "\n", "\x0b", "\x1c", "\u00a0",
        "ref 12/345678-9", "case 07700-900-456", "0x" + "a1" * 20, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "é", "İ", "ı", "\u0661\u0662/03/2024", "•", "’", "Seán O’NEIL", "x", "1", "A", "-", "UTR 12345 67890", "CRO 123456/04A", "PNC ID 04/1234567B", "AC 98765432", "account no. 1234567", "Barclays a/c ending 4421", "Co No 01234567", "to\u212adayſ", "naïve"]


def mixed(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) + r.choice([" ", ", ", "", "", "\n"]) for _ in range(r.randrange(0, 9))) for _ in range(n)] + [None, ""]


def test_shapes_found_by_arrow_equal_those_found_text_by_text():
    table, texts = claims.passes(NAMES, ["bristol"]), mixed(3000, 5)
    got = {}
    for nth, p, which, gaps in claims.looked_for(pa.array(texts), table):
        for k, i in enumerate(which):
            shape = claims._R[p.shape]
            if gaps is not None:
                shape = claims.Known(shape)
                shape.gaps = gaps[k]
            if found := list(p.look(texts[i], shape)):
                assert (i, nth) not in got
                got[i, nth] = found
    want = {(i, nth): found for i, t in enumerate(texts) if t for nth, p in enumerate(table) if (found := list(p.look(t, claims._R[p.shape])))}
    assert got == want and {nth for _, nth in want} == set(range(34))
    _, _, which, _ = next(x for x in claims.looked_for(pa.array(["nothing of note £5"] * 50), table) if x[1].kind == "money")
    assert len(which) == 50 and [x[1].kind for x in claims.looked_for(pa.array(["nothing of note £5"] * 50), table)] == ["place", "money"]


def test_caseless_shapes_equal_those_that_ignore_case():
    r = random.Random(6)
    bits = ["REF", "ref", "Reference ", "case", "SAR", "sar ", "UTR", "utr no ", "Passport ", "national  insurance", "x", " ", "-", "/", "1234", "AB-2024", "\n", "é", "Red", "navy", "MERCEDES-benz", "land Rover", "ſ", "CO. NO. ", "vat\nGB"]
    for _ in range(4000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(0, 7)))
        shapes = [*claims._NO_PHONE, (0, claims._NO_PHONE_WITH), (0, claims._NO_PHONE_NEAR), (0, claims._COLOUR), (0, claims._MAKE)]
        for _, c in shapes:
            plain = re.compile(f"(?i){c.shape.pattern.removeprefix('(?i)')}")
            assert c.found(text) == bool(plain.search(text))
            assert c.last(text) == ([m[0] for m in plain.finditer(text)] or [None])[-1]
        if text.isascii() and any(c.found(text) for _, c in claims._NO_PHONE):
            assert claims._NO_PHONE_WORDS.search(text.lower())


def test_claims_of_many_texts_equal_those_of_each(spark):
    texts = mixed(300, 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {}
    for x in claims.claims(df, "text", F.lit("2024-05-15").cast("date"), ["new york city", "york"], ["bristol"]).collect():
        got.setdefault(x["doc_id"], []).append((x["kind"], x["s"], x["e"], x["raw"], x["note"]))
    kept = {r["doc_id"]: r for r in claims.claimed(df, "text", F.lit("2024-05-15").cast("date"), ["new york city", "york"], ["bristol"]).collect()}
    for i, t in enumerate(texts):
        assert kept[i]["text"] == t and [(f["kind"], f["s"], f["e"], f["raw"], f["note"]) for f in kept[i]["found"]] == got.get(i, [])
        if t and "7700" not in t and "+" not in t:  # phones without a canonical form fall
            stands, _, _ = claimed(t, ["new york city", "york"], ["bristol"])
            assert [(f["kind"], f["s"], f["e"], f["raw"], f["note"]) for f in sorted(stands, key=lambda f: f["s"])] == got.get(i, [])


def test_e164_alone_equals_that_of_the_struct(spark):
    numbers = [None, "", "07700 900123", "+44 (0)7700-900123", "0044 7700 900123", "00 1 202 555 0100", "12345678", "123456789", "+1234567", "+12345678", "1234567890123456", "020 7946 0958", "abc", " 0161 496 0000 "]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    rows = df.select(contact.e164(F.col("n")).alias("a"), contact.phone_e164(F.col("n"))["e164"].alias("b"), F.transform(F.array("n"), contact.e164)[0].alias("c")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] == [r["c"] for r in rows] and rows[2]["a"] == "+447700900123"


def test_passes_stay_within_the_time_budget():
    text = ("Report on Geoff BAINES of 14 Acacia Avenue, Bristol BS5 9TY, seen 12/03/2024 in a black BMW, phone 07700 900123, paid £1,200. " * 8000)[:1_000_000]
    at = time.time()
    claimed(text, NAMES)
    assert time.time() - at < 15
    for odd in ("A" * 200_000, "1" * 200_000, "a@" * 100_000, "Ab " * 60_000, "Ab C" * 50_000, "\n" * 200_000, "12/" * 60_000, "account " * 25_000, "IBAN GB11 " + "AB12 " * 40_000):
        at = time.time()
        claimed(odd, NAMES)
        assert time.time() - at < 6, odd[:8]


def naive(text, keys):
    """The longest match first, position by position."""
    low = dictionary.fold(text)
    hits = [(s, s + len(k), k) for k in keys for s in range(len(low)) if low.startswith(k, s) and dictionary.bordered(low, s, s + len(k)) and dictionary.proper(text, s, s + len(k))]
    out = []
    for s, e, k in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if not any(a < e and s < b for a, b, _ in out):
            out.append((s, e, k))
    return sorted(out)


def test_dictionary_equals_the_naive_scan_on_both_ways(spark):
    r = random.Random(3)
    names = ["New York", "York", "New York City", "Málaga", "Москва", "St. Ives", "Bath", "Lima", "Li", None, "", "São Paulo", "Paulo", "New York"]
    keys = sorted({k for n in names if (k := dictionary.usable(n))})
    assert "li" not in keys and "malaga" in keys and "st. ives" in keys
    words = ["New", "York", "City", "MALAGA", "Malaga", "malaga", "Москва", "St.", "Ives", "@Bath", "Bath", "BATH", "Sofia", "DRAGOMIR", "DRAGOMIR,", "Lima", "Limassol", "São", "Paulo", "x.Lima", "and"]
    rows = [(i % 7, " ".join(r.choice(words) for _ in range(r.randrange(0, 14))), "k") for i in range(150)] + [(8, None, "k"), (9, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    table = spark.createDataFrame([(n, 1) for n in names], "name string, key int")
    want = sorted((d, t or "", tuple(naive(t or "", keys))) for d, t, _ in rows)
    for limit in (1000, 2):
        got = dictionary.mentions(df, "text", table, "name", limit)
        assert got.columns == ["doc_id", "text", "key", "found"]
        assert sorted((x["doc_id"], x["text"] or "", tuple((f["s"], f["e"], f["key"]) for f in x["found"])) for x in got.collect()) == want
    assert dictionary.mentions(df, "text", table.where("false")).where("size(found) > 0").count() == 0


def tell(text):
    found, _, _ = claimed(text, NAMES)
    entities = [clauses.Entity(f["s"], f["e"], f["kind"], f["value"]) for f in sorted(found, key=lambda f: f["s"])]
    return [(t.source, t.relation, t.target, t.tense, t.negated, t.confidence) for t in clauses.told(text, entities)]


A, B, C = "Geoff BAINES", "Karen WALSH", "Dean HOLLAND"


@pytest.mark.parametrize(("text", "want"), [
    (f"{A} flew to Malaga on 11/06/2026", [(A, "TRAVELS_TO", "malaga", "past", False, "high")]),
    (f"{B} was contacted by {A}", [(A, "COMMUNICATED_WITH", B, "past", False, "high")]),
    (f"{A} denies meeting {C}", [(A, "ASSOCIATE_OF", C, "present", True, "low")]),
    (f"{C} did not travel to Seville", [(C, "TRAVELS_TO", "seville", "present", True, "low")]),
    (f"{C} didn't call {A}", [(C, "COMMUNICATED_WITH", A, "present", True, "low")]),
    (f"{C} transferred £5,000 to {B}", [(C, "TRANSACTED_WITH", B, "past", False, "high")]),
    (f"{A} plans on meeting {B}, {C} and Ann STONE", [(A, "ASSOCIATE_OF", x, "future", False, "high") for x in (B, C, "Ann STONE")]),
    (f"{A} works for {C}", [(C, "EMPLOYS", A, "present", False, "high")]),
    (f"{A} departed Bristol for Lisbon", [(A, "DEPARTS_FROM", "bristol", "past", False, "high"), (A, "TRAVELS_TO", "lisbon", "past", False, "high")]),
    (f"{A}, who lives at 12 Acacia Avenue, Bristol BS5 9TY, uses +44 7700 900123", [(A, "STAYS_AT", "12 Acacia Avenue, Bristol BS5 9TY", "present", False, "high"), (A, "USES", "+44 7700 900123", "present", False, "high")]),
    (f"{A} met {B}. He allegedly flew to Malaga.", [(A, "ASSOCIATE_OF", B, "past", False, "high"), (A, "TRAVELS_TO", "malaga", "past", False, "low")]),
    (f"{A} met {B}. Then flew to Malaga.", [(A, "ASSOCIATE_OF", B, "past", False, "high"), (A, "TRAVELS_TO", "malaga", "past", False, "med")]),
    (f"{A} met {B}. WALSH paid {C}.", [(A, "ASSOCIATE_OF", B, "past", False, "high"), (B, "TRANSACTED_WITH", C, "past", False, "high")]),
    (f"The weather in Malaga was fine. {A} has a phone.", []),
    (f"{A} will return to Malaga", [(A, "RETURNS", "malaga", "future", False, "high")]),
    ("", []),
])
def test_relations_of_planted_sentences(text, want):
    assert tell(text) == want


def test_later_mentions_and_their_reach():
    def meant(text):
        found, _, _ = claimed(text)
        return [(text[x.s : x.e], x.label) for x in clauses.mentions(text, [clauses.Entity(f["s"], f["e"], f["kind"], f["value"]) for f in found]) if x.meant]

    assert meant(f"{A} met {B}. BAINES spoke with her.") == [("BAINES", A), ("her", A)]
    assert meant(f"{A} spoke. {'x ' * 150}to him.") == [("him", A)]
    assert meant(f"{A} spoke. {'x ' * 170}to him.") == []
    assert meant("Geoff BAINES and Ann BAINES met. BAINES left; the BAINES boat.") == [("BAINES", "Geoff BAINES")]
    assert meant("no person; to him") == []


def test_sentences_part_outside_entities():
    text = "He is at 1.2.3.4 now. Next! J.Smith ok\nend"
    at = [text[a:b].strip() for a, b in clauses.sentences(text, [clauses.Entity(9, 16, "ip", "x")])]
    assert at == ["He is at 1.2.3.4 now.", "Next!", "J.Smith ok", "end"]


def test_verb_forms_follow_rules():
    for form, lemma in (("flies", "fly"), ("flew", "fly"), ("travelled", "travel"), ("travels", "travel"), ("stayed", "stay"), ("meeting", "meet"), ("purchasing", "purchase"), ("carried", "carry"), ("sold", "sell")):
        assert clauses.LEXICON[form][0] == lemma
    assert re.fullmatch(r"[\w ]+", " ".join(v for v, _ in clauses.LEXICON.values()))


def test_relations_and_mentions_as_queries(spark):
    df = spark.createDataFrame([(1, f"{A} met {B}. BAINES paid her.", "e"), (2, None, "e"), (3, "", "e")], "doc_id long, text string, source string")
    found = claims.claimed(df.withColumnRenamed("source", "more")).withColumnRenamed("more", "origin")
    got = clauses.relations(found)
    assert [(r["doc_id"], r["origin"], r["source"], r["relation"], r["target"]) for r in got.collect()] == [(1, "e", A, "ASSOCIATE_OF", B)]
    assert [(r["doc_id"], r["label"], r["s"]) for r in clauses.mentioned(found).collect()] == [(1, A, 30)]
    assert clauses.relations(found.where("false")).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    (f"{A} was arrested with a knife.", [(0, A, "status", "ARRESTED"), (0, A, "warning", "WEAPONS")]),
    (f"{A}, {B} and {C} were all arrested.", [(0, x, "status", "ARRESTED") for x in (A, B, C)]),
    (f"{A} met {B}. He has access to firearms.", [(1, A, "warning", "FIREARMS")]),
    (f"A firearm was recovered from {A}.", []),
    (f"Police arrested {A}, released under investigation.", []),
    (f"{A} spoke. A gun was found.", []),
    ("He was arrested.", []),
])
def test_signals_go_to_whom_they_are_told_of(text, want):
    found, _, _ = claimed(text)
    assert list(clauses.signals(text, [clauses.Entity(f["s"], f["e"], f["kind"], f["value"]) for f in sorted(found, key=lambda f: f["s"])])) == want


def test_accents_fold_in_all_alphabets(spark):
    from linkforge.functions import contact

    row = spark.createDataFrame([("Йод ÑANDÚ Ἀθήνα Đà Nẵng e\u0301",)], "t string").select(contact.fold_accents(F.col("t")).alias("f")).first()
    assert row["f"] == "иод nandu αθηνα đa nang e"


def test_passes_left_out_of_a_text_find_nothing_there():
    """The words and digits that a shape needs are looked for first; whatever the text, no find is lost by that, letters of odd case included."""
    import random

    from linkforge.operators import claims

    table = claims.passes(["paris"], ["leeds"])
    bits = """On 03/04/1996|u1+x@Example.com|+447700912345|red Ford AB12 XYZ|RED VAN|the ſaloon|a PICKUP|trucK|£5,123|20 GBP|1.5 m|yeſterday|laſt weeK|Next Monday|LAST NIGHT|XX-ABC|[ 2 B P ]|PNR ABC123|Booking Ref: X1Y2Z3|IMEI 490154203237518|İMEI 490154203237518|ımeı 490154203237518
PPT 123456789|Passport no. is AB123456|CRO 1234/99A|PNC 99/123456A|National Insurance AB 12 34 56 C|AB 12 34 56 C|Co. No. 12345678|company number 12345678|SC 123456|CC 12345678|s/c 12-34-56 a/c 1234567|account 12345678 at sort code 12-34-56|ACCOUNT number 123456|ıban GB82WEST12345698765432|IBAN GB82 WEST 1234 5698|Barclays a/c ending 1234
UTR 1234567890|vat GB 123456|12 Acacia Avenue, Leeds LS1 4AB|C/ Mayor, Madrid|Calle Mayor 28001|Av. Sol 3, Paris|Leeds airport|Heathrow Airport|Range Rover|Golf|Mercedes-Benz Sprinter|192.168.1.1|John SMITH|٣/٤/2024|3 May 2024|2024-05-06|1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2""".replace("\n", "|").split("|")
    r, left_out = random.Random(5), 0
    for n in range(1500):
        text = " ".join(r.choices(bits, k=1 + n % 4)).swapcase() if n % 7 == 3 else ", ".join(r.choices(bits, k=1 + n % 4))
        looked = {nth for nth, _ in claims.looked_at(text, table)}
        left_out += len(table) - len(looked)
        for nth, p in enumerate(table):
            assert nth in looked or not list(p.look(text, claims._R[p.shape])), (text, p.kind, p.shape)
    assert left_out > 20 * 1500 * 0.6
