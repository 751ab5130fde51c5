"""Duplicates of all types against all pairs, with marks, classes and close values."""

import random
from collections import defaultdict

import pytest

from linkforge.functions import names
from linkforge.operators import duplicates as d

SCHEMA = "id string, type string, label string, attrs map<string,string>, ids map<string,string>, class string, value string"


def entities(seed):
    r = random.Random(seed)
    fore = ["John", "Jon", "Jonathan", "J", "Catherine", "Katherine", "Kate", "Mohammed", "Mo", "Ann", "Bill", "William"]
    last = ["Smith", "Smyth", "Smithe", "Macdonald", "MacDonnald", "Li", "Lee", "Fernandez", "Hernandez"]
    rows = []
    for i in range(70):
        label = " ".join([*r.sample(fore, r.choice([0, 1, 1, 2])), r.choice(last)])
        attrs = {"dob": r.choice(["1980-01-01", "1990-02-02"])} if r.random() < 0.6 else {}
        if r.random() < 0.4:
            attrs["aka"] = "; ".join(r.sample(["Johnny", "Smithy", "Bill Lee", "Kate", "Jon Smyth"], r.choice([1, 2])))
        rows.append(("person", label, attrs, {}))
    for n in ("020 7946 0958", "+442079460958", "0044 20 7946 0958", "07700 900123", "12", ""):
        rows += [("phone", n, {}, {}), ("phone", "x", {}, {"e164": n})]
    rows += [("email", m, {}, {}) for m in ("A.B+x@gmail.com", "ab@googlemail.com", "ab@gmail.com", "other@x.org", "none", None)]
    rows += [("location", n, {}, {"gaz": g} if g else {}) for n, g in (("Málaga", "1"), ("Malaga", ""), ("Malaga", "2"), ("Costa", "1"), ("Lisbon", ""), ("", "3"), ("Porto", "2"))]
    rows += [("address", a, {}, {}) for a in ("12 Acacia Avenue, Bristol", "14 Acacia Ave, Bristol", "Acacia Avenue Bristoll", "Baker Street London", "Baker St, Londn", "", "Calle Mayor")]
    rows += [("organisation", a, {}, {}) for a in ("Baker Foods Limited", "Baker Foods Ltd", "Bakker Foods Ltd", "Crate Ltd", "Crates Ltd", "Kodak", "Codak", "ABC", "ABCD", "AB", "Xyz")]
    rows += [("vehicle", "Baker Foods Ltd", {}, {}), (None, "Baker Foods Ltd", {}, {})]
    rows += [rows[3], rows[5], rows[80]]
    return [(f"e{i:03}", *row) for i, row in enumerate(rows)]


def brute(rows, held, told):
    """All pairs by the rules, from the values that classes() finds."""
    out = {}
    for i, (a, ta, _, _, ia) in enumerate(rows):
        for b, tb, _, _, ib in rows[i + 1 :]:
            x, y = held[a], held[b]
            if ta is None or ta != tb or (a, b) in told or (b, a) in told or x["value"] is None or y["value"] is None:
                continue
            score, tier = 0.0, None
            if ta == "person":
                score, tier, _ = d.people_score((x["value"], x["aka"], x["dob"]), (y["value"], y["aka"], y["dob"]))
            elif ta == "location":
                if x["value"] == y["value"] or (x["alt"] and x["alt"] == y["alt"]):
                    score, tier = 1.0, "exact"
            elif x["value"] == y["value"]:
                score, tier = 1.0, "exact"
            elif ta not in ("phone", "email") and (s := names.jaro_winkler(x["value"], y["value"])) >= 0.93:
                score, tier = s, "strong"
            if tier:
                out[a, b] = (round(score, 9), tier)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rows = entities(seed)
    df = spark.createDataFrame([(*r, "c", "v") for r in rows] + [(None, "phone", "07700 900123", {}, {}, "c", "v"), (*rows[0], "c", "v")], SCHEMA).repartition(3)
    held = {r["id"]: r.asDict() for r in d.classes(df).collect()}
    free = brute(rows, held, set())
    r = random.Random(seed)
    told = set(r.sample(sorted(free), 12)) | {("e000", "zzz")}
    marks = spark.createDataFrame([p if i % 2 else p[::-1] for i, p in enumerate(sorted(told))], "a string, b string")
    for distinct, off in ((None, set()), (marks, told)):
        want = brute(rows, held, off)
        got = d.duplicates(df, distinct).collect()
        by_class, by_key = defaultdict(set), defaultdict(set)
        for i, x in held.items():
            by_class[x["class"]].add(i)
            if x["type"] == "location" and x["value"]:
                by_key["name", x["value"]].add(i)
                if x["alt"]:
                    by_key["gazetteer", x["alt"]].add(i)
        whole = set()
        for g in got:
            a, b = held[g["a"]], held[g["b"]]
            assert want[g["a"], g["b"]] == (round(g["score"], 9), g["tier"]), g
            if g["rule"] in ("class", "close"):
                left, right = by_class[a["class"]], by_class[b["class"]]
            else:
                left = right = next(v for k, v in by_key.items() if k[0] == g["rule"] and g["a"] in v and g["b"] in v)
            whole |= {(min(p, q), max(p, q)) for p in left for q in right if p != q}
        assert whole - off - {(b, a) for a, b in off} == set(want)
        assert len({(g["a"], g["b"]) for g in got}) == len(got)


def test_close_values_share_keys():
    r = random.Random(4)
    met = 0
    for _ in range(4000):
        a = "".join(r.choice("abcde fg") for _ in range(r.randrange(1, 14))).strip() or "a"
        b = list(a)
        for _ in range(r.randrange(0, 4)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(0, 2)] = r.choice(["", "a", "x", "g"])
        b = "".join(b).strip() or "b"
        if names.jaro_winkler(a, b) >= d.CLOSE:
            met += 1
            assert set(d.close_keys(a)) & set(d.close_keys(b)), (a, b)
        if names.forename_score(a.replace(" ", "") or "a", b.replace(" ", "") or "b") > 0:
            assert set(d.forename_keys((a.replace(" ", "") or "a") + " z")) & set(d.forename_keys((b.replace(" ", "") or "b") + " z")), (a, b)
    assert met > 300


def test_people_by_aliases_and_births():
    one = d.people_score(("geoff baines", "gee", None), ("gee baines", None, None))
    assert one[0] == 1.0 and one[1] == "exact" and "via alias" in one[2]
    assert d.people_score(("john smith", None, "1980-01-01"), ("john smith", None, "1990-01-01"))[1] is None
    assert d.people_score(("smith", None, "1980-01-01"), ("smith", None, "1980-01-01"))[1] == "possible"
    assert d.people_score(("smith", None, None), ("smith", None, None))[1] is None
    score, tier, reasons = d.people_score(("bill baines", None, None), ("william baines", None, None))
    assert tier == "strong" and reasons == ["surname exact", "nickname"] and abs(score - (0.62 + 0.38 * 0.97)) < 1e-9


def test_nothing_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert d.duplicates(empty).count() == 0


def test_customers_beyond_five_digits_share_no_phone(spark, tmp_path):
    """Phones of five digits gave customers 10000 and 100000 one number; those of ten digits are still read in both forms."""
    from linkforge.plans import resolve

    keys = [10000, 100000, 100002, 900004, 12, 1234567890, 1234567892]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    got = {(r["a"], r["b"]) for r in resolve.duplicate_contacts(spark, str(tmp_path)).collect()}
    assert got == {(f"A{k}", f"B{k}") for k in keys if k % 2 == 0 and k % 10} | {(f"E{k}", f"F{k}") for k in keys if k % 3 == 0}
