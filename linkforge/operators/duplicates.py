"""Likely duplicates among entities of all types, without comparing all with all, and without pairs that someone has told apart.

Entities: (id, type, label, attrs, ids), the last two maps of texts. What is compared depends on the type: phones by number, mails by address, places by
gazetteer id or name, addresses and all other things by name, equal or close, people by names and aliases together with dates of birth.

Entities that agree in all that is compared are one class. Classes, not entities, are compared, and only those that share a key of one kind:

- equal values share the value;
- values of a Jaro-Winkler of CLOSE share 65 % of the longer one's letters if they begin alike, else 79 %, so that two of the rarest letters of each,
  as many as can be missing and two more, are in both (a prefix filter);
- people need equal or close surnames to reach LEAST, with or without equal dates of birth, and then either alike forenames (one letter
  to begin with, one group of nicknames, or rare letters in common) or, where a name is one word, equal dates of birth.

A pair of classes is told by speakers: the least id that nobody marked, and every id that is marked as distinct from some other. Marks are made by hand, so
speakers are few; pairs of a class or key are told by its least speaker. No link is lost: whoever shares a class shares its links, but for marked pairs.

Nulls in ids go; a null or empty label matches nothing. Repeated rows of an id count once. An empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.functions import contact, names
from linkforge.operators.matching import ORDER, close_surnames
from linkforge.session import settled

# The least score of a pair, of a strong one and of an exact one; what a date of birth adds, and what two that differ leave; the least Jaro-Winkler of close names.
LEAST, STRONG, EXACT, SAME_BIRTH, OTHER_BIRTH, CLOSE = 0.85, 0.92, 0.999, 0.1, 0.45, 0.93
_RANK = {c: i for i, c in enumerate(ORDER + " ")}


def rare(text: str, share: float, more: int) -> list[str]:
    """The rarest letters of a text, numbered where they repeat, of which two texts that have a share of the longer one's letters in common share more."""
    seen: dict[str, int] = {}
    each = []
    for c in text:
        seen[c] = seen.get(c, 0) + 1
        each.append((_RANK.get(c, -1), -seen[c], f"{c}{seen[c]}"))
    return [t for _, _, t in sorted(each)[: len(text) - ceil(len(text) * share - 1e-9) + more]]


def close_keys(value: str) -> list[str]:
    """Keys of which values of a Jaro-Winkler of CLOSE have one in common."""
    if len(value) < 4:
        return ["".join(sorted(set(value)))] + [f"1{c}" for c in sorted(set(value))]
    begin = {f"{value[0]}|{'|'.join(p)}" for p in combinations(sorted(rare(value, 0.65, 2)), 2)}
    return sorted(begin | {f"*{'|'.join(p)}" for p in combinations(sorted(rare(value, 0.79, 2)), 2)} | ({f"1{c}" for c in value} if len(value) < 7 else set()))


def forename_keys(name: str) -> list[str]:
    """Keys of which names with alike forenames have one in common; none for a single word."""
    out = set()
    for f in name.split()[:-1]:
        out |= {f"i{f[0]}"} | {f"g{g}" for g in names._GROUPS.get(f, ())} | {f"l{t}" for t in rare(f, 0.76, 1)}
    return sorted(out)


def variants(name: str, aka: str | None) -> list[str]:
    """An entity's aliases, each alone and with the surname. name and aka are canonical, aliases parted by semicolons."""
    last = name.split()[-1:]
    each = [" ".join(a.split()) for a in (aka or "").split(";")]
    return [v for a in each if a for v in (a, " ".join([a, *last]))]


def people_score(a: tuple[str, str | None, str | None], b: tuple[str, str | None, str | None]) -> tuple[float, str | None, list[str]]:
    """(score, tier, reasons) of two of (name, aliases, date of birth)."""
    best, x, y, alias = names.person_score(a[0], b[0]), a[0], b[0], False
    for p, q in [(a[0], v) for v in variants(b[0], b[1])] + [(v, b[0]) for v in variants(a[0], a[1])]:
        if (s := names.person_score(p, q)) > best:
            best, x, y, alias = s, p, q, True
    left, right = x.split(), y.split()
    single = min(len(left), len(right)) == 1
    reasons = ["exact"] if x == y else ["surname exact"] if left and right and left[-1] == right[-1] else ["surname close"] if left and right and names.jaro_winkler(left[-1], right[-1]) >= names.CLOSE_SURNAME else []
    if x != y and not single:
        fore = [(p, q) for p in left[:-1] for q in right[:-1] if p != q]
        reasons += ["nickname"] if any(names.same_nickname_group(*f) for f in fore) else []
        reasons += ["initial"] if any(min(map(len, f)) == 1 and f[0][0] == f[1][0] for f in fore) else []
    reasons += ["via alias"] if alias else []
    if a[2] and b[2]:
        best, told = (min(1.0, best + SAME_BIRTH), "DOB match") if a[2] == b[2] else (best * OTHER_BIRTH, "DOB conflict")
        reasons.append(told)
    tier = "exact" if best >= EXACT else "strong" if best >= STRONG else "possible" if best >= LEAST else None
    if tier and single:
        tier = "possible"
        reasons.append("single name")
    return best, tier, reasons


def classes(entities: DataFrame) -> DataFrame:
    """(id, type, class, value, alt, aka, dob): what of each entity is compared, and the class of those that agree in it; value is null for what can't be compared."""
    c = F.col
    at = lambda m, k: F.nullif(F.trim(c(m)[k]), F.lit(""))
    name = F.nullif(contact.canonical_name(c("label")), F.lit(""))
    value = (
        F.when(c("type") == "phone", F.coalesce(at("ids", "e164"), contact.phone_e164(c("label"))["e164"])).when(c("type") == "email", F.coalesce(at("ids", "email"), contact.email_canonical(c("label"))))
        .when(c("type") == "address", F.nullif(contact.address_key(c("label")), F.lit(""))).otherwise(name)
    )
    person = c("type") == "person"
    aka = F.when(person, F.concat_ws(";", F.transform(F.split(F.coalesce(at("attrs", "aka"), F.lit("")), ";"), contact.canonical_name)))
    out = entities.where("id is not null").select("id", "type", value.alias("value"), F.when(c("type") == "location", at("ids", "gaz")).alias("alt"), F.nullif(aka, F.lit("")).alias("aka"), F.when(person, at("attrs", "dob")).alias("dob"))
    out = out.dropDuplicates(["id"])
    return out.withColumn("class", F.sha2(F.to_json(F.struct("type", "value", "alt", "aka", "dob")), 256))


def _scored(pairs: DataFrame, kind: str) -> DataFrame:
    """pairs (ca, cb, x, y) of structs (value, aka, dob) with score, tier and reasons; what has no tier goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if kind == "person":
                    got.append(people_score((x["value"], x["aka"], x["dob"]), (y["value"], y["aka"], y["dob"])))
                else:
                    s = names.jaro_winkler(x["value"], y["value"])
                    got.append((s, "strong" if s >= CLOSE else None, ["close"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["ca", "cb", "score", "tier", "reasons"])

    return pairs.mapInArrow(run, "ca string, cb string, score double, tier string, reasons array<string>").where("tier is not null")


def _keyed(kinds: DataFrame) -> DataFrame:
    """(class, key, label) for each class of people: its names' surnames with keys of forenames or the date of birth; label tells a name from an alias."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for cls, name, aka, dob in zip(*(b.column(i).to_pylist() for i in range(4))):
                for v, label in [(name, True), *((v, False) for v in variants(name, aka))]:
                    rows |= {(cls, v.split()[-1], k, label) for k in [*forename_keys(v), *([f"d{dob}"] if dob else [])]}
            cols = list(zip(*sorted(rows))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["class", "surname", "key", "label"])

    return kinds.select("class", "value", "aka", "dob").mapInArrow(run, "class string, surname string, key string, label boolean")


def class_pairs(held: DataFrame) -> DataFrame:
    """(ca, cb, score, tier, reasons), ca < cb: classes of held (as classes() gives them) whose members are likely duplicates of each other's, but for equal keys."""
    kinds = settled(held.where("value is not null").select("class", "type", "value", "aka", "dob").distinct(), "kinds")
    of = kinds.select("class", F.struct("value", "aka", "dob").alias("x"))

    def paired(keyed: DataFrame, on: list[str], kind: str) -> DataFrame:
        a, b = (keyed.select(*on, F.col("class").alias(f"c{s}"), *([F.col("label").alias(f"label_{s}")] if "label" in keyed.columns else [])) for s in "ab")
        met = a.join(b, on).where("ca < cb")
        met = met.where("label_a or label_b") if "label" in keyed.columns else met
        met = met.select("ca", "cb").distinct()
        both = met.join(of.select(F.col("class").alias("ca"), "x"), "ca").join(of.select(F.col("class").alias("cb"), F.col("x").alias("y")), "cb")
        return _scored(both.select("ca", "cb", "x", "y"), kind)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [close_keys(v) for v in b.column(2).to_pylist()]
            at = pa.array([i for i, ks in enumerate(each) for _ in ks], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([k for ks in each for k in ks], pa.string())], names=["class", "type", "key"])

    things = kinds.where("type not in ('person', 'phone', 'email', 'location')").select("class", "type", "value").mapInArrow(keys_of, "class string, type string, key string")
    people = settled(_keyed(kinds.where("type = 'person'")), "people")
    near = close_surnames(people.select("surname").distinct())
    # A surname and each pair of close ones that it is in.
    tags = people.select("surname").distinct().withColumn("tag", F.col("surname"))
    pair = F.concat_ws("~", "a", "b")
    tags = tags.unionByName(near.select(F.col("a").alias("surname"), pair.alias("tag"))).unionByName(near.select(F.col("b").alias("surname"), pair.alias("tag")))
    return paired(things, ["type", "key"], "thing").unionByName(paired(people.join(tags, "surname").select("class", "tag", "key", "label"), ["tag", "key"], "person"))


def duplicates(entities: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """(a, b, score, tier, reasons, rule), a < b. rule: what the pair agrees in: class, name, gazetteer (told by the least speaker of each) or close.

    distinct: (a, b), pairs told apart, in either order.
    """
    spark = entities.sparkSession
    kind = entities.schema["id"].dataType.simpleString()
    held = settled(classes(entities), "classes")
    marks = spark.createDataFrame([], f"a {kind}, b {kind}") if distinct is None else distinct.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    marked = marks.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("marked", F.lit(True))
    known = held.where("value is not null").join(marked, "id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    known = settled(known, "marked")

    def speakers(groups: DataFrame) -> DataFrame:
        """(group, id) of speakers of groups (group, id, marked)."""
        rep = groups.where("not marked").groupBy("group").agg(F.min("id").alias("id"))
        return rep.unionByName(groups.where("marked").select("group", "id"))

    def stars(groups: DataFrame) -> DataFrame:
        """(x, y): the least speaker with each member that nobody marked, and speakers among themselves."""
        rep = groups.where("not marked").groupBy("group").agg(F.min("id").alias("x"))
        plain = groups.where("not marked").join(rep, "group").where("id <> x").select("x", F.col("id").alias("y"))
        s = speakers(groups.join(groups.where("marked").select("group").distinct(), "group", "left_semi"))
        among = s.select("group", F.col("id").alias("x")).join(s.select("group", F.col("id").alias("y")), "group").where("x < y").select("x", "y")
        return plain.unionByName(among)

    members = known.select(F.col("class").alias("group"), "id", "marked")
    # A class of people is one of duplicates if its name with itself would score enough: not for single names without a birth date.
    sure = known.where("type <> 'person' or value like '% %' or dob is not null").select("class").distinct()
    dated = F.col("type").eqNullSafe("person") & ~F.col("value").contains(" ")
    inside = stars(members.join(sure.select(F.col("class").alias("group")), "group", "left_semi"))
    weak = known.where(dated).select(F.col("id").alias("x")).withColumn("weak", F.lit(True))
    inside = inside.join(weak, "x", "left").select(
        "x", "y", F.when(F.col("weak"), names.ONE_WORD + SAME_BIRTH).otherwise(1.0).alias("score"), F.when(F.col("weak"), "possible").otherwise("exact").alias("tier"),
        F.when(F.col("weak"), F.array(F.lit("exact"), F.lit("DOB match"), F.lit("single name"))).otherwise(F.array(F.lit("identical"))).alias("reasons"), F.lit("class").alias("rule"),
    )
    places = known.where("type = 'location'")
    by_key = places.select(F.concat(F.lit("name:"), "value").alias("group"), "class", "id", "marked").unionByName(places.where("alt is not null").select(F.concat(F.lit("gazetteer:"), "alt").alias("group"), "class", "id", "marked"))
    several = by_key.groupBy("group").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("group")
    keyed = by_key.join(several, "group", "left_semi").drop("class")
    across = [
        stars(keyed.where(F.col("group").startswith(f"{rule}:"))).select("x", "y", F.lit(1.0).alias("score"), F.lit("exact").alias("tier"), F.array(F.lit(rule)).alias("reasons"), F.lit(rule).alias("rule"))
        for rule in ("gazetteer", "name")
    ]
    told = settled(class_pairs(known), "pairs")
    s = settled(speakers(members.join(told.select(F.explode(F.array("ca", "cb")).alias("group")).distinct(), "group", "left_semi")), "speakers")
    close = told.join(s.select(F.col("group").alias("ca"), F.col("id").alias("x")), "ca").join(s.select(F.col("group").alias("cb"), F.col("id").alias("y")), "cb").select("x", "y", "score", "tier", "reasons", F.lit("close").alias("rule"))
    out = inside.unionByName(across[0]).unionByName(across[1]).unionByName(close)
    out = out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score", "tier", "reasons", "rule").join(marks, ["a", "b"], "left_anti")
    return out.groupBy("a", "b").agg(F.max_by(F.struct("score", "tier", "reasons", "rule"), F.struct("score", "rule")).alias("m")).select("a", "b", "m.*")
