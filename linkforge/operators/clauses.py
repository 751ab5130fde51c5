"""Who did what to whom: sentences, clauses, verb groups and the relations that they tell, from texts and the entities found in them.

A sentence's tokens become one letter each, by class, and regular expressions over these letters are the grammar: one finds the places where clauses part, one finds
a verb group. Entities are single tokens. A text is worked on alone and its sentences in order, as the subject last named is carried from one to the next; tasks take texts
on Arrow batches, nothing is shuffled.

Before that, mentions() adds what speaks of a person named in full: the bare SURNAME, and him, her or them behind a preposition, which mean the
nearest person at most REACH characters before.

Null and empty texts tell nothing, nor do texts without entities. Positions count code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

from linkforge.functions.vocabulary import STATUS, WARNINGS, cue_forms

REACH = 320
# Verbs by what they tell, and the relation that each tells with a preposition or of a kind of thing; _rev turns it round.
VERBS = {
    "movement": "fly travel go head drive sail move visit attend arrive cross enter relocate",
    "departure": "depart leave exit",
    "communication": "call phone text message email contact ring speak talk tell notify whatsapp dm facetime",
    "transaction": "pay transfer buy purchase sell supply send receive deposit withdraw owe lend borrow acquire obtain deal launder smuggle wire",
    "residence": "stay live reside lodge sleep base frequent operate",
    "association": "meet know associate marry befriend accompany join recruit introduce greet",
    "employment": "work employ hire manage",
    "possession": "use own register hold carry possess wear keep control",
    "return": "return",
}
BY_PREPOSITION = {
    "movement": {"to": "TRAVELS_TO", "into": "TRAVELS_TO", "towards": "TRAVELS_TO", "for": "TRAVELS_TO", "from": "DEPARTS_FROM"},
    "departure": {"to": "TRAVELS_TO", "into": "TRAVELS_TO", "towards": "TRAVELS_TO", "for": "TRAVELS_TO", "from": "DEPARTS_FROM"},
    "transaction": {"to": "TRANSACTED_WITH", "from": "TRANSACTED_WITH"},
    "employment": {"for": "EMPLOYS_rev", "at": "EMPLOYS_rev", "with": "ASSOCIATE_OF"},
}
BY_KIND = {
    "movement": {"location": "TRAVELS_TO", "address": "STAYS_AT", "vehicle": "USES", "person": "ASSOCIATE_OF"},
    "departure": {"location": "DEPARTS_FROM", "address": "DEPARTS_FROM", "vehicle": "USES", "person": "ASSOCIATE_OF"},
    "communication": dict.fromkeys(("person", "phone", "email", "organisation"), "COMMUNICATED_WITH"),
    "transaction": {"person": "TRANSACTED_WITH", "organisation": "TRANSACTED_WITH", "account": "TRANSACTED_WITH", "phone": "USES", "vehicle": "OWNS", "money": "TRANSACTED_WITH"},
    "residence": dict.fromkeys(("address", "location", "organisation"), "STAYS_AT"),
    "association": dict.fromkeys(("person", "organisation"), "ASSOCIATE_OF"),
    "possession": {"phone": "USES", "email": "USES", "vehicle": "USES", "account": "USES", "address": "LINKED_TO", "document": "USES", "ip": "USES"},
}
# Past forms that no rule gives.
IRREGULAR = """flew fly flown fly went go gone go met meet bought buy sold sell sent send paid pay drove drive driven drive left leave spoke speak spoken speak told tell
kept keep held hold knew know known know wore wear slept sleep withdrew withdraw withdrawn withdraw lent lend rang ring rung ring""".split()
# Words of closed classes.
CLOSED = {
    "M": "would may might can could should must", "F": "will shall", "B": "is are was were be been being", "H": "has have had", "D": "do does did", "N": "not never no",
    "X": "didn't doesn't don't wouldn't isn't wasn't weren't aren't hasn't haven't hadn't can't cannot couldn't shouldn't mustn't", "Y": "won't",
    "d": "denies denied deny refutes refuted disputes disputed rejects rejected rebuts rebutted contests contested",
    "C": "and but then who which while after before where",
    "p": "from at in on with via for by near into onto through towards toward", "t": "to", "o": "him her them me us", "s": "he she they i we", "n": "subject male female suspect target individual nominal",
}
SPELT = "email phone text message call ring".split()  # nouns as well as verbs
BEFORE_NOUN = "and an a the his her their new via by on this that same".split()
PLANS = "plans on;plans to;planning to;planning on;intends to;intending to;expected to;expects to;due to;going to;set to;about to;scheduled to;likely to;will be".split(";")
DOUBTS = r"(?i)\b(?:suspected|alleged(?:ly)?|believed|reportedly|thought\s+to|appears?\s+to|possibly|unconfirmed|may\s+have|might\s+have|is\s+assessed\s+to|purport(?:s|ed|edly)?)\b"
TYPES = {"place": "location"}  # kinds of claims that bear another name as entities

# The grammar. A verb group: a verb, or what may come before one and up to four fillers, then a verb.
GROUP = re.compile(r"[MFBHDXYd][XYNMFBHDdyt]{0,4}[Vvq]|[Vv]")
# Where clauses part: a semicolon; a comma before a verb; a joining word with a verb not far ahead, unless it joins things.
PART = re.compile(r";|,(?=[VvqMFBHD])|C(?=.{0,4}[VvqMFBHD])(?![vq][EP])(?!(?<=[EP,]C)[EP](?![VvqMFBHD]))")
_TOKEN = re.compile(r"[A-Za-z][\w'’-]*|\d[\d.,]*|[,;:()&]")
_CAPITALS = re.compile(r"[A-Z][A-Z'’-]+")
_DOUBT = re.compile(DOUBTS)
_END = re.compile(r"[.!?\n]")
_CARRY = re.compile(r"(?i)\b(?:he|she)\b")
_PRONOUN = re.compile(r"(?i)\b(?:to|with|from|for|by|alongside)\s+(him|her|them)\b")


def _lexicon() -> dict[str, tuple[str, str]]:
    """{form: (lemma, what it tells)}, by rules of spelling; a form that two verbs have is the earlier one's."""
    out: dict[str, tuple[str, str]] = {}
    for group, lemmas in VERBS.items():
        for v in lemmas.split():
            forms = [v, v + "s", v + "es", v + "ed", v + "d", v + "ing", v + v[-1] + "ed", v + v[-1] + "ing"]
            forms += [v[:-1] + "ing"] if v.endswith("e") else [v[:-1] + "ied", v[:-1] + "ies"] if v.endswith("y") else []
            for f in forms:
                out.setdefault(f, (v, group))
    for past, v in zip(IRREGULAR[::2], IRREGULAR[1::2]):
        out.setdefault(past, out[v])
    return out


LEXICON = _lexicon()
_PAST = set(IRREGULAR[::2])
_CLASS = {w: c for c, words in reversed(CLOSED.items()) for w in words.split()}
_PLANS = {tuple(p.split()) for p in PLANS}


@dataclass(frozen=True)
class Entity:
    s: int
    e: int
    kind: str
    label: str
    meant: bool = False  # by a surname or pronoun


@dataclass(frozen=True)
class Token:
    s: int
    e: int
    low: str
    text: str
    entity: Entity | None = None


@dataclass(frozen=True)
class Verb:
    lemma: str
    tells: str
    s: int
    e: int
    tense: str
    negated: bool
    passive: bool
    first: int  # tokens of the clause
    behind: int


def sentences(text: str, entities: list[Entity]) -> list[tuple[int, int]]:
    """Sentences end at . ! ? or a line's end, but not before a capital that follows a dot at once, nor inside an entity."""
    begins = [x.s for x in entities]
    cuts = [0]
    for m in _END.finditer(text):
        i = m.start()
        k = bisect_right(begins, i) - 1
        if not (m[0] == "." and text[i + 1 : i + 2].isascii() and text[i + 1 : i + 2].isupper()) and not (k >= 0 and i + 1 < entities[k].e):
            cuts.append(i + 1)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], len(text)]) if len(text[a:b].strip()) > 2]


def tokens(text: str, s: int, e: int, entities: list[Entity]) -> list[Token]:
    out: list[Token] = []
    at = s
    for x in [*entities, Entity(e, e, "", "")]:
        if x.s >= at:
            out += [Token(at + m.start(), at + m.end(), m[0].lower().replace("’", "'"), m[0]) for m in _TOKEN.finditer(text[at : x.s])]
            if x.kind:
                out.append(Token(x.s, x.e, "", text[x.s : x.e], x))
            at = x.e
    return out


def letters(ts: list[Token]) -> str:
    """The class of each token: E or P for an entity or a person, V, v or q for a verb, one that may be a noun, or one that the word before makes a noun."""
    out = []
    for i, t in enumerate(ts):
        if t.entity:
            c = "P" if t.entity.kind == "person" else "E"
        elif not t.text[0].isalnum():
            c = t.text
        elif t.low in _CLASS and (_CLASS[t.low] not in "Cptosn" or t.low not in LEXICON):
            c = _CLASS[t.low]
        elif t.low in LEXICON:
            c = "V" if t.low not in SPELT else "q" if i and not ts[i - 1].entity and ts[i - 1].low in BEFORE_NOUN else "v"
        else:
            c = "y" if t.low.endswith("ly") else "w"
        out.append(c)
    return "".join(out)


def clauses(ts: list[Token], classes: str) -> list[tuple[int, int]]:
    """(first, behind) of the tokens of each clause; what parts two belongs to neither."""
    out, at = [], 0
    for m in PART.finditer(classes):
        if m.start() > at:
            out.append((at, m.start()))
            at = m.end()
    return [*out, (at, len(ts))] if at < len(ts) else out


def verb_of(ts: list[Token], classes: str) -> Verb | None:
    m = GROUP.search(classes)
    if not m:
        return None
    i, j = m.span()
    head, body = ts[j - 1], m[0][:-1]
    lemma, tells = LEXICON[head.low]
    past = head.low in _PAST or (head.low.endswith("ed") and head.low != lemma)
    planned = "F" in body or "Y" in body or any((ts[k].low, ts[k + 1].low) in _PLANS for k in range(max(0, i - 3), i))
    return Verb(lemma, tells, ts[i].s, head.e, "future" if planned else "past" if past or "H" in body else "present", any(c in "NXYd" for c in body), "B" in body and past, i, j)


def subject_of(ts: list[Token]) -> Token | None:
    """The nearest entity, subject pronoun, noun for one, or word in capitals before a verb."""
    for t in reversed(ts):
        if t.entity or _CLASS.get(t.low) in ("s", "n") or (t.text[0].isalpha() and _CAPITALS.fullmatch(t.text)):
            return t
    return None


def objects_of(ts: list[Token], classes: str) -> list[tuple[str | None, Token]]:
    """(preposition, token) of the entities and pronouns that a verb governs, until another verb, another thought or seven idle words."""
    out: list[tuple[str | None, Token]] = []
    prep, idle = None, 0
    for i, (t, c) in enumerate(zip(ts, classes)):
        rest = classes[i + 1 :]
        if t.entity:
            out.append((prep, t))
            idle = 0
            # Only a list keeps its preposition.
            if not (rest[:1] in (",", "&") or (ts[i + 1 : i + 2] and ts[i + 1].low == "and")):
                prep = None
        elif c in ",&":
            continue
        elif not t.text[0].isalnum():
            break
        elif t.low == "and":
            if out and not re.match(r"[EP]|[vq][EP]", rest):
                break
        elif c in "pt":
            prep, idle = t.low, idle + 1
        elif t.low in CLOSED["o"].split():
            out.append((prep, t))
        else:
            if c in "Vvq" and out:
                break
            idle += 1
            if idle > 7 and out:
                break
    return out


def relation(tells: str, prep: str | None, kind: str) -> tuple[str, bool] | None:
    """(relation, whether it runs from the object) that a verb tells of a kind of thing behind a preposition."""
    if tells == "return":
        return "RETURNS", False
    found = BY_PREPOSITION.get(tells, {}).get(prep or "") or BY_KIND.get(tells, {}).get(kind)
    return (found.removesuffix("_rev"), found.endswith("_rev")) if found else None


def mentions(text: str, entities: list[Entity]) -> list[Entity]:
    """entities, in order, with the later mentions of persons: SURNAMES that one person bears, else the first of the text if he or she bears it, and object pronouns."""
    people = [x for x in entities if x.kind == "person"]
    if not people:
        return sorted(entities, key=lambda x: x.s)
    held = sorted(entities, key=lambda x: x.s)

    def free(s: int, e: int) -> bool:
        k = bisect_right(held, s, key=lambda x: x.s) - 1
        return not (k >= 0 and held[k].e > s) and not (k + 1 < len(held) and held[k + 1].s < e)

    bearers: dict[str, list[str]] = {}
    for x in people:
        name = next((w for w in reversed(x.label.split()) if _CAPITALS.fullmatch(w)), "")
        if len(name) >= 3 and x.label not in bearers.setdefault(name, []):
            bearers[name].append(x.label)
    first = held[next(i for i, x in enumerate(held) if x.kind == "person")].label
    whom = {n: ls[0] if len(ls) == 1 else first for n, ls in bearers.items() if len(ls) == 1 or first in ls}
    new = []
    for m in re.finditer(r"\b[A-Z][A-Z'’-]{2,}(?![\w])", text):
        if m[0] in whom and free(*m.span()) and not re.search(r"(?i)(?:the|a|an|this|that)\s+$", text[max(0, m.start() - 5) : m.start()]):
            new.append(Entity(*m.span(), "person", whom[m[0]], True))
    held = sorted([*held, *new], key=lambda x: x.s)
    ends = sorted(((x.e, x.label) for x in held if x.kind == "person"))
    for m in _PRONOUN.finditer(text):
        k = bisect_right(ends, (m.start(1), "\U0010ffff")) - 1
        if k >= 0 and m.start(1) - ends[k][0] < REACH and free(*m.span(1)):
            held.append(Entity(*m.span(1), "person", ends[k][1], True))
            held.sort(key=lambda x: x.s)
    return held


@dataclass(frozen=True)
class Told:
    """A relation as a sentence tells it."""

    sentence: int
    source: str
    source_kind: str
    relation: str
    target: str
    target_kind: str
    cue_s: int
    cue_e: int
    tense: str
    negated: bool
    passive: bool
    planned: bool
    amount: str | None
    day: str | None
    confidence: str


LEVELS = ["high", "med", "low"]


def told(text: str, entities: list[Entity]) -> Iterator[Told]:
    """The relations of a text, in order. A subject that is carried from before, and words of doubt, cost a level of confidence each; a denial costs both."""
    known = mentions(text, entities)
    dates = [(x.s, x.label) for x in known if x.kind in ("date", "relative")]
    things = [replace(x, kind=TYPES.get(x.kind, x.kind)) for x in known if x.kind not in ("date", "relative", "tag", "grading")]
    begins = [x.s for x in things]
    carried: Entity | None = None
    for n, (s, e) in enumerate(sentences(text, sorted(known, key=lambda x: x.s))):
        here = things[bisect_right(begins, s - 1) : bisect_right(begins, e - 1)]
        day = next((label for at, label in dates if s <= at < e), None)
        ts = tokens(text, s, e, here)
        classes = letters(ts)
        doubt = int(bool(_DOUBT.search(text[s:e])))
        before: Entity | None = None  # the subject of the clause before
        for a, b in clauses(ts, classes):
            verb = verb_of(ts[a:b], classes[a:b])
            if verb is None:
                before = next((t.entity for t in reversed(ts[a:b]) if t.entity and t.entity.kind == "person"), before)
                continue
            subject, cost = subject_of(ts[a : a + verb.first]), 0
            if subject is None:
                source = before
            elif subject.entity:
                source = subject.entity
            else:
                source = before or carried
                cost += before is not None
            if source is None and carried is not None and (_CARRY.search(text[s:e]) or not any(x.kind == "person" for x in here)):
                source = carried
            cost += source is carried and source is not None and source not in here
            if source is not None:
                before = source
            objects = objects_of(ts[a + verb.behind : b], classes[a + verb.behind : b])
            if verb.passive and source is not None and (by := next((o for o in objects if o[0] == "by" and o[1].entity), None)):
                objects = [(None, Token(source.s, source.e, "", source.label, source)), *(o for o in objects if o is not by)]
                source = by[1].entity
            amount = next((t.entity.label for _, t in objects if t.entity and t.entity.kind == "money"), None)
            for prep, t in objects if source is not None else ():
                if t.entity is None or t.entity.kind == "money" or (found := relation(verb.tells, prep, t.entity.kind)) is None or t.entity.label == source.label:
                    continue
                x, y = (t.entity, source) if found[1] else (source, t.entity)
                level = LEVELS[2 if verb.negated else min(2, cost + doubt)]
                yield Told(n, x.label, x.kind, found[0], y.label, y.kind, verb.s, verb.e, verb.tense, verb.negated, verb.passive, verb.tense == "future", amount, day, level)
        last = next((x for x in reversed(here) if x.kind == "person"), None)
        first = next((x for x in here if x.kind == "person" and not x.meant), None)
        carried = first or last or carried


def _cue(cue: str) -> re.Pattern:
    """A cue's words with any signs between them, the last in singular or plural."""
    *before, last = re.findall("[a-z0-9]+", cue.lower())
    return re.compile(rf"\b{'[^a-z0-9]+'.join([*before, last.removesuffix('s')])}s?\b")


_SIGNALS = [(kind, code, [f for c in cues for f in cue_forms(c)], [_cue(c) for c in cues]) for kind, vocabulary in (("status", STATUS), ("warning", WARNINGS)) for code, cues in vocabulary.items()]
_SUBJECT = re.compile(r"(?i)\b(?:he|she|they|i|we)\b")


def signals(text: str, entities: list[Entity]) -> Iterator[tuple[int, str, str, str]]:
    """(sentence, person, kind, code) of the standings and warnings that a sentence tells of the persons named before its first cue, or, if none is, of the subject
    carried into it where a pronoun stands before the cue. What is told of nobody, such as a weapon found, is nobody's."""
    known = mentions(text, entities)
    people = [x for x in known if x.kind == "person"]
    carried: Entity | None = None
    for n, (s, e) in enumerate(sentences(text, known)):
        low = text[s:e].lower()
        words = f" {' '.join(re.findall('[a-z0-9]+', low))} "
        here = [x for x in people if s <= x.s and x.e <= e]
        found = [(kind, code, shapes) for kind, code, forms, shapes in _SIGNALS if any(f in words for f in forms)]
        if found:
            cue = min((m.start() for _, _, shapes in found for p in shapes if (m := p.search(low))), default=0)
            whom = list(dict.fromkeys(x.label for x in here if x.s - s <= cue))
            if not whom and carried is not None and _SUBJECT.search(text[s : s + cue + 1]):
                whom = [carried.label]
            for person in whom:
                for kind, code, _ in found:
                    yield n, person, kind, code
        named = [x for x in here if not x.meant]
        carried = named[0] if named else here[-1] if here else carried


def attributed(texts: DataFrame, text: str = "text", found: str = "found") -> DataFrame:
    """texts' other columns with (sentence, person, kind, code) of each standing or warning; see signals()."""
    place, spots = texts.columns.index(text), texts.columns.index(found)
    others = [c for c in texts.columns if c not in (text, found)]
    kept = [texts.columns.index(c) for c in others]
    schema = StructType([*texts.select(*others).schema.fields, *StructType.fromDDL("sentence int, person string, kind string, code string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, (t, xs) in enumerate(zip(b.column(place).to_pylist(), b.column(spots).to_pylist())) if t and xs for r in signals(t, [Entity(x["s"], x["e"], x["kind"], x["value"]) for x in xs])]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in kept), *(pa.array([r[k] for r in rows], pa.int32() if k == 1 else pa.string()) for k in range(1, 5))], names=schema.names)

    return texts.mapInArrow(run, schema)


KINDS = {"sentence": "int", "source": "string", "source_kind": "string", "relation": "string", "target": "string", "target_kind": "string", "cue_s": "int", "cue_e": "int", "tense": "string",
         "negated": "boolean", "passive": "boolean", "planned": "boolean", "amount": "string", "day": "string", "confidence": "string"}
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def relations(texts: DataFrame, text: str = "text", found: str = "found") -> DataFrame:
    """texts' other columns with one row a relation told. found: an array of structs with s, e, kind and value, as claims.claimed() gives it; they must not overlap."""
    place, spots = texts.columns.index(text), texts.columns.index(found)
    others = [c for c in texts.columns if c not in (text, found)]
    kept = [texts.columns.index(c) for c in others]
    schema = StructType([*texts.select(*others).schema.fields, *(StructField(n, DataType.fromDDL(k)) for n, k in KINDS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (t, xs) in enumerate(zip(b.column(place).to_pylist(), b.column(spots).to_pylist())):
                if t and xs:
                    for r in told(t, [Entity(x["s"], x["e"], x["kind"], x["value"]) for x in xs]):
                        rows.append(i)
                        out.append(r)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in kept), *(pa.array([getattr(r, n) for r in out], _ARROW[k]) for n, k in KINDS.items())], names=schema.names)

    return texts.mapInArrow(run, schema)


def mentioned(texts: DataFrame, text: str = "text", found: str = "found") -> DataFrame:
    """texts' other columns with (s, e, label) of each later mention of a person: a bare surname, or him, her or them."""
    place, spots = texts.columns.index(text), texts.columns.index(found)
    others = [c for c in texts.columns if c not in (text, found)]
    kept = [texts.columns.index(c) for c in others]
    schema = StructType([*texts.select(*others).schema.fields, *StructType.fromDDL("s int, e int, label string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, x) for i, (t, xs) in enumerate(zip(b.column(place).to_pylist(), b.column(spots).to_pylist())) if t and xs for x in mentions(t, [Entity(x["s"], x["e"], x["kind"], x["value"]) for x in xs]) if x.meant]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in kept), *(pa.array([getattr(x, n) for _, x in rows], k) for n, k in (("s", pa.int32()), ("e", pa.int32()), ("label", pa.string())))], names=schema.names)

    return texts.mapInArrow(run, schema)
