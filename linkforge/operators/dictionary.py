"""Names of a table found in texts: the longest first, at word borders, with guards against surnames and handles.

A table up to LIMIT names is counted, then sent to the tasks, where an automaton finds all of its names in one walk over a text. A larger one stays where it
is: tasks send the runs of words that may be names, and a join finds which are. Either way one small step settles the overlaps within a text.

Names and texts are compared in lower case without accents, of any script. A name must begin and end with a letter or digit and have four characters at
least; others are left out. Null and empty texts have no names; rows keep their own spans, whatever their key; a name listed twice is one.
Positions count code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from linkforge.session import settled

#: Names sent to tasks at most; the fewest characters of a name; texts in a batch of spans.
LIMIT, LEAST = 200_000, 4
#: How far before and behind a name the guards look.
BEFORE, BEHIND = 26, 28
_SURNAME_AHEAD = re.compile(r"\s+[A-Z][A-Z'’-]{2,}\b")
_FORENAME_BEFORE = re.compile(r"[A-Z][a-z]+\s+$")
_SURNAME_BEFORE = re.compile(r"[A-Z][A-Z'’-]{2,},\s+$")
_CAPITALS = re.compile(r"[A-Z'’-]+")
_PROPER = re.compile(r"[A-Z][a-zÀ-ſ'-]+")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without marks, character by character, so that positions stay."""
    if text.isascii():
        return text.lower()
    out = []
    for c in text:
        low = unicodedata.normalize("NFD", c)[0].lower()
        out.append(low if len(low) == 1 else c)
    return "".join(out)


def usable(name: str | None) -> str | None:
    """A name's key: folded, with single blanks; None if it can't be looked for."""
    key = fold(" ".join(unicodedata.normalize("NFC", name or "").split()))
    return key if len(key) >= LEAST and key[0].isalnum() and key[-1].isalnum() else None


def proper(text: str, s: int, e: int) -> bool:
    """Whether a name found at s to e is meant as one: it begins with a capital, is no part of a handle or path, and no forename or surname."""
    name = text[s:e]
    if not name[0].isupper() or text[max(0, s - 1) : s] in ("@", "/", "."):
        return False
    before, behind = text[max(0, s - BEFORE) : s], text[e : e + BEHIND]
    if _CAPITALS.fullmatch(name) and _FORENAME_BEFORE.search(before):
        return False
    return not (_PROPER.fullmatch(name) and (_SURNAME_AHEAD.match(behind) or _SURNAME_BEFORE.search(before)))


def bordered(low: str, s: int, e: int) -> bool:
    return not (s and low[s - 1].isalnum()) and not (e < len(low) and low[e].isalnum())


class Finder:
    """All places of a set of keys in a text."""

    def __init__(self, keys: list[str]):
        self.automaton = ahocorasick.Automaton()
        for k in keys:
            self.automaton.add_word(k, len(k))
        if keys:
            self.automaton.make_automaton()
        self.any = bool(keys)

    def hits(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, key) of every key at word borders that is meant as a name, overlaps included."""
        if not self.any or not text:
            return []
        low = fold(text)
        ends = ((end + 1 - n, end + 1) for end, n in self.automaton.iter(low))
        return [(s, e, low[s:e]) for s, e in ends if bordered(low, s, e) and proper(text, s, e)]


def longest(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Hits that stand when longer ones, and of equal ones those that begin first, take their place before others; in order of the text."""
    taken: set[int] = set()
    out = []
    for s, e, k in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if s not in taken and e - 1 not in taken:
            taken.update(range(s, e))
            out.append((s, e, k))
    return sorted(out)


_KIND = "array<struct<s:int,e:int,key:string>>"
_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("key", pa.string())]))


def keyed(names: DataFrame, name: str) -> DataFrame:
    """names with a column key; rows that can't be looked for are left out."""
    place = names.columns.index(name)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([usable(x) for x in b.column(place).to_pylist()], pa.string())], names=[*b.schema.names, "key"])

    return names.mapInArrow(add, StructType([*names.schema.fields, StructField("key", StringType())])).where("key is not null")


def mentions(texts: DataFrame, text: str, names: DataFrame, name: str = "name", limit: int = LIMIT) -> DataFrame:
    """texts with a column found: (s, e, key) of the names of a table in each text, in order."""
    keys = keyed(names.select(name), name).select("key").distinct()
    counted = keys.limit(limit + 1).collect()  # limit + 1 rows at most
    place = texts.columns.index(text)
    schema = StructType([*texts.schema.fields, StructField("found", DataType.fromDDL(_KIND))])

    if len(counted) <= limit:
        shared = texts.sparkSession.sparkContext.broadcast(sorted(r["key"] for r in counted))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value)
            for b in batches:
                rows = [[{"s": s, "e": e, "key": k} for s, e, k in longest(finder.hits(t or ""))] for t in b.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _ARROW)], names=schema.names)

        return texts.mapInArrow(scan, schema)

    # Words of the longest name bound the runs that are sent; the first word's letters cut most of them.
    words = keys.agg(F.max(F.size(F.regexp_extract_all("key", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))).first()[0]
    marked = settled(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = fold(t or "")
                at = [m.span() for m in _WORD.finditer(low)]
                found = [(s, at[j][1]) for i, (s, _) in enumerate(at) if t[s].isupper() for j in range(i, min(len(at), i + words))]
                found = [(s, e) for s, e in found if e - s >= LEAST and proper(t, s, e)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()), pa.array([low[s:e] for s, e in found], pa.string())], names=["_row", "s", "e", "key"])

    sent = marked.select("_row", text).mapInArrow(runs, "_row long, s int, e int, key string")
    met = sent.join(keys, "key").groupBy("_row").agg(F.collect_list(F.struct("s", "e", "key")).alias("hits"))
    joined = marked.join(met, "_row", "left").drop("_row")
    last = len(texts.columns)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"s": s, "e": e, "key": k} for s, e, k in longest([(h["s"], h["e"], h["key"]) for h in x or []])] for x in b.column(last).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(rows, _ARROW)], names=schema.names)

    return joined.mapInArrow(settle, schema)
