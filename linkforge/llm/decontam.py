"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A benchmark text is cut into overlapping patterns. A place of a document within e edits of a
pattern of m characters shares at least m - q + 1 - q * e of its q-grams on neighbouring
diagonals. Shared q-grams are counted in overlapping bands of diagonals; bands that reach the
bound are verified by an alignment along the band. Both sides are compared in lower case with
runs of white space as one space, as UTF-8 bytes.

Null or empty texts hold nothing. Benchmark texts of fewer than LEAST bytes would match by chance
with edits: they must occur whole, without an edit, and not begin or end inside a word. The benchmark is a stated query set, taken in blocks of BLOCK_BYTES, each
sent to every task and held against all documents. A document or item that repeats gets rows each
time it is met; of places that tie, the one that ends first is told. Other columns are never read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.text import LOWER, SPACE, mix, raw, slices

_U = np.uint64
#: ASCII bytes of words; letters() knows the others.
_WORD = np.array([chr(c).isalnum() or c == 95 for c in range(128)] + [False] * 128)
#: Pattern bytes, edits allowed a byte, q, the least benchmark text that may have edits, and benchmark bytes in a block.
PATTERN, RATE, Q, LEAST, BLOCK_BYTES = 128, 0.08, 10, 50, 4 << 20
#: Hits of q-grams that are open at a time.
HITS = 1 << 20


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case with single spaces; offsets follow."""
    if not len(buf):
        return buf, off
    low = LOWER[buf]
    space = SPACE[low]
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[off[:-1][off[:-1] < len(buf)]] = True
    low = np.where(space, np.uint8(32), low)[keep]
    return low, np.concatenate(([0], np.cumsum(keep)))[off]


def grams(buf: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of the q bytes from each place on."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * _U(0x100000001B3) + buf[j : j + n]
    return mix(h)


def letters(buf: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text belongs to a letter, mark, digit or underscore."""
    out = _WORD[buf]
    if (buf < 128).all():
        return out
    # Characters of several bytes: the lead's bits and up to three bytes more tell the code.
    padded = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int64)
    at = np.flatnonzero(buf >= 192)
    size = 2 + (buf[at] >= 224) + (buf[at] >= 240)
    code = padded[at] & (0x7F >> size)
    for j in range(1, 4):
        code = np.where(j < size, code << 6 | padded[np.minimum(at + j, len(buf))] & 63, code)
    kinds, which = np.unique(code, return_inverse=True)
    word = np.array([c < 0x110000 and unicodedata.category(chr(c))[0] in "LMN" for c in kinds.tolist()], bool)[which]
    for j in range(4):
        fit = word & (j < size) & (at + j < len(buf))
        out[at[fit] + j] = True
    return out


@dataclass
class Patterns:
    """Patterns of a block of benchmark texts and an index of their q-grams; then the texts too short for edits, by length."""

    items: list  # of patterns, each a list of the items that hold it; then of short texts
    texts: list[np.ndarray]
    edits: np.ndarray
    gram: np.ndarray  # sorted
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray  # 2**20 flags
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, their places in items, their bytes

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Patterns:
        items, texts, few, known = [], [], [], {}
        for item, text in rows:
            b, _ = normal(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            b = b[1:] if len(b) and b[0] == 32 else b
            b = b[:-1] if len(b) and b[-1] == 32 else b
            if len(b) < LEAST:
                if len(b):
                    few.append((item, b))
                continue
            starts = [*range(0, max(1, len(b) - PATTERN), PATTERN // 2), max(0, len(b) - PATTERN)]
            for s in sorted(set(starts)):
                t = b[s : s + PATTERN]
                if (k := known.setdefault(t.tobytes(), len(texts))) == len(texts):
                    items.append([])
                    texts.append(t)
                items[k].append(item)
        found = [grams(t) for t in texts]
        gram = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        owner = np.repeat(np.arange(len(found)), [len(g) for g in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        flags = np.zeros(1 << 20, bool)
        flags[(gram >> _U(44)).astype(np.int64)] = True
        edits = np.array([int(len(t) * RATE) for t in texts], np.int64)
        by_size: dict[int, list[int]] = {}
        for n, (_, b) in enumerate(few):
            by_size.setdefault(len(b), []).append(n)
        short = {}
        for size, mine in by_size.items():
            h = np.concatenate([grams(few[n][1], size) for n in mine])
            by_hash = np.argsort(h, kind="stable")
            short[size] = h[by_hash], len(items) + np.array(mine)[by_hash], np.stack([few[n][1] for n in mine])[by_hash]
        items += [[item] for item, _ in few]
        return cls(items, texts, edits, gram[order], owner[order].astype(np.int64), place[order].astype(np.int64), flags, short)


def align(pattern: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of pattern in region, or None above edits. Row by row over the region's band."""
    n = len(region)
    steps = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, c in enumerate(pattern, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (region != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > edits:
            return None
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= edits else None


def search(p: Patterns, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document number, pattern number, edits, end in the normal text) of each pattern or short text found in a document."""
    text, off = normal(buf, off)
    return edited(p, text, off) + whole(p, text, off)


def whole(p: Patterns, text: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The first place in each document of each short text, byte by byte, that neither begins nor ends inside a word.

    Hashes grow by a byte from all places where a word may begin, and are looked up at the lengths of short texts.
    """
    if not len(text) or not p.short:
        return []
    word = letters(text)
    inside = np.zeros(len(text) + 1, bool)
    inside[1:-1] = word[1:] & word[:-1]
    inside[off] = False
    at = np.flatnonzero(~inside[:-1] & (text != 32))
    doc = np.searchsorted(off, at, "right") - 1
    h = np.zeros(len(at), np.uint64)
    docs, found, ends = [], [], []
    for size in range(1, max(p.short) + 1):
        fit = at + size <= off[doc + 1]
        at, doc, h = at[fit], doc[fit], h[fit]
        h = h * _U(0x100000001B3) + text[at + size - 1]
        if size not in p.short:
            continue
        known, item, texts = p.short[size]
        ok = np.flatnonzero(~inside[at + size])
        mixed = mix(h[ok])
        lo = np.searchsorted(known, mixed, "left")
        n = np.searchsorted(known, mixed, "right") - lo
        ok, lo, n = ok[n > 0], lo[n > 0], n[n > 0]
        if not len(ok):
            continue
        entry, who = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), np.repeat(ok, n)
        # Places ascend, so the first of a document and text is its least.
        first = np.unique(doc[who] * len(known) + entry, return_index=True)[1]
        for e, w in zip(entry[first].tolist(), who[first].tolist()):
            if (text[at[w] : at[w] + size] == texts[e]).all():
                docs.append(int(doc[w]))
                found.append(int(item[e]))
                ends.append(int(at[w] + size - off[doc[w]]))
    return [(d, i, 0, e) for d, i, e in zip(docs, found, ends)]


def edited(p: Patterns, text: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """search() for patterns, which may have edits; text is normal."""
    g = grams(text)
    if not len(g) or not len(p.gram):
        return []
    at = np.flatnonzero(p.filter[(g >> _U(44)).astype(np.int64)])
    lo = np.searchsorted(p.gram, g[at], "left")
    n = np.searchsorted(p.gram, g[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    doc = np.searchsorted(off, at, "right") - 1
    fit = at + Q <= off[doc + 1]
    at, lo, n, doc = at[fit], lo[fit], n[fit], doc[fit]
    if not len(at):
        return []
    span = int(p.edits.max()) + 1
    shift = PATTERN // span + 2  # a passage may begin before the slice's first byte
    size = np.array([len(t) for t in p.texts])
    bound = np.maximum(1, size - Q + 1 - Q * p.edits)
    patterns, bands = len(p.texts), int(len(text) // span) + shift + 3

    def regions() -> Iterator[int]:
        """Numbers of (document, band, pattern) with enough hits. Hits are opened in runs of about HITS of ascending places, and a band is
        judged as soon as no later place can hit it, so that repetitive texts take time but no memory."""
        total = np.cumsum(n)
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(total, total[begin] + HITS)))
            m = n[begin:stop]
            entry = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[begin:stop], m)
            band = (np.repeat(at[begin:stop], m) - p.place[entry]) // span + shift
            base, who = np.repeat(doc[begin:stop], m) * bands, p.owner[entry]
            # A region within e edits moves over at most e diagonals, so it lies in one of two overlapping bands.
            new = np.concatenate(((base + band + 1) * patterns + who, (base + band) * patterns + who))
            u, c = np.unique(new, return_counts=True)
            held, back = np.unique(np.concatenate((held, u)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, c)), len(held)).astype(np.int64)
            begin = stop
            done = np.ones(len(held), bool) if begin == len(at) else held // patterns % bands < (at[begin] - PATTERN) // span + shift
            found = done & (counts >= bound[held % patterns])
            yield from held[found].tolist()
            held, counts = held[~done], counts[~done]

    out, seen = [], set()
    for k in regions():
        i, b, dd = k % patterns, k // patterns % bands - 1, k // patterns // bands
        if (dd, i) in seen:
            continue
        first = (b - shift) * span  # the pair of bands b and b + 1 holds diagonals from here over two spans
        start = max(int(off[dd]), first - span)
        stop = min(int(off[dd + 1]), first + 3 * span + len(p.texts[i]))
        got = align(p.texts[i], text[start:stop], int(p.edits[i]))
        if got:
            seen.add((dd, i))
            out.append((dd, i, got[0], start + got[1] - int(off[dd])))
    return out


def blocks(benchmark: DataFrame, item: str, text: str, size: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in runs of about size bytes; one block at a time is on the driver."""
    held, n = [], 0
    for r in benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(item, text).distinct().toLocalIterator():
        held.append((r[0], r[1]))
        n += len(r[1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, patterns, edits, end): each benchmark item found in a document.

    patterns: how many of the item's patterns were found; edits: the fewest of any; end: the least
    place where one ends, in bytes of the normal text.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType.simpleString()
    schema = f"{key} {kind}, item_id {item_kind}, patterns int, edits int, end long"
    item_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[item_kind]
    out = spark.createDataFrame([], schema)
    for rows in blocks(benchmark, item, item_text):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            p = Patterns.of(shared.value)
            for batch in batches:
                for part in slices(batch, text):
                    best: dict[tuple[int, int], list[int]] = {}
                    for d, i, e, end in search(p, *raw(part.column(1))):
                        for who in p.items[i]:
                            was = best.setdefault((d, who), [0, e, end])
                            was[0] += 1
                            was[1], was[2] = min(was[1], e), min(was[2], end)
                    ids = part.column(0).take(pa.array([d for d, _ in best], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array([i for _, i in best], item_type), *(pa.array([v[k] for v in best.values()], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int64())))],
                        names=[key, "item_id", "patterns", "edits", "end"],
                    )

        out = out.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return out
