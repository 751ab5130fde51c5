"""Secrets in texts: stated patterns, and strings that a Markov model finds random rather than written.

Two character models, of random strings and of ordinary identifiers, are trained from labelled
samples: smoothed counts of each character after each. Samples are the corpus's own (values of the stated
patterns, and the other words and identifiers of a bounded number of documents) and made ones, so that
alphabets that the corpus lacks are known too. A candidate (a run of letters, digits and
a few signs, long enough, with a letter and a digit) is a secret if its mean log-likelihood
ratio is above a threshold that the labelled samples set. Spans that overlap one of a stated
pattern aren't added. Offsets are code points, ends exclusive; spans that begin together stand in
the order of KINDS. Rows that repeat get equal results; the key and other columns are only carried.

Nulls count as empty texts. Texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.sampling import under_bound

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no match of their own
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT, ALPHA = re.compile(r"[0-9]").search, re.compile(r"[A-Za-z]").search
WORD = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
KINDS = ("assign", "access", "hex", "random")
#: Documents that samples are taken from at most, and values of either kind from each.
SAMPLE_DOCS, VALUES = 2000, 50

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The stated patterns' matches, leftmost and non-overlapping within each kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def labelled(rows: int = 4000, seed: int = 5) -> list[tuple[str, bool]]:
    """Samples (text, is random): strings drawn from usual alphabets of keys, and identifiers put together from words."""
    r = random.Random(seed)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digit, upper + lower + digit + "+/", lower + digit, upper + digit, digit + "abcdef", upper + lower + digit + "_-"]
    words = "user account service request response handler manager config value index count total number name file path data table column row page session token cache image button click event state reset update create delete insert select order item price customer report summary detail version release build test error warning message string array object class method public static final return default option setting enable disable start stop first last next previous north south green river stone light water garden house winter summer market street".split()
    out = []
    for _ in range(rows // 2):
        out.append(("".join(r.choices(r.choice(alphabets), k=r.randint(20, 48))), True))
        parts = [r.choice(words) for _ in range(r.randint(3, 7))]
        style = r.randrange(4)
        name = "_".join(parts) if style == 0 else "-".join(parts) if style == 1 else "".join(p.title() for p in parts) if style == 2 else "/".join(parts)
        tail = r.choice(["", "2", "01", str(r.randint(1, 9999)), "_v" + str(r.randint(1, 20)), f"-20{r.randint(10, 29)}-{r.randint(1, 12):02d}"])
        out.append((name + tail, False))
    return out


def of_text(text: str, most: int = VALUES) -> tuple[list[str], list[str]]:
    """(values of the stated patterns, other words and identifiers) of a text: distinct, and at most so many of each, those of the least crc32."""
    stated = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    stated += [(s, e) for kind, s, e in base_spans(text) if kind != "assign"]
    secret = {text[s:e] for s, e in stated}
    left = list(text)
    for s, e in stated:
        left[s:e] = " " * (e - s)
    # A long run with a digit may be a secret that nobody has labelled.
    plain = {x for x in WORD.findall("".join(left)) if len(x) < 20 or not DIGIT(x)}
    return tuple(sorted(x, key=lambda v: zlib.crc32(v.encode()))[:most] for x in (secret, plain))


def found_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_DOCS) -> list[tuple[str, bool]]:
    """Samples (text, is random) from at most rows documents, those of the least key hashes, VALUES of either kind from each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [of_text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1))], names=["h", "secret", "plain"])

    some = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(F.lit(17), F.col(key)).alias("h"), F.col(text).alias("t"))
    found = under_bound(some, docs, rows).mapInArrow(run, "h long, secret array<string>, plain array<string>").orderBy("h", "secret", "plain").limit(rows).collect()
    kinds = {v: True for r in found for v in r["secret"]} | {v: False for r in found for v in r["plain"]}
    return sorted(kinds.items())


class Markov:
    """Log-likelihood ratio of a character after another, random against ordinary."""

    def __init__(self, samples: list[tuple[str, bool]], smooth: float = 0.5):
        count = np.full((2, 128, 128), 0.0)
        for text, kind in samples:
            b = np.frombuffer(("\x01" + text).encode("ascii", "replace"), np.uint8)
            np.add.at(count[int(kind)], (b[:-1], b[1:]), 1)
        used = [i for i in range(128) if chr(i).isalnum() or chr(i) in "+/_=-"]
        table = np.zeros((2, 128, 128))
        for k in (0, 1):
            c = count[k][:, used] + smooth
            table[k][:, used] = np.log(c / c.sum(1, keepdims=True))
        self.ratio = table[1] - table[0]
        scores = [(self.score(t), kind) for t, kind in samples]
        grid = np.sort([s for s, _ in scores])
        plain = np.sort([s for s, kind in scores if not kind])
        # Above 999 of 1000 ordinary samples by a tenth of the scores' spread: clean texts are left alone.
        self.threshold = float(np.quantile(plain, 0.999) + 0.1 * (grid[-1] - grid[0])) if len(plain) else 0.0

    def score(self, text: str) -> float:
        b = np.frombuffer(("\x01" + text).encode("ascii", "replace"), np.uint8)
        return float(self.ratio[b[:-1], b[1:]].mean()) if len(text) else -1.0


def spans(text: str, model: Markov) -> list[Span]:
    """All spans by start, then by kind as listed in KINDS."""
    out = base_spans(text)
    # Base spans as runs that don't touch, so that one search tells whether a candidate meets any.
    begin, end = [], []
    for s, e in sorted((s, e) for _, s, e in out):
        if end and s < end[-1]:
            end[-1] = max(end[-1], e)
        else:
            begin.append(s)
            end.append(e)
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if DIGIT(run) and ALPHA(run) and model.score(run) > model.threshold:
            s, e = m.span()
            k = bisect_right(end, s)
            if k == len(begin) or begin[k] >= e:
                out.append(("random", s, e))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: list[tuple[str, bool]] | None = None) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Markov(labelled() if samples is None else samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for t in batch.column(1):
                found = spans(t.as_py() or "", model)
                base = [x for x in found if x[0] != "random"]
                n = [sum(x[0] == k for x in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]", samples: list[tuple[str, bool]] | None = None) -> DataFrame:
    """docs with every span of text replaced by mask; all else stays, and so do rows without secrets."""
    shared = docs.sparkSession.sparkContext.broadcast(Markov(labelled() if samples is None else samples))
    place = docs.columns.index(text)

    def clean(t: str | None, model: Markov) -> str | None:
        if not t:
            return t
        out, at, end = [], 0, 0
        for _, s, e in spans(t, model):
            if s >= end:
                out += [t[at:s], mask]
            at = end = max(end, e)
        return "".join([*out, t[at:]]) if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            col = batch.column(place)
            yield batch.set_column(place, batch.schema.field(place), pa.array([clean(t.as_py(), model) for t in col], col.type))

    return docs.mapInArrow(run, docs.schema)
