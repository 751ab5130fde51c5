"""Repeated passages of whole texts, by a distributed difference-cover suffix array.

A byte is removed when a string of `length` bytes that covers it also starts anywhere else, in the same text or another.

1. Anchors. Each text is cut into phrases at anchors, places that the bytes around them decide alone: where the hash of
   16 bytes is the least of those `radius` to the left and right. A string belongs to the first anchor that its own bytes decide, so
   equal strings belong to equal places; nearly all hold a phrase behind it. A phrase that occurs once in all texts can't lie within a
   repeat and is set aside. Strings that hold no phrase (short periods for hundreds of bytes, and where one meets the next) are taken
   each content once a text, in runs of 16 by a place that they decide; those whose runs hold what another's do are compared in step 4.
2. Suffix array of the phrases. Of each text's phrases the places 1 and 2 modulo 3 are sampled; their triples are sorted and named, names
   are recursed on until they are told apart or reach as far as a string can; then the places 0 modulo 3 are merged in: a suffix is
   compared by its first phrases and the rank of the sampled suffix behind them. Each merge is a sort by ranges with running counts.
3. Adjacent prefixes are compared. What two neighbours share, in whole phrases, is the longest that a suffix shares with any other; all
   strings within it are repeats.
4. What remains are strings at the rims of shared runs, which begin or end within phrases that differ. Each belongs to one
   anchor, so they are merged by the bytes up to and behind it: first runs of 16 by what they all hold, then each string of those that met their like,
   under a hash of 128 bits of what the run holds and the bytes beside it, together with one string for each content among those that step 3 has found already.

Copies of one text enter once. Tasks hold one text, or 1 MB of texts, at a time; the driver holds one number a partition. No shuffle groups rows of a phrase: counts are
aggregated, and joins on phrases can be split.

Cases. Null and empty texts, and texts shorter than length, have nothing removed; a text of length bytes or more with an equal one is removed
as a whole. Rows that repeat, also with one id or none, are copies like any others. Ids may be of any type, other columns are left alone, an empty table gives no rows.
Phrases are told apart by 62 bits, so a false repeat needs equal hashes of different phrases in all places where two strings of length bytes differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm import ngram_join
from linkforge.llm.resample import numbered
from linkforge.llm.text import mix, raw, slices
from linkforge.session import release, settled

WIDTH = 16
_U, _W = np.uint64, np.uint32
_BYTES = np.random.default_rng(11).integers(1, 2**63, (4, 256), dtype=np.uint64) | _U(1)
_PLACES = np.random.default_rng(13).integers(1, 2**63, 4096, dtype=np.uint64) | _U(1)
#: The length of the next phrase where a text has none.
NONE = 1 << 30
#: Strings that are judged together by the bytes they all hold. Sixteen bytes beside these, as two words, tell them apart.
BLOCK = 16


class Cut:
    """The measures of anchors for repeats of a length."""

    def __init__(self, length: int) -> None:
        if not 64 <= length <= 4096:
            raise ValueError("length must be between 64 and 4096 bytes")
        self.length, self.radius = length, length // 11
        #: A string holds no phrase longer than this between anchors that its own bytes decide.
        self.longest = length - 2 * self.radius - WIDTH

    def lows(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the 16 bytes from each place on, and the least hash of radius places from each on."""
        n, r = len(buf), self.radius
        h = (_BYTES[0] >> _U(32)).astype(_W)[buf]
        step = 1
        while step < WIDTH:
            nxt = h.copy()
            nxt[: n - step] = (h[: n - step] ^ (h[: n - step] >> _W(15))) * _W(0x9E3779B1) + h[step:] * _W(0x85EBCA6B)
            h, step = nxt ^ (nxt >> _W(13)), 2 * step
        low, step = h, 1
        while 2 * step <= r:
            nxt = low.copy()
            np.minimum(low[: n - step], low[step:], out=nxt[: n - step])
            low, step = nxt, 2 * step
        m = low.copy()
        np.minimum(low[: n - (r - step)], low[r - step :], out=m[: n - (r - step)])
        return h, m

    def anchors(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The places in order whose hash is less than those of radius places before and not above those of as many behind."""
        n, r = len(buf), self.radius
        h, m = self.lows(buf)
        best = np.zeros(n, bool)
        if n > 2 * r + WIDTH:
            mid = h[r : n - r]
            best[r : n - r] = (mid < m[: n - 2 * r]) & (mid <= m[r + 1 : n - r + 1])
        at = np.flatnonzero(best)
        doc = np.searchsorted(off, at, "right") - 1
        return at[(at >= off[doc] + r) & (at <= off[doc + 1] - r - WIDTH)]

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of one row a phrase: doc, k, a (its place in the text), n, nn (the next one's length), lo and hi (the
        first and last string that belongs to the anchor at a: those that hold the phrase and no anchor before it), c (its name)."""
        at = self.anchors(buf, off)
        count = len(at)
        doc = np.searchsorted(off, at, "right") - 1
        k = np.arange(count) - np.searchsorted(doc, doc)
        begin, end = off[doc], off[doc + 1]
        r = self.radius
        follows = np.append(doc[1:] == doc[:-1], False)[:count]
        n = np.where(follows, np.append(at[1:], 0)[:count] - at, NONE)
        before = np.where(k > 0, np.append(0, at[:-1])[:count], begin + r - 1)
        lo = np.maximum(np.maximum(before + 1 - r, at + n + r + WIDTH - self.length), begin)
        hi = np.minimum(at - r, end - self.length)
        keep = np.flatnonzero(n <= self.longest)
        c = np.zeros(count, np.int64)
        if len(keep):
            # A phrase is read by words of 8 bytes, the last of which ends with it; or by bytes, where radius lets it be shorter.
            size, width = n[keep], 8 if self.radius >= 8 else 1
            held = -(-size // width)
            start = np.cumsum(held) - held
            nth = _ranges(np.zeros(len(keep), np.int64), held)
            word = words_at(buf, np.repeat(at[keep], held) + np.minimum(width * nth, np.repeat(size, held) - width), width)
            term = (word ^ (word >> _U(32))) * _PLACES[nth]
            term ^= term >> _U(29)
            term *= _U(0x94D049BB133111EB)
            term ^= term >> _U(31)
            h = np.add.reduceat(term * _U(0xBF58476D1CE4E5B9), start)
            h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB) + size.astype(_U)
            c[keep] = ((h ^ (h >> _U(31))) >> _U(2)).astype(np.int64) + 1
        nn = np.append(n[1:], NONE)[:count]
        nn = np.where(follows, nn, NONE)
        out = {"doc": doc, "k": k, "a": at - begin, "n": n, "nn": nn, "lo": lo - begin, "hi": hi - begin, "c": c}
        return {name: x[keep] for name, x in out.items()}

    def bare(self, x: dict[str, np.ndarray], off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, first, last) of the runs of strings that hold no phrase, so that no anchor owns them."""
        some = np.flatnonzero(x["lo"] <= x["hi"])
        doc, lo, hi = x["doc"][some], x["lo"][some], x["hi"][some]
        docs = np.flatnonzero(np.diff(off) >= self.length)
        # Owned runs ascend and don't meet: what lies between them, before the first and behind the last.
        all_doc = np.concatenate((doc, docs))
        begin = np.concatenate((hi + 1, np.zeros(len(docs), np.int64)))
        end_doc = np.concatenate((doc, docs))
        end = np.concatenate((lo - 1, (off[docs + 1] - off[docs]) - self.length))
        first, last = np.lexsort((begin, all_doc)), np.lexsort((end, end_doc))
        wide = begin[first] <= end[last]
        return all_doc[first][wide], begin[first][wide], end[last][wide]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1... for each run of a size, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def words_at(buf: np.ndarray, at: np.ndarray, width: int = 8) -> np.ndarray:
    """The bytes of each place and those behind it, width of them, as numbers; the first byte is the lowest."""
    if width == 1:
        return _BYTES[1][buf[at]]
    return np.ndarray((max(0, len(buf) - 7),), "<u8", np.ascontiguousarray(buf), strides=(1,))[at]


def word_hashes(buf: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the size bytes from each place on, read by words of 8 bytes, the last of which ends with them."""
    spots = np.minimum(8 * np.arange(-(-size // 8)), size - 8)
    out = np.zeros((2, len(at)), _U)
    for begin in range(0, len(at), 1024):
        part = slice(begin, begin + 1024)
        word = words_at(buf, at[part, None] + spots)
        for seed in (0, 1):
            out[seed, part] = mix(word + _PLACES[1024 * seed : 1024 * seed + len(spots)]).sum(1)
    return mix(out[0]), mix(out[1])


def window_hashes(buf: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each length bytes of buf: halves of powers of two are combined."""
    h, step, out, have = _BYTES[seed][buf], 1, None, 0

    def joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
        m = max(0, min(len(a), len(b) - gap))
        x = (a[:m] ^ (a[:m] >> _U(31))) * _U(0x94D049BB133111EB) + b[gap : gap + m] * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(29))

    while step <= length:
        if length & step:
            out = h if out is None else joined(out, h, have)
            have += step
        h, step = joined(h, h, step), 2 * step
    return out[: max(0, len(buf) - length + 1)]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of an ascending integer key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _np(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(x).to_numpy() for x in names]


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


#: Values of k in the rows of parsed() that are no phrases: a text's digest; a run of strings without phrases; a run that repeats within its text.
HEAD, BARE, KNOWN = -1, -2, -3
#: Strings without phrases that are hashed at a time.
RUN = 1 << 17


def _bare_rows(cut: Cut, x: dict[str, np.ndarray], buf: np.ndarray, off: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Columns doc, k, a and more. BARE: the strings lo to hi without phrases, each content once a text, whose distance from the place a is in one run of BLOCK, and a hash c
    of that run and of what all its strings hold. KNOWN: n bytes at a, a run of strings that occur twice in a text.

    The place a of a string is the first where the least hash of radius places changes, or its own start; its own bytes decide that.
    """
    doc, first, last = cut.bare(x, off)
    count = last - first + 1
    pieces = -(-count // RUN)
    doc, part = np.repeat(doc, pieces), _ranges(np.zeros(len(doc), np.int64), pieces)
    first, count = np.repeat(first, pieces) + part * RUN, np.minimum(RUN, np.repeat(count, pieces) - part * RUN)
    total, begin = np.cumsum(count), 0
    while begin < len(doc):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + RUN)))
        d, f, c = doc[begin:stop], first[begin:stop], count[begin:stop]
        begin = stop
        size = c + cut.length - 1
        piece = buf[_ranges(off[d] + f, size)]
        spot = _ranges(np.cumsum(size) - size, c)
        g1, g2 = (window_hashes(piece, cut.length, seed)[spot] for seed in (2, 3))
        d, i = np.repeat(d, c), _ranges(f, c)
        order = np.lexsort((i, g2, g1, d))
        same = (d[order][1:] == d[order][:-1]) & (g1[order][1:] == g1[order][:-1]) & (g2[order][1:] == g2[order][:-1])
        again = np.zeros(len(d), bool)
        again[order[1:]] |= same
        fresh = np.sort(order[np.concatenate(([True], ~same))]) if len(order) else order
        low = cut.lows(piece)[1]
        turns = np.append(np.flatnonzero(low[1:] != low[:-1]) + 1, len(piece))
        at = spot[fresh]
        turn = turns[np.searchsorted(turns, at, "right")]
        turn = np.where(turn <= at + cut.length - cut.radius - WIDTH + 1, turn, at)
        b = (turn - at) // BLOCK
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (turn[1:] != turn[:-1]) | (b[1:] != b[:-1])))[: len(at)])
        end = np.append(new[1:], len(at))[: len(new)] - 1
        held = word_hashes(piece, turn[new] - BLOCK * b[new], cut.length - BLOCK + 1)[0]
        lo = i[fresh][new]
        yield {"doc": d[fresh][new], "k": np.full(len(new), BARE), "a": lo + turn[new] - at[new], "lo": lo, "hi": i[fresh][end], "c": mix(held + b[new].astype(_U)).view(np.int64)}
        again[order[:-1]] |= same
        at = np.flatnonzero(again)
        if len(at):
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (d[at][1:] != d[at][:-1]) | (i[at][1:] != i[at][:-1] + 1)))
            b, e = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
            yield {"doc": d[b], "k": np.full(len(b), KNOWN), "a": i[b], "n": i[e] - i[b] + cut.length}


def parsed(docs: DataFrame, text: str, cut: Cut) -> DataFrame:
    """(tid, k, a, n, nn, lo, hi, c, digest): the phrases of all texts of length bytes; and where k is HEAD a text's digest, BARE or KNOWN
    a row of _bare_rows()."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a copy in one task is cut once
        for batch in batches:
            digests = batch.column(2).to_pylist()
            fresh = [not (d in seen or seen.add(d)) for d in digests]
            for part in slices(batch.filter(pa.array(fresh, pa.bool_())), "text"):
                buf, off = raw(part.column(1))
                tid, m = part.column(0), part.num_rows

                def batch_of(doc: np.ndarray, digest: pa.Array | None = None, tid: pa.Array = tid, **cols: np.ndarray) -> pa.RecordBatch:
                    size = len(doc)
                    ints = {c: pa.array(cols[c].astype(np.int32)) if c in cols else pa.nulls(size, pa.int32()) for c in ("k", "a", "n", "nn", "lo", "hi")}
                    names = pa.array(cols["c"]) if "c" in cols else pa.nulls(size, pa.int64())
                    return _batch({"tid": tid.take(pa.array(doc)), **ints, "c": names, "digest": pa.nulls(size, pa.binary()) if digest is None else digest})

                yield batch_of(np.arange(m), digest=part.column(2), k=np.full(m, HEAD))
                x = cut.phrases(buf, off)
                yield batch_of(**x)
                for more in _bare_rows(cut, x, buf, off):
                    yield batch_of(**more)

    long_enough = docs.where(F.octet_length(text) >= cut.length).select(F.monotonically_increasing_id().alias("tid"), F.col(text).alias("text"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("digest"))
    return long_enough.mapInArrow(rows, "tid long, k int, a int, n int, nn int, lo int, hi int, c long, digest binary")


def counted(df: DataFrame, order: list[Column], flag: str) -> DataFrame:
    """df, settled, with nth and before: a row's place in the order, from 0, and how many rows before it have the flag.

    Tasks sort ranges apart; the driver keeps two numbers a partition.
    """
    kind = df.drop(flag).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = flags = 0
        for batch in batches:
            f = batch.column(batch.schema.get_field_index(flag)).to_numpy(zero_copy_only=False).astype(np.int64)
            kept = batch.drop_columns([flag])
            yield _batch({**dict(zip(kept.schema.names, kept.columns)), "nth": pa.array(rows + np.arange(len(f))), "before": pa.array(flags + np.cumsum(f) - f), "flag": pa.array(f)})
            rows, flags = rows + len(f), flags + int(f.sum())

    out = settled(cut.mapInArrow(run, f"{kind}, part int, nth long, before long, flag long"), "counted")
    begin, rows, flags = [], 0, 0
    for part, n, f in sorted(map(tuple, out.groupBy("part").agg(F.count("*"), F.sum("flag")).collect())):
        begin.append((part, rows, flags))
        rows, flags = rows + n, flags + f
    starts = df.sparkSession.createDataFrame(begin or [(0, 0, 0)], "part int, row0 long, flag0 long")
    moved = out.join(F.broadcast(starts), "part").select(*(c for c in df.columns if c != flag), (F.col("nth") + F.col("row0")).alias("nth"), (F.col("before") + F.col("flag0")).alias("before"))
    moved.settled_path = out.settled_path
    return moved


def suffix_ranks(symbols: DataFrame, need: int) -> DataFrame:
    """(tid, q, j, rank) of every suffix of the strings (tid, q) of symbols c at places j, settled.

    symbols: (tid, q, j, c, more, span): more tells whether place j + 1 goes on, span how many bytes a symbol stands for. Suffixes
    that share need bytes rank side by side in any order; a string that ends ranks before those that go on.
    """
    text = Window.partitionBy("tid", "q").orderBy("j")

    def behind(name: str, by: int, goes_on: str, otherwise: object) -> Column:
        return F.coalesce(F.when(F.col(goes_on), F.lead(name, by).over(text)), F.lit(otherwise))

    triples = (
        symbols.withColumns({"c1": behind("c", 1, "more", 0), "more1": behind("more", 1, "more", False), "span1": behind("span", 1, "more", 0)})
        .withColumns({"c2": behind("c", 2, "more1", 0), "more2": behind("more", 2, "more1", False), "span2": behind("span", 2, "more1", 0)})
        .select("tid", "q", "j", "c", "c1", "c2", "more", "more1", "more2", (F.col("span") + F.col("span1") + F.col("span2")).alias("reach"))
    )
    triples = settled(triples, "triples")
    sampled = triples.where("j % 3 != 0")
    kinds = sampled.groupBy("c", "c1", "c2").agg(F.count("*").alias("held"), F.max("more2").alias("on"), F.min("reach").alias("reach"))
    named = numbered(kinds, [F.col("c"), F.col("c1"), F.col("c2")], "name")
    open_ = named.where((F.col("held") > 1) & F.col("on") & (F.col("reach") < need)).limit(1).count()
    below = sampled.join(named.select("c", "c1", "c2", "name"), ["c", "c1", "c2"]).select(
        "tid", (F.col("q") * 2 + F.col("j") % 3 - 1).alias("q"), F.expr("int(j div 3)").alias("j"), (F.col("name") + 1).alias("c"), F.col("more2").alias("more"), F.col("reach").alias("span")
    )
    if open_:
        below = settled(below, "names")
        ranks = suffix_ranks(below, need)
        release(below)
    else:
        ranks = numbered(below.select("tid", "q", "j", "c"), [F.col("c"), F.col("tid"), F.col("q"), F.col("j")], "rank")
    back = ranks.select("tid", F.expr("q div 2").alias("q"), (F.col("j") * 3 + (F.col("q") % 2).cast("int") + 1).alias("j"), (F.col("rank") + 1).alias("rank"))
    at = triples.join(back, ["tid", "q", "j"], "left")
    at = at.withColumns({"rank1": behind("rank", 1, "more", 0), "rank2": behind("rank", 2, "more1", 0)})
    at = settled(at.select("tid", "q", "j", "c", "c1", "rank", "rank1", "rank2"), "ranks")
    # A suffix at a place 0 modulo 3 against those at 1: first symbol, then the ranks behind. Against those at 2: two symbols first.
    tie = [F.col("sampled"), F.col("tid"), F.col("q"), F.col("j")]
    is_sampled = F.col("j") % 3 != 0
    one = counted(at.where("j % 3 != 2").select("tid", "q", "j", "c", "rank", "rank1", is_sampled.alias("sampled"), is_sampled.alias("flag")), [F.col("c"), F.col("rank1"), *tie], "flag")
    two = counted(at.where("j % 3 != 1").select("tid", "q", "j", "c", "c1", "rank", "rank2", is_sampled.alias("sampled"), is_sampled.alias("flag")), [F.col("c"), F.col("c1"), F.col("rank2"), *tie], "flag")
    zero = one.where("not sampled").select("tid", "q", "j", "nth").join(two.where("not sampled").select("tid", "q", "j", "before"), ["tid", "q", "j"])
    here = zero.select("tid", "q", "j", (F.col("nth") + F.col("before")).alias("rank"))
    rest = [x.where("sampled").select("tid", "q", "j", (F.col("rank") - 1 + F.col("nth") - F.col("before")).alias("rank")) for x in (one, two)]
    out = settled(here.unionByName(rest[0]).unionByName(rest[1]), "suffixes")
    release(named, ranks, triples, at, one, two)
    return out


def shared_runs(phrases: DataFrame, cut: Cut) -> DataFrame:
    """phrases (tid, k, a, n, nn, lo, hi, c), with common: the bytes of the longest run of whole phrases from k on that also starts elsewhere,
    as far as it matters, and after: the length of the phrase behind it."""
    more = F.coalesce(F.lead("k").over(Window.partitionBy("tid").orderBy("k")) == F.col("k") + 1, F.lit(False))
    strings = settled(phrases.select("tid", F.lit(0).cast("long").alias("q"), F.col("k").alias("j"), "c", more.alias("more"), F.col("n").alias("span")), "strings")
    ranks = suffix_ranks(strings, cut.length + 3 * cut.longest)
    placed = numbered(ranks.select("tid", F.col("j").alias("k"), "rank"), [F.col("rank"), F.col("tid"), F.col("k")], "place")
    rows = phrases.join(placed.select("tid", "k", "place"), ["tid", "k"]).repartition("tid").sortWithinPartitions("tid", "k")
    size = 1 << 12

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each suffix with the names of its first phrases, as far as strings of its own and the next phrase reach; suffixes at a block's start also in the block before."""
        for t in whole_groups(batches, "tid"):
            tid, k, a, n, c, place = _np(t, "tid", "k", "a", "n", "c", "place")
            m = len(tid)
            joined = (tid[1:] == tid[:-1]) & (k[1:] == k[:-1] + 1)
            run = np.concatenate(([0], np.cumsum(~joined)))  # number of the unbroken stretch of phrases
            # Places on one line, so that reaches are found by one search.
            shift = run.astype(np.int64) << 33
            next_n = np.append(np.where(joined, n[1:], 0), 0)
            to = np.searchsorted(shift + a, shift + a + cut.length + n + next_n)
            to = np.minimum(np.maximum(to, np.arange(m) + 1), np.searchsorted(run, run, "right"))
            for lo in range(0, m, 1 << 16):
                part = slice(lo, min(m, lo + (1 << 16)))
                count = (to - np.arange(m))[part]
                at = np.repeat(np.arange(m)[part] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                ends = (a + n)[at] - np.repeat(a[part], count)
                off = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
                piece = t.slice(part.start, part.stop - part.start).combine_chunks()
                cols = {x: piece.column(x).combine_chunks() for x in ("tid", "k", "a", "n", "nn", "lo", "hi", "c", "place")}
                cols |= {"names": pa.ListArray.from_arrays(off, pa.array(c[at])), "ends": pa.ListArray.from_arrays(off, pa.array(ends.astype(np.int32))), "nexts": pa.ListArray.from_arrays(off, pa.array(t.column("nn").to_numpy()[at].astype(np.int32)))}
                block = place[part] // size
                edge = np.flatnonzero((place[part] % size == 0) & (place[part] > 0))
                yield _batch({**cols, "block": pa.array(block)})
                if len(edge):
                    yield _batch({**{x: v.take(pa.array(edge)) for x, v in cols.items()}, "block": pa.array(block[edge] - 1)})

    kind = "tid long, k int, a int, n int, nn int, lo int, hi int, c long, place long"
    spread = rows.mapInArrow(prefixes, f"{kind}, names array<long>, ends array<int>, nexts array<int>, block long")
    dealt = spread.repartition("block").sortWithinPartitions("block", "place")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block"):
            block, place = _np(t, "block", "place")
            names, ends, nexts = (t.column(x).combine_chunks() for x in ("names", "ends", "nexts"))
            off, flat = names.offsets.to_numpy(), names.values.to_numpy()
            count = np.diff(off)
            same = np.zeros(len(place), np.int64)  # phrases shared with the one before
            live = np.flatnonzero(block[1:] == block[:-1]) + 1
            depth = 0
            while len(live):
                live = live[(count[live] > depth) & (count[live - 1] > depth)]
                live = live[flat[off[live] + depth] == flat[off[live - 1] + depth]]
                depth += 1
                same[live] = depth
            # The last row of a full block is the first of the next one, which only lends its prefix.
            most = np.maximum(same, np.append(same[1:], 0))
            last = off[:-1] + most - 1
            some = most > 0
            # A suffix at a block's start is seen in two blocks: the greater of both is taken later.
            own = {x: t.column(x).combine_chunks() for x in ("tid", "k", "a", "n", "nn", "lo", "hi", "c")}
            common = np.where(some, ends.values.to_numpy()[np.where(some, last, 0)], 0)
            after = np.where(some, nexts.values.to_numpy()[np.where(some, last, 0)], 0)
            yield _batch({**own, "common": pa.array(common.astype(np.int32)), "after": pa.array(after.astype(np.int32)), "edge": pa.array(place % size == 0)})

    found = settled(dealt.mapInArrow(compared, "tid long, k int, a int, n int, nn int, lo int, hi int, c long, common int, after int, edge boolean"), "compared")
    release(strings, ranks, placed)
    own = ["tid", "k", "a", "n", "nn", "lo", "hi", "c"]
    twice = found.where("edge").groupBy(*own).agg(F.max(F.struct("common", "after")).alias("m")).select(*own, "m.common", "m.after")
    out = found.where("not edge").drop("edge").unionByName(twice)
    out.settled_path = found.settled_path
    return out


_P1, _P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(p: int, n: int) -> np.ndarray:
    steps = np.full(n, p, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def rims(runs: DataFrame, cut: Cut) -> DataFrame:
    """(tid, a, lo, hi, c, inside, h1, h2, left, right) of the anchors whose strings lo to hi may be repeats: inside tells that they all lie in a shared run, and then h1
    and h2 are the hash of the run's part that holds them."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "tid"):
            tid, k, a, n, lo, hi, c, common, after = (x.astype(np.int64) for x in _np(t, "tid", "k", "a", "n", "lo", "hi", "c", "common", "after"))
            m = len(tid)
            joined = np.concatenate(([False], (tid[1:] == tid[:-1]) & (k[1:] == k[:-1] + 1)))
            # The last string that may be a repeat: no anchor behind the shared run is decided by the string.
            hi = np.minimum(hi, a + common + after - cut.length + cut.radius + WIDTH - 1)
            able = (common > 0) & (lo <= hi)
            inside = np.zeros(m, bool)
            from_ = np.zeros(m, np.int64)
            for back in (0, 1, 2):
                ok = np.ones(m, bool)
                for b in range(back):
                    ok[b:] &= joined[: m - b] if b else joined
                    ok[:b] = False
                src = np.maximum(np.arange(m) - back, 0)
                now = ok & (a[src] <= lo) & (a[src] + common[src] - cut.length >= hi) & able & ~inside
                inside |= now
                from_[now] = src[now]
            run = np.cumsum(~joined)
            to = np.searchsorted((run << 33) + a + n, (run << 33) + hi + cut.length)
            to = np.minimum(to + 1, np.searchsorted(run, run, "right"))
            sums = []
            for p in (_P1, _P2):
                total = np.zeros(m + 1, _U)
                np.cumsum(c.astype(_U) * _powers(p, m), out=total[1:])
                back = _powers(pow(p, -1, 1 << 64), m)
                sums.append(((total[to] - total[from_]) * back[from_]).view(np.int64))
            keep = np.flatnonzero(able)
            cols = {"tid": tid, "a": a, "lo": lo, "hi": hi, "c": c, "inside": inside, "h1": sums[0], "h2": sums[1], "left": lo - a[from_], "right": hi - a[from_]}
            yield _batch({x: pa.array(v[keep]) for x, v in cols.items()})

    by_text = runs.repartition("tid").sortWithinPartitions("tid", "k")
    return by_text.mapInArrow(rows, "tid long, a long, lo long, hi long, c long, inside boolean, h1 long, h2 long, left long, right long")


#: Of the sixteen bytes on a side, as two words, those next to what a run holds: 0 to 15 of them.
_BEHIND = [np.array([(1 << 8 * min(8, max(0, t - skip))) - 1 for t in range(BLOCK)], _U) for skip in (0, 8)]
_BEFORE = [x.byteswap() for x in _BEHIND]
SIDES = ("l0", "l1", "r0", "r1")


def folded(h: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The hashes h with words mixed in one by one."""
    for w in words:
        h = mix(h * _U(0xD6E8FEB86659FD93) + w)
    return h


def blocks_of(texts: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """(tid, lo, hi, last, b, u, g1, g2, l0, l1, r0, r1) for the strings that start in a range (tid, a, lo, hi) of their text.

    Runs of BLOCK strings, counted by their distance from the anchor a, are one row each with the hash of what they all hold: equal strings lie in runs of one
    number b and one hash. u is the hash of all that a whole run covers, null for a part of one; last is a whole run's last string, and the SIDES are the bytes on either
    side of what the run holds, as far as its strings reach.
    """
    wanted = ranges.groupBy("tid").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("ranges"))
    pad = np.zeros(BLOCK, np.uint8)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = raw(part.column(1))
                spots = part.column(2)
                each = np.repeat(np.arange(part.num_rows), np.diff(spots.offsets.to_numpy()))
                inner = spots.flatten()
                anchor, lo, hi = (inner.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in range(3))
                first, last = (anchor - hi) // BLOCK, (anchor - lo) // BLOCK
                count = last - first + 1
                d, x, y, p = (np.repeat(v, count) for v in (each, lo, hi, anchor))
                b = _ranges(first, count)
                end = p - BLOCK * b  # the last string of a run, and so the first byte that all of them hold
                whole = (end - BLOCK + 1 >= x) & (end <= y)
                bytes_ = np.concatenate((pad, buf, pad))
                place = off[d] + end + BLOCK
                g1, g2 = word_hashes(bytes_, place, length - BLOCK + 1)
                behind = place + length - BLOCK + 1
                sides = [words_at(bytes_, w) for w in (place - 8, place - 16, behind, behind + 8)]
                u = folded(g1, [w & m[BLOCK - 1] for w, m in zip(sides, _BEFORE + _BEHIND)])
                cols = {"lo": np.maximum(x, end - BLOCK + 1), "hi": np.minimum(y, end), "last": end, "b": b}
                longs = {"g1": g1, "g2": g2, **dict(zip(SIDES, sides))}
                yield _batch({"tid": part.column(0).take(pa.array(d)), **{k: pa.array(v.astype(np.int32)) for k, v in cols.items()}, "u": pa.array(u.view(np.int64), mask=~whole), **{k: pa.array(v.view(np.int64)) for k, v in longs.items()}})

    kind = "tid long, lo int, hi int, last int, b int, u long, g1 long, g2 long, l0 long, l1 long, r0 long, r1 long"
    return texts.join(wanted.hint("shuffle_hash"), "tid").select("tid", "text", "ranges").mapInArrow(rows, kind)


def judged(blocks: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(spans, strings) of runs from blocks_of(): the spans (tid, s, e) of whole runs that occur twice, and the strings (tid, lo, g1, g2) of runs whose common part
    occurs with different surroundings, of one run for each of these, still to be compared by their hashes g1 and g2."""
    core = ["g1", "g2", "b"]
    # A part of a run stands for itself.
    own = F.coalesce(F.col("u"), F.xxhash64("tid", "lo"))
    some = ["tid", "lo", "hi", "last", *SIDES]  # of one row, whichever comes first
    kinds = blocks.groupBy(*core, own.alias("own")).agg(F.count("*").alias("held"), *(F.first(x).alias(x) for x in some))
    kinds = settled(kinds, "kinds")
    several = kinds.groupBy(*core).agg(F.count("*").alias("n")).where("n > 1").select(*core)
    left = kinds.join(several.hint("shuffle_hash"), core, "left_semi").select(*core, *some)
    twice = blocks.withColumn("own", own).join(kinds.where("held > 1").select(*core, "own").hint("shuffle_hash"), [*core, "own"], "left_semi")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each string by what its run holds and its own bytes on either side."""
        for batch in batches:
            g1, g2, b, _, lo, hi, last, *sides = (x.to_numpy() for x in batch.columns)
            count = hi - lo + 1
            each, i = np.repeat(np.arange(len(lo)), count), _ranges(lo, count)
            t = last[each] - i
            masks = [x[t] for x in _BEFORE] + [x[BLOCK - 1 - t] for x in _BEHIND]
            words = [(b[each].astype(np.int64) * BLOCK + t).astype(_U), *(w[each].view(_U) & m for w, m in zip(sides, masks))]
            names = [pa.array(folded(g[each].view(_U), words).view(np.int64)) for g in (g1, g2)]
            yield _batch({"tid": batch.column(3).take(pa.array(each)), "lo": pa.array(i.astype(np.int32)), "g1": names[0], "g2": names[1]})

    return twice.select("tid", F.col("lo").alias("s"), (F.col("hi") + length).alias("e")), left.mapInArrow(strings, "tid long, lo int, g1 long, g2 long")


def texts_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(tid, text) for the digests of wanted (tid, digest), once each. A bitmap of one size for any input lets few other texts into the shuffle."""
    ids = wanted.select(F.xxhash64("digest").alias("id"))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(ngram_join.id_filter(ids)))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(flags[ngram_join._places(batch.column(0))]))

    digest = F.unhex(F.sha2(F.col(text).cast("binary"), 256))
    some = docs.where(F.col(text).isNotNull()).select(F.xxhash64(digest).alias("id"), digest.alias("digest"), F.col(text).alias("text")).mapInArrow(passing, "id long, digest binary, text string")
    once = some.groupBy("digest").agg(F.first("text").alias("text"))
    return once.join(wanted.hint("shuffle_hash"), "digest").select("tid", "digest", "text")


def removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(digest, spans, n_removed, kept_sha256) of texts (tid, digest, text): the union of spans (tid, s, e), as maximal runs."""
    listed = spans.groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("found"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = raw(part.column(1))
                out = []
                spots = part.column(2)
                inner, cuts = spots.flatten(), spots.offsets.to_numpy() - spots.offsets.to_numpy()[0]
                s, e = (inner.field(x).to_numpy(zero_copy_only=False) for x in (0, 1))
                for d in range(part.num_rows):
                    here = slice(cuts[d], cuts[d + 1])
                    order = np.argsort(s[here], kind="stable")
                    begin, end = s[here][order], np.maximum.accumulate(e[here][order])
                    new = np.concatenate(([True], begin[1:] > end[:-1]))
                    begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                    h, at = hashlib.sha256(), off[d]
                    for x, y in zip(begin.tolist(), end.tolist()):
                        h.update(buf[at : off[d] + x].tobytes())
                        at = off[d] + y
                    h.update(buf[at : off[d + 1]].tobytes())
                    out.append((list(map(dict, zip((("begin", x) for x in begin.tolist()), (("end", y) for y in end.tolist())))), int((end - begin).sum()), h.hexdigest()))
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
                yield _batch({"digest": part.column(0), "spans": pa.array([o[0] for o in out], kind), "n_removed": pa.array([o[1] for o in out], pa.int64()), "kept_sha256": pa.array([o[2] for o in out], pa.string())})

    return texts.join(listed.hint("shuffle_hash"), "tid").select("digest", "text", "found").mapInArrow(rows, "digest binary, spans array<struct<begin:long,end:long>>, n_removed long, kept_sha256 string")


def repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row: what of its bytes repeats, and the SHA-256 of the rest.

    spans are the maximal removed runs as (begin, end) in bytes, end exclusive.
    """
    cut = Cut(length)
    table = settled(parsed(docs, text, cut), "phrases")
    keep = settled(table.where(F.col("k") == HEAD).groupBy("digest").agg(F.min("tid").alias("tid")), "texts")
    phrases = table.where("k >= 0")
    often = phrases.groupBy("c").count().where("count > 1").select("c")
    # Hash joins: what is joined to holds a key once, and the many rows beside it need no sort.
    again = phrases.join(often.hint("shuffle_hash"), "c", "left_semi").join(keep.select("tid").hint("shuffle_hash"), "tid", "left_semi")
    again = settled(again.select("tid", "k", "a", "n", "nn", "lo", "hi", "c"), "repeated")
    others = settled(table.where(F.col("k").isin(BARE, KNOWN)).select("tid", "k", "a", "n", "lo", "hi", "c").join(keep.select("tid").hint("shuffle_hash"), "tid", "left_semi"), "bare")
    release(table)
    runs = shared_runs(again, cut)
    anchors = settled(rims(runs, cut), "rims")
    # Strings without phrases meet only their like: runs that hold what no other does are left out.
    bare = others.where(F.col("k") == BARE)
    lone = bare.join(bare.groupBy("c").count().where("count > 1").select("c").hint("shuffle_hash"), "c", "left_semi").select("tid", "a", "lo", "hi")
    outer = anchors.where("not inside")
    # One of each content among the strings that are known to repeat, where a rim starts with the same phrase.
    inner = anchors.where("inside").join(outer.select("c").distinct(), "c", "left_semi")
    inner = inner.groupBy("h1", "h2", "left", "right").agg(F.min(F.struct("tid", "a", "lo", "hi")).alias("m")).select("m.tid", "m.a", "m.lo", "m.hi")
    ranges = settled(outer.select("tid", "a", "lo", "hi").unionByName(inner).unionByName(lone), "ranges")
    known = runs.where(F.col("common") >= length).select("tid", F.col("a").alias("s"), (F.col("a") + F.col("common")).alias("e"))
    known = known.unionByName(others.where(F.col("k") == KNOWN).select("tid", F.col("a").alias("s"), (F.col("a") + F.col("n")).alias("e")))
    wanted = keep.join(ranges.select("tid").unionByName(known.select("tid")).distinct(), "tid")
    texts = settled(texts_of(docs, text, settled(wanted.select("tid", "digest"), "wanted")), "texts")
    blocks = settled(blocks_of(texts, ranges, length), "blocks")
    runs_, strings = judged(blocks, length)
    strings = settled(strings, "strings")
    same = ["g1", "g2"]
    again_ = strings.join(strings.groupBy(*same).count().where("count > 1").select(*same).hint("shuffle_hash"), same, "left_semi")
    rim = again_.select("tid", F.col("lo").alias("s"), (F.col("lo") + length).alias("e"))
    spans = known.unionByName(rim).unionByName(runs_)
    parts = removed(texts, spans)
    # A text with copies repeats as a whole.
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(key).alias("key"), size.alias("n_bytes"), digest.alias("digest"))
    copies = rows.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    facts = settled(copies.join(parts.withColumn("digest", F.lower(F.hex("digest"))), "digest", "full"), "facts")
    release(keep, again, others, runs, anchors, ranges, texts, blocks, strings)
    at = rows.join(facts, "digest", "left")
    whole = F.col("copies").isNotNull()
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    spans_ = F.when(whole, all_of_it).otherwise(F.coalesce("spans", none))
    return at.select(
        F.col("key").alias(key), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.size(spans_).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"), spans_.alias("spans"),
    )
