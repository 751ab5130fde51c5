"""Exact n-gram Jaccard join by prefix trees.

A document is the set of its distinct n-word shingles. Two documents link when
den * |A and B| >= num * |A or B|. The steps:

1. Equal sets collapse to one representative, the least doc_id.
2. Shingles get a global order, rare ones first, from a table of hashed document counts over
   the whole input. Linked sets share a shingle among their first |A| - ceil(t|A|) + 1. These rows
   are shuffled once; only shingles that several sets have go on.
3. In each group of sets that share such a shingle, every set is held against the group's
   least one. Those that link form components, so a group of thousands of near copies costs one
   comparison a member.
4. What is left are pairs that share a prefix shingle but lie in different components; all of
   these are held against each other too, so no link is lost between components.
5. Comparisons run in prefix trees: the partners of a set, as sorted shingles, are stored in a trie
   whose nodes know the least and the greatest set below. A walk carries the overlap so far,
   shared by all sets below a node, and leaves a subtree once what remains can't reach the overlap asked for.

Shingles are compared by 64-bit hashes, sets of equal size collapse by 128 more bits. Empty and null
texts have empty sets and link with nothing. Rows with a null key link with nothing and get no
component unless a copy with a key exists. Repeated rows stay. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.llm.text import lists, mix, raw, shingles, slices, words
from linkforge.operators.components import connected_components
from linkforge.session import release, settled

_U = np.uint64
#: Rows of the hashed count table that travel together, and members that one task's trie holds.
CHUNK, TRIE = 4096, 256
#: Bits of the bitmap of ids whose sets are wanted.
FILTER_BITS = 25


def sets_of(batch: pa.RecordBatch, text: str, n: int) -> list[np.ndarray]:
    h, _, first = words(*raw(batch.column(batch.schema.get_field_index(text))))
    return shingles(h, first, n)


def _ceil(a: int | np.ndarray, b: int) -> int | np.ndarray:
    return -(-a // b)


def order_table(docs: DataFrame, text: str, n: int, bits: int) -> np.ndarray:
    """For each hash bucket the rank of its document count; 2**bits buckets, summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch, text):
                found = sets_of(part, text, n)
                np.add.at(total, (np.concatenate(found) & _U((1 << bits) - 1)).astype(np.int64), np.uint32(1))
        yield from packed((c, total[c * CHUNK : (c + 1) * CHUNK]) for c in np.flatnonzero(total.reshape(-1, CHUNK).any(1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(x), np.int64)
        yield from packed(sums.items())

    def packed(chunks: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for c, x in chunks:
            yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    kind = "chunk int, counts binary"
    chunks = docs.select(text).mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind)
    table = np.zeros(1 << bits, np.int64)
    for r in chunks.collect():  # 2**bits counts, whatever the input's size
        table[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(256 * np.log2(table + 1), (1 << 14) - 1).astype(np.uint16)


def signatures(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    """(doc_id, n, h1, h2, prefix): the size of the set, two hashes of it, and its first shingles in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        mask = _U(len(table) - 1)
        for batch in batches:
            for part in slices(batch, text):
                sizes, one, two, pre = [], [], [], []
                for s in sets_of(part, text, n):
                    m = len(s)
                    sizes.append(m)
                    one.append(int(s.sum().view(np.int64)) if m else 0)
                    two.append(int(((s ^ (s >> _U(29))) * _U(0x9E3779B97F4A7C15)).sum().view(np.int64)) if m else 0)
                    if not m:
                        pre.append(s)
                        continue
                    p = m - int(_ceil(num * m, den)) + 1
                    order = (table[(s & mask).astype(np.int64)].astype(np.uint64) << _U(48)) | (s >> _U(16))
                    at = np.argpartition(order, p - 1)[:p] if p < m else np.arange(m)
                    pre.append(s[at[np.argsort(order[at], kind="stable")]])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists(pre, pa.int64())],
                    names=["doc_id", "n", "h1", "h2", "prefix"],
                )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, n long, h1 long, h2 long, prefix array<long>")


@dataclass
class Node:
    """Shingles that all sets below share after those of the nodes above; the sets that end here; the least and greatest size below."""

    shingles: np.ndarray
    ends: list[int]
    low: int
    high: int
    below: list[Node] = field(default_factory=list)


def prefix_tree(sets: list[np.ndarray]) -> Node:
    """The trie of sorted sets, runs without a branch in one node. Sets in order lie beside those that they share most with."""
    # Big-endian bytes order as the numbers do.
    order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
    shared = [0]
    for i, j in zip(order, order[1:]):
        k = min(len(sets[i]), len(sets[j]))
        other = np.flatnonzero(sets[i][:k] != sets[j][:k])
        shared.append(int(other[0]) if len(other) else k)

    def grow(lo: int, hi: int, depth: int) -> Node:
        """The node of order[lo:hi], whose sets share their first depth shingles with the path."""
        stack = [(lo, hi, depth, None)]
        root = None
        while stack:
            lo, hi, depth, parent = stack.pop()
            end = min(shared[lo + 1 : hi], default=len(sets[order[lo]]))
            sizes = [len(sets[i]) for i in order[lo:hi]]
            ends = [i for i, m in zip(order[lo:hi], sizes) if m == end]
            node = Node(sets[order[lo]][depth:end], ends, min(sizes), max(sizes))
            if parent is None:
                root = node
            else:
                parent.below.append(node)
            at = lo + len(ends)  # sets that end here stand first
            while at < hi:
                to = at + 1
                while to < hi and shared[to] > end:
                    to += 1
                stack.append((at, to, end, node))
                at = to
        return root

    return grow(0, len(sets), 0) if sets else Node(np.zeros(0, np.uint64), [], 0, 0)


def trie_links(query: np.ndarray, members: list[np.ndarray], num: int, den: int, step: int = 64) -> list[bool]:
    """Whether each member links with query, by a walk over the members' prefix tree."""
    out = [False] * len(members)
    m = len(query)

    def need(size: int) -> int:
        return int(_ceil(num * (m + size), num + den))

    # (node, overlap so far, shingles above, shingles of the query that are behind)
    stack = [(prefix_tree(members), 0, 0, 0)]
    while stack:
        node, overlap, depth, used = stack.pop()
        least, alive, run = need(node.low), True, node.shingles
        for at in range(0, len(run), step):
            # The set that asks least is the smallest, and what remains is most for the greatest.
            if overlap + min(node.high - depth, m - used) < least:
                alive = False
                break
            piece = run[at : at + step]
            place = np.searchsorted(query, piece)
            overlap += int((query[np.minimum(place, m - 1)] == piece).sum()) if m else 0
            depth += len(piece)
            used = int(np.searchsorted(query, piece[-1], "right"))
        if alive and overlap + min(node.high - depth, m - used) >= least:
            for i in node.ends:
                out[i] = overlap >= need(len(members[i]))
            stack += [(child, overlap, depth, used) for child in node.below]
    return out


def _places(ids: pa.Array) -> np.ndarray:
    """Each id's bit in the filter of wanted ids; -1 for null."""
    if pa.types.is_integer(ids.type):
        h = mix(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
    else:
        h = np.array([zlib.crc32(str(x).encode()) for x in ids.to_pylist()], np.uint64)
    place = (h & _U((1 << FILTER_BITS) - 1)).astype(np.int64)
    place[ids.is_null().to_numpy(zero_copy_only=False)] = -1
    return place


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits in which every id's bit is set: of one size for any input. More ids mean more
    documents that pass in vain, never a wanted one that doesn't."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            place = _places(batch.column(0))
            flags[place[place >= 0]] = True
        packed = np.packbits(flags).reshape(-1, CHUNK)
        for c in np.flatnonzero(packed.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([packed[c].tobytes()], pa.binary())], names=["chunk", "flags"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[c] = held.get(c, 0) | np.frombuffer(x, np.uint8)
        for c, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "flags"])

    kind = "chunk int, flags binary"
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in ids.mapInArrow(mark, kind).repartition("chunk").mapInArrow(merge, kind).collect():  # 2**FILTER_BITS bits at most
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["flags"], np.uint8)
    return np.unpackbits(out).astype(bool)


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, as (src, dst). Each a's partners lie in tries of at most TRIE members.

    Texts travel, not sets: they are shorter, and the tasks that compare cut them into shingles again.
    """
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(id_filter(ids)))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            place = _places(batch.column(0))
            yield batch.filter(pa.array((place >= 0) & flags[place]))

    kind = docs.schema[key].dataType.simpleString()
    # Each task keeps the texts that the bitmap lets pass. A text too many joins with nothing.
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(wanted, f"id {kind}, text string")
    nth = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    dealt = pairs.select("a", F.floor((nth - 1) / TRIE).cast("int").alias("block"), "b")
    members = dealt.select("a", "block", F.lit(1).alias("side"), F.col("b").alias("id"))
    roles = members.unionByName(dealt.select("a", "block").distinct().select("a", "block", F.lit(0).alias("side"), F.col("a").alias("id")))
    rows = roles.join(texts, "id").select("a", "block", "side", "id", "text").repartition("a", "block").sortWithinPartitions("a", "block", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, held, ids_, src, dst = None, None, [], [], [], []

        def flush() -> None:
            if query is not None and held:
                for b, ok in zip(ids_, trie_links(query, held, num, den)):
                    if ok:
                        src.append(now[0])
                        dst.append(b)

        for batch in batches:
            for part in slices(batch, "text"):
                for a, block, side, b, x in zip(*(part.column(i).to_pylist() for i in range(4)), sets_of(part, "text", n)):
                    if (a, block) != now:
                        flush()
                        now, query, held, ids_ = (a, block), None, [], []
                    if side == 0:
                        query = x
                    else:
                        held.append(x)
                        ids_.append(b)
            if len(src) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, id_type), pa.array(dst, id_type)], names=["src", "dst"])
                src, dst = [], []
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(src, id_type), pa.array(dst, id_type)], names=["src", "dst"])

    id_type = pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()
    return rows.mapInArrow(compare, f"src {kind}, dst {kind}")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id), the least doc_id reachable by links.

    Links: den * |intersection| >= num * |union| of the sets of distinct n-word shingles.
    """
    c = F.col
    bits = min(24, max(16, int(max(1, docs.count()) * 4 - 1).bit_length()))
    ranks = order_table(docs, text, n, bits)
    sigs = settled(signatures(docs, key, text, n, num, den, ranks), "signatures")
    distinct = sigs.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2")
    spread = distinct.agg(F.min_by("prefix", "doc_id").alias("prefix"), F.min("doc_id").alias("rep")).select("rep", c("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "tok"))
    # The one shuffle of prefix rows: by shingle, with the group's size and its least set.
    group = Window.partitionBy("tok")
    inside = spread.withColumns({"c": F.count("*").over(group), "least": F.min(F.struct("rep", "n", "pos")).over(group)}).where("c > 1")
    inside = settled(inside.select("tok", "rep", "n", "pos", "least"), "prefixes")

    def may(nx, ny, px, py):  # noqa: ANN001, ANN202
        """Sizes fit, and what follows the shared shingle can reach the overlap."""
        left = F.least(nx - px, ny - py)
        return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & (left * (num + den) >= num * (nx + ny))

    first = inside.where((c("rep") != c("least.rep")) & may(c("n"), c("least.n"), c("pos"), c("least.pos")))
    first = settled(first.select(c("least.rep").alias("a"), c("rep").alias("b")).distinct(), "stars")
    links = settled(verified(first, docs, key, text, n, num, den), "links")
    label = connected_components(links)
    marked = inside.select("tok", "rep", "n", "pos", c("least.rep").alias("center")).join(label, c("rep") == c("node"), "left")
    marked = marked.select("tok", "rep", "n", "pos", "center", F.coalesce("component", "rep").alias("comp"))
    # Groups of several components. Sets of the commonest one are held against the others, never against each other.
    mixed = marked.withColumns({"lo": F.min("comp").over(group), "hi": F.max("comp").over(group), "large": F.mode("comp", True).over(group)}).where("lo < hi")
    x = mixed.where("comp != large and rep != center").select("tok", *(c(k).alias(f"x_{k}") for k in ("rep", "n", "pos", "comp")))
    y = mixed.where("rep != center").select("tok", "large", *(c(k).alias(f"y_{k}") for k in ("rep", "n", "pos", "comp")))
    across = x.join(y, "tok").where(
        (c("x_comp") != c("y_comp")) & ((c("y_comp") == c("large")) | (c("x_rep") < c("y_rep"))) & may(c("x_n"), c("y_n"), c("x_pos"), c("y_pos"))
    )
    across = settled(across.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct(), "across")
    if across.limit(1).count():
        more = settled(verified(across, docs, key, text, n, num, den), "links")
        if more.limit(1).count():
            label = connected_components(label.select(c("node").alias("src"), c("component").alias("dst")).unionByName(more))
        release(more)
    release(inside, first, links, across)
    reps = distinct.agg(F.min("doc_id").alias("rep")).join(label, c("rep") == c("node"), "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("found"))
    out = sigs.select("doc_id", "n", "h1", "h2").join(reps, ["n", "h1", "h2"], "left")
    return out.select("doc_id", c("n").alias("n_shingles"), F.coalesce("found", "doc_id").alias("component_id"))
