"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; a pair of codes is a cell of the product
grid. A vector visits cells in the order of a multi-sequence traversal: for each half the
codes stand by how far their region lies from the vector at least, and a heap walks the
pairs from the nearest on. It stops where a link would have to cross borders farther than it is
long, so every link is met, however the vectors are spread. What it meets in the cells is verified
by cosine in double precision. The number of codes sets the cost alone: the one is taken whose
visits and comparisons, tried on the sample, cost least.

Only vectors of the same label, not null, and of the same length are compared; each length has
codebooks of its own. Vectors that are null, zero, or hold null or non-finite components link with
nothing. Equal vectors of a label collapse to one and count as often as they occur; ties and
repeated rows are equal vectors like any other. Other columns are never read.

Neighbouring cells of a label lie together in regions of about CHUNK vectors, a crowded cell in
several parts. A vector travels once to its own region and once to each other one that it has
cells to visit in, with the list of these cells. A task hands on counts and a spanning forest of its links, never
all pairs.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkforge.operators.components import connected_components
from linkforge.llm.sampling import least_hashes
from linkforge.session import settled

#: Vectors that the codebooks of a length are fitted to at most, home vectors in a region, regions at most, and lengths that get
#: codebooks (the commonest; the vectors of each other length share one cell).
SAMPLE, CHUNK, REGIONS, LENGTHS = 8192, 4096, 1 << 20, 16
#: Vectors of the sample that try a number of codes, and the comparisons that one visit costs as much as.
PROBES, VISIT = 64, 150


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k centroids of rows x by Lloyd's rounds from distinct rows."""
    r = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (c * c).sum(1)[None, :] - 2 * x @ c.T
        code = near.argmin(1)
        for j in range(k):
            mine = x[code == j]
            if len(mine):
                c[j] = mine.mean(0)
    return c


@dataclass
class MultiIndex:
    """Codebooks of both halves; reach: the border distance that a visit may cross."""

    first: np.ndarray
    second: np.ndarray
    reach: float

    @classmethod
    def fit(cls, x: np.ndarray, k: int, least: float, recall: float) -> MultiIndex:
        """least: the cosine of a link. A link's difference is at most sqrt(2 - 2 least) long, and so are its parts along
        the normals of borders in both halves together: that reach misses none. A recall under 1 takes the difference
        to be spread evenly over all dimensions, which holds for isotropic vectors only; the two parts' length is then a
        Rayleigh variable with a deviation of the difference over sqrt(dim)."""
        half = x.shape[1] // 2
        reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6  # rounding
        if recall < 1:
            reach = min(reach, reach / np.sqrt(max(1, x.shape[1])) * np.sqrt(-2 * np.log(1 - recall)))
        return cls(codebook(x[:, :half], k), codebook(x[:, half:], k), float(reach))

    @classmethod
    def cheapest(cls, x: np.ndarray, most: int, least: float, recall: float, rows: float) -> MultiIndex:
        """The index of 4, 8, .. most codes at which a vector's visits and comparisons with rows others cost least."""
        tried = [cls.fit(x, k, least, recall) for k in (2**i for i in range(2, most.bit_length()))]
        return min(tried, key=lambda index: index.cost(x, rows))

    def cost(self, x: np.ndarray, rows: float) -> float:
        """Comparisons, and visits as comparisons, of one of the first PROBES rows of x among rows spread as x is."""
        half = x.shape[1] // 2
        a, da = self.borders(x[:, :half], self.first)
        b, db = self.borders(x[:, half:], self.second)
        share = np.zeros((len(self.first), len(self.second)))
        np.add.at(share, (a, b), 1 / len(x))
        costs = []
        for p, q in zip(da[:PROBES] ** 2, db[:PROBES] ** 2):
            near = p[:, None] + q[None, :] <= self.reach**2
            costs.append(VISIT * near.sum() + rows * share[near].sum())
        return float(np.mean(costs))

    def borders(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, least distance of x to the region of each code, 0 for its own).

        A region lies beyond the border between its code and any other, so it's as far as the farthest of these.
        """
        d = np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T)
        code = d.argmin(1)
        gap = 2 * np.sqrt(np.maximum(1e-30, ((c[:, None, :] - c[None, :, :]) ** 2).sum(2)))
        out = np.maximum(0, (d - d[np.arange(len(x)), code][:, None]) / gap[code])
        for j in range(len(c)):
            near = np.flatnonzero((out[:, j] <= self.reach) & (code != j))
            if len(near):
                beyond = (d[near, j][:, None] - d[near]) / gap[j]
                beyond[:, j] = 0
                out[near, j] = np.maximum(out[near, j], beyond.max(1))
        return code, out

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        half = x.shape[1] // 2
        near = [((c * c).sum(1)[None, :] - 2 * part @ c.T).argmin(1) for part, c in ((x[:, :half], self.first), (x[:, half:], self.second))]
        return near[0] * len(self.second) + near[1]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell, vector number, visited cell) for unit vectors x; a home cell is its own first visit."""
        half = x.shape[1] // 2
        _, da = self.borders(x[:, :half], self.first)
        _, db = self.borders(x[:, half:], self.second)
        k = len(self.second)
        home = self.homes(x)
        who, cells = [], []
        bound = self.reach**2
        oa, ob = da.argsort(1, kind="stable"), db.argsort(1, kind="stable")
        sa, sb = np.take_along_axis(da, oa, 1) ** 2, np.take_along_axis(db, ob, 1) ** 2
        na, nb = (sa <= bound).sum(1), (sb <= bound).sum(1)
        for i in range(len(x)):
            row, col, ra, rb = oa[i], ob[i], sa[i], sb[i]
            if na[i] == 1 and nb[i] == 1:
                who.append(i)
                cells.append(int(home[i]))
                continue
            queue, pushed = [(ra[0] + rb[0], 0, 0)], {(0, 0)}
            while queue:
                s, p, q = heapq.heappop(queue)
                if s > bound:
                    break
                who.append(i)
                cells.append(int(row[p]) * k + int(col[q]))
                for nxt in ((p + 1, q), (p, q + 1)):
                    if nxt[0] < na[i] and nxt[1] < nb[i] and nxt not in pushed:
                        pushed.add(nxt)
                        heapq.heappush(queue, (ra[nxt[0]] + rb[nxt[1]], *nxt))
        return home, np.array(who, np.int64), np.array(cells, np.int64)


def _hashed(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, dim, h1, h2, v) of every row; h1 and h2: two hashes of the vector. All but id are null in rows that link with nothing."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    stored = v if df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>") else v.cast("array<double>")
    ok = F.col(label).isNotNull() & F.col(key).isNotNull() & fine & some
    cols = {"label": F.col(label), "dim": F.size(v), "h1": F.xxhash64(stored), "h2": F.xxhash64(F.lit(1), stored), "v": stored}
    return df.select(F.col(key).alias("id"), *(F.when(ok, c).alias(name) for name, c in cols.items()))


@dataclass
class Regions:
    """Where the cells of large labels lie. starts: by (label, length), the first cell of each region in order, and the regions'
    numbers; parts: by (label, length, cell) of crowded cells, in how many parts they lie. All other labels are one region each."""

    starts: dict
    parts: dict

    @classmethod
    def of(cls, cells: DataFrame, rows: int) -> Regions:
        """cells: (label, dim, cell, n). At most REGIONS starts and as many crowded cells, whatever the input's size."""
        chunk = max(CHUNK, 2 * rows // REGIONS)
        own = Window.partitionBy("label", "dim")
        before = F.coalesce(F.sum("n").over(own.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = cells.withColumns({"whole": F.sum("n").over(own), "region": F.floor(before / chunk).cast("int")}).where(F.col("whole") > chunk)
        placed = placed.select("label", "dim", "cell", "region", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
        starts: dict = {}
        for r in placed.groupBy("label", "dim", "region").agg(F.min("cell").alias("cell")).orderBy("region").collect():
            cell, region = starts.setdefault((r["label"], r["dim"]), ([], []))
            cell.append(r["cell"])
            region.append(r["region"])
        parts = {(r["label"], r["dim"], r["cell"]): r["parts"] for r in placed.where("parts > 1").collect()}
        return cls({k: (np.array(a), np.array(b)) for k, (a, b) in starts.items()}, parts)

    def stops(self, label: object, dim: int, cells: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """The cells by (region, part) that they lie in; a crowded cell lies in each of its parts."""
        known = self.starts.get((label, dim))
        if known is None:
            return {(0, 0): cells.tolist()}
        out: dict[tuple[int, int], list[int]] = {}
        for cell, region in zip(cells.tolist(), known[1][np.searchsorted(known[0], cells, "right") - 1].tolist()):
            for part in range(self.parts.get((label, dim, cell), 1)):
                out.setdefault((region, part), []).append(cell)
        return out


class Region:
    """The home vectors of a region, in order of their cells, and the links found with them."""

    def __init__(self, rep: np.ndarray, m: np.ndarray, cell: np.ndarray, u: np.ndarray, least: float):
        by = np.argsort(cell, kind="stable")
        self.rep, self.m, self.u, self.least = rep[by], m[by], u[by], least
        self.cells, self.first = np.unique(cell[by], return_index=True)
        self.last = np.append(self.first[1:], len(by))
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.arange(len(by))
        self.count = np.zeros(len(by))
        self.label = np.arange(len(by))  # of the component that a home vector is in so far
        self.edges: list[tuple] = []

    def probe(self, rep: np.ndarray, m: np.ndarray, home: np.ndarray, u: np.ndarray, lists: list[list[int]], own: np.ndarray | None = None) -> np.ndarray:
        """Links counted for each visitor, which sees the vectors of the cells in its list. own: visitors' places here, where they are home vectors.

        Vectors of one cell see each other; such a pair counts where the visitor's id is the larger.
        """
        found = np.zeros(len(rep))
        who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        cells = np.array([c for x in lists for c in x], np.int64)
        by = np.argsort(cells, kind="stable")
        cells, who = cells[by], who[by]
        edge = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
        at = np.searchsorted(self.cells, cells[edge[:-1]])
        joined = np.full(len(rep), -1) if own is None else None
        for lo, hi, k in zip(edge[:-1], edge[1:], at):
            if k == len(self.cells) or self.cells[k] != cells[lo]:
                continue
            p, a, b = who[lo:hi], self.first[k], self.last[k]
            hit = u[p] @ self.u[a:b].T >= self.least
            if not hit.any():
                continue
            same = np.flatnonzero(home[p] == cells[lo])
            hit[same] &= rep[p[same]][:, None] > self.rep[a:b][None, :]
            found[p] += hit @ self.m[a:b]
            self.count[a:b] += m[p] @ hit
            for i in np.flatnonzero(hit.any(1)):
                near = np.flatnonzero(hit[i]) + a
                roots, one = np.unique(self.label[near], return_index=True)
                mine = self.label[own[p[i]]] if own is not None else joined[p[i]]
                for root, j in zip(roots.tolist(), near[one].tolist()):
                    if root == mine:
                        continue
                    self.edges.append((rep[p[i]], self.rep[j]))
                    if mine >= 0:
                        self.label[self.label == root] = mine
                        if joined is not None:
                            joined[joined == root] = mine
                    else:
                        mine = root
                if joined is not None:
                    joined[p[i]] = mine
        return found


def near_duplicates(df: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", recall: float = 1.0, cells: int | None = None) -> DataFrame:
    """One row per row of df: (key, n_links, component_id, kept).

    Rows are nodes of their own: where one id comes with several vectors or labels, each of its rows has its own links, and component_id is the
    least id that the row reaches.
    """
    spark = df.sparkSession
    id_kind, label_kind = "bigint", df.schema[label].dataType.simpleString()
    hashed = _hashed(df, key, vector, label)
    usable = hashed.where("h1 is not null")
    stored = np.float32 if usable.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    whole = usable.groupBy("label", "dim", "h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v"))
    whole = settled(whole.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # a number for each vector, fixed by writing
    rows = whole.count()
    lengths = whole.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    indexes: dict[int, MultiIndex] = {}
    for dim, n in ((r["dim"], r["count"]) for r in lengths):
        these = whole.where(F.col("dim") == dim)
        picked = least_hashes(these.select("label", "v", F.xxhash64("h1", "h2").alias("h")), these, SAMPLE).collect()  # a bounded sample
        x = np.array([r["v"] for r in picked], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        most = int(min(512, max(4, 2 ** round(np.log2(max(1.0, n / 200)) / 2))))
        of_label = sum((c / len(picked)) ** 2 for c in Counter(r["label"] for r in picked).values())
        indexes[dim] = MultiIndex.fit(x, cells, least, recall) if cells else MultiIndex.cheapest(x, most, least, recall, n * of_label)
    shared = spark.sparkContext.broadcast(indexes)

    def unit(v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def by_length(batch: pa.RecordBatch, size: int = 2000) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, MultiIndex | None]]:
        """Runs of rows of one length: (rows, length, vectors, index)."""
        dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == dim))
            for at in range(0, mine.num_rows, size):
                part = mine.slice(at, size)
                v = part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(stored)
                yield part, dim, v, shared.value.get(dim)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, v, index in by_length(batch):
                cell = index.homes(unit(v)) if index else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32())], names=["label", "dim", "cell"])

    found_cells = whole.select("label", "dim", "v").mapInArrow(at_home, f"label {label_kind}, dim int, cell int")
    regions = spark.sparkContext.broadcast(Regions.of(settled(found_cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")), "cells"), rows))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for a vector's own place (side 0), with the cells that it visits there, and for each other region to visit (side 1)."""
        for batch in batches:
            for part, dim, v, index in by_length(batch):
                if index:
                    home, who, cell = index.visits(unit(v))
                    # A pair meets once: the vector whose home cell has the lower number visits the other's.
                    keep = cell >= home[who]
                    who, cell = who[keep], cell[keep]
                else:
                    home = cell = np.zeros(len(v), np.int64)
                    who = np.arange(len(v))
                first = np.searchsorted(who, np.arange(len(v) + 1))
                take, region, piece, side, lists = [], [], [], [], []
                for i, (name, rep) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    stops = regions.value.stops(name, dim, cell[first[i] : first[i + 1]])
                    own = next(k for k, x in stops.items() if home[i] in x)[0]
                    pieces = regions.value.parts.get((name, dim, int(home[i])), 1)
                    here = (own, zlib.crc32(str(rep).encode()) % pieces)
                    for (r, p), visited in stops.items():
                        take.append(i)
                        region.append(r)
                        piece.append(p)
                        side.append(int((r, p) != here))
                        lists.append(visited)
                data = [r.tobytes() for r in v]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take)), pa.array([dim] * len(take), pa.int32()), pa.array(region, pa.int32()), pa.array(piece, pa.int32()), pa.array(side, pa.int32()), part.column(2).take(pa.array(take)), part.column(3).take(pa.array(take)), pa.array(home[take], pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array([data[i] for i in take], pa.binary())],
                    names=["label", "dim", "region", "part", "side", "rep", "m", "home", "visited", "u"],
                )

    place = ["label", "dim", "region", "part"]
    schema = f"label {label_kind}, dim int, region int, part int, side int, rep {id_kind}, m long, home int, visited array<int>, u binary"
    tasks = whole.select("label", "dim", "rep", "m", "v").mapInArrow(visit, schema).repartition(*place).sortWithinPartitions(*place, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, region = None, [], None
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def joined(runs: list[tuple]) -> tuple:
            return (*(np.concatenate([r[k] for r in runs]) for k in range(4)), [x for r in runs for x in r[4]])

        def settle() -> Region:
            rep, m, home, u, lists = joined(held)
            region = Region(rep, m, home, u, least)
            for at in range(0, len(rep), 1024):
                s = slice(at, at + 1024)
                out.append((rep[s], region.probe(rep[s], m[s], home[s], u[s], lists[s], region.place[s])))
            return region

        def results() -> Iterator[pa.RecordBatch]:
            if region is not None:
                out.append((region.rep, region.count))
                rep = np.concatenate([r for r, _ in out])
                n = np.concatenate([c for _, c in out]).astype(np.int64)
                some = n > 0
                rep, n, e = rep[some].tolist(), n[some].tolist(), region.edges
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep + [None] * len(e), id_arrow), pa.array(n + [None] * len(e), pa.int64()), *(pa.array([None] * len(rep) + [x[k] for x in e], id_arrow) for k in (0, 1))],
                    names=["rep", "n", "src", "dst"],
                )
                out.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for lo, hi in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[lo][:4] != now:
                    if held:
                        region = settle()
                        held = []
                    yield from results()
                    now, region = keys[lo][:4], None
                for at in range(lo, hi, 1024):
                    part = batch.slice(at, min(1024, hi - at))
                    rep = np.array(part.column(5).to_pylist(), np.int64)
                    u = unit(np.frombuffer(b"".join(part.column(9).to_pylist()), stored).reshape(part.num_rows, -1))
                    run = (rep, part.column(6).to_numpy(zero_copy_only=False).astype(float), part.column(7).to_numpy(zero_copy_only=False).astype(np.int64), u, part.column(8).to_pylist())
                    if keys[lo][4] == 0:
                        held.append(run)
                        continue
                    if held:
                        region = settle()
                        held = []
                    if region is not None:  # else nobody is at home
                        out.append((rep, region.probe(*run)))
        if held:
            region = settle()
        yield from results()

    id_arrow = pa.int64()
    found = settled(tasks.mapInArrow(compare, f"rep {id_kind}, n long, src {id_kind}, dst {id_kind}"), "links")
    counts = found.where("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    label_of = connected_components(found.where("src is not null"))
    same = ["label", "dim", "h1", "h2"]
    reps = whole.select(*same, "rep", "m", "least").join(counts, "rep", "left").join(label_of, F.col("rep") == F.col("node"), "left")
    reps = reps.select(*same, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("comp"), "least")
    least_of = reps.groupBy("comp").agg(F.min("least").alias("component_id"))
    out = hashed.select("id", *same).join(reps.drop("least").join(least_of, "comp"), same, "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
