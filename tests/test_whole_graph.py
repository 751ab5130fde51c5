"""Graph queries and record differences over all rows, against brute force on small tables with cycles, hubs and ties."""

import random

import numpy as np
import pytest

from linkforge.operators import graph
from linkforge.plans import registry


@pytest.fixture(scope="module")
def cyclic(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('cyclic')}"
    orders = [(k, k % 6 + 1, "F" if k % 2 else "O", f"2024-01-{k + 1:02}") for k in range(1, 21)]
    tables = {
        "region": ([(i, f"r{i}") for i in range(3)], "r_regionkey int, r_name string"),
        "nation": ([(0, "a", 0), (1, "b", 1), (2, "c", 1), (3, "d", 2)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(i, f"s{i}", i % 3) for i in range(1, 5)], "s_suppkey int, s_name string, s_nationkey int"),
        "customer": ([(i, f"c{i}", i % 4) for i in range(1, 8)], "c_custkey int, c_name string, c_nationkey int"),
        "part": ([(1, "p1"), (2, "p2")], "p_partkey int, p_name string"),
        "orders": (orders, "o_orderkey int, o_custkey int, o_orderstatus string, o_orderdate string"),
        "lineitem": ([(k, 1 if k % 3 else k % 4 + 1) for k in range(1, 21)], "l_orderkey int, l_suppkey int"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    t = {k: x[0] for k, x in tables.items()}
    near = {f"{p}:{r[0]}": set() for n, p in (("region", "R"), ("nation", "N"), ("supplier", "S"), ("customer", "C"), ("part", "P")) for r in t[n]}
    owner = {o[0]: o[1] for o in orders}
    edges = [(f"N:{n[0]}", f"R:{n[2]}") for n in t["nation"]] + [(f"{p}:{r[0]}", f"N:{r[2]}") for n, p in (("supplier", "S"), ("customer", "C")) for r in t[n]]
    for a, b in edges + [(f"C:{owner[k]}", f"S:{s}") for k, s in t["lineitem"]]:
        near[a].add(b)
        near[b].add(a)
    return at, near, orders


def walks(near, root):
    """Levels, and all shortest paths, from root."""
    found, front = {root: [[root]]}, [root]
    while front:
        step = {}
        for a in front:
            for b in near[a] - found.keys():
                step.setdefault(b, []).extend([*p, b] for p in found[a])
        found |= step
        front = list(step)
    return found


def test_levels_reach_every_entity(spark, cyclic):
    at, near, _ = cyclic
    found = walks(near, "R:1")
    got = {r["id"]: r["level"] for r in registry.queries()["bfs_levels"](spark, at).collect()}
    assert got == {i: len(found[i][0]) - 1 if i in found else 99 for i in near}
    assert {"C:1", "C:7", "P:1"} <= got.keys() and got["P:1"] == 99


def test_shortest_path_over_all_links(spark, cyclic):
    at, near, _ = cyclic
    got = [r["id"] for r in registry.queries()["shortest_path"](spark, at).orderBy("pos").collect()]
    assert got == min(walks(near, "S:1")["R:1"])


def test_brokers_share_ties(spark, cyclic):
    at, near, _ = cyclic
    want = dict.fromkeys(near, 0.0)
    for s in near:
        for t, paths in walks(near, s).items():
            for p in paths:
                for i in p[1:-1]:
                    want[i] += 0.5 / len(paths)
    got = {r["id"]: r["score"] for r in registry.queries()["brokers"](spark, at).collect()}
    assert got == pytest.approx(want) and want["C:1"] > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_sent_and_joined(spark, monkeypatch, seed):
    """Leaves, pairs apart, loops, hubs and ties; sources in several blocks and sums in several lots. Sent as numbers, no level is written to the shared folder."""
    r = random.Random(seed)
    near = {f"v{i}": set() for i in range(60)}
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(45)] + [(0, i) for i in range(30, 42)] + [(i, i + 1) for i in range(42, 50)] + [(52, 53), (54, 54), (3, 77)]
    for a, b in pairs:
        if a != b and b < 60:
            near[f"v{a}"].add(f"v{b}")
            near[f"v{b}"].add(f"v{a}")
    want = dict.fromkeys(near, 0.0)
    for s in near:
        for t, paths in walks(near, s).items():
            for p in paths:
                for i in p[1:-1]:
                    want[i] += 0.5 / len(paths)
    vertices, links = spark.createDataFrame([(i,) for i in near], "id string"), spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in pairs], "src string, dst string")
    monkeypatch.setattr(graph, "LOT", 64)
    monkeypatch.setattr(graph, "SOURCES", 5)
    written, kept = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df, name: written.append(name) or kept(df, name))
    assert {x["id"]: x["score"] for x in graph.betweenness(vertices, links).collect()} == pytest.approx(want)
    assert "between" not in written
    monkeypatch.setattr(graph, "LINKS_SENT", 10)
    assert {x["id"]: x["score"] for x in graph.betweenness(vertices, links).collect()} == pytest.approx(want)
    assert "between" in written and want["v0"] > 0


@pytest.mark.parametrize(("dense", "exact"), [(0, graph.EXACT), (graph.DENSE, graph.EXACT), (10**9, 3)])
def test_dues_by_products_and_by_sums(monkeypatch, dense, exact):
    """Two dense halves that meet in hubs only, with sums, products or both, in several pieces, and paths too many for 32-bit floats."""
    r = random.Random(3)
    near = {i: set() for i in range(70)}
    pairs = [(i, j) for half in (0, 32) for i in range(half, half + 8) for j in range(half + 8, half + 32) if r.random() < 0.4] + [(64 + i % 2, i) for i in range(64)] + [(66, 67), (3, 68)]
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        for t, paths in walks(near, s).items():
            for p in paths:
                for i in p[1:-1]:
                    want[i] += 1 / len(paths)
    for name, value in (("DENSE", dense), ("EXACT", exact), ("LOT", 64), ("LINKS", 40), ("ROWS", 16)):
        monkeypatch.setattr(graph, name, value)
    links = sorted({(min(p), max(p)) for p in pairs})
    a, b = np.array(links, np.int32).T
    order, part = graph.arranged(a, b, 70)
    assert sorted(order) == list(range(70)) and len(set(part.tolist())) > 2
    number = np.argsort(order).astype(np.int32)
    net = graph.Net(number[a], number[b], 70)
    lots = net.sources(part, 16)
    assert sorted(np.concatenate(lots)) == np.flatnonzero(net.degree > 1).tolist() and max(map(len, lots)) <= 16
    total = sum(net.dues(lot, net.leaves()) for lot in lots)
    assert dict(zip(order.tolist(), total.tolist())) == pytest.approx(want)


def test_brokers_take_sources_of_one_part_together_and_dense_links_as_products(monkeypatch):
    """Copies that meet in hubs, in mixed order: no lot has sources of two, and sums of neighbours one by one are only left where links are sparse."""
    r = np.random.default_rng(5)
    sides = [(i, j) for begin in range(0, 480, 120) for i in range(begin, begin + 20) for j in range(begin + 20, begin + 120) if j % 20 == i % 20 or r.random() < 0.3]
    a, b = np.array(sides + [(480 + i % 4, i) for i in range(480)]).T
    mixed = r.permutation(484)
    a, b = mixed[a], mixed[b]
    order, part = graph.arranged(a, b, 484)
    assert [len(set(part[np.isin(order, mixed[c * 120 : c * 120 + 120])].tolist())) for c in range(4)] == [1] * 4 and len(set(part.tolist())) == 5
    number = np.argsort(order)
    net = graph.Net(number[a].astype(np.int32), number[b].astype(np.int32), 484)
    lots = net.sources(part, 40)
    assert all(len(set(part[lot].tolist())) == 1 for lot in lots) and 40 * len(lots) < 2 * 484
    gathered, room = [], net._room
    monkeypatch.setattr(net, "_room", lambda use, kind, rows, k: gathered.append((use, rows)) or room(use, kind, rows, k))
    for lot in lots:
        net.dues(lot, net.leaves())
    tiles, pieces = (sum(rows for use, rows in gathered if use == x) for x in ("tile", "sums"))
    assert 3 * tiles > pieces


def test_diff_holds_records_of_one_side(spark, cyclic):
    at, _, orders = cyclic
    want = set()
    for k, cust, status, _ in orders:
        kept = k % 5 < 2
        for field, a, b in (("o_orderstatus", status, ("X" if k % 3 == 0 else status) if kept else None), ("o_custkey", str(cust), str(cust) if kept and k % 7 else None)):
            if a != b:
                want.add((k, field, a, b))
    assert {tuple(r) for r in registry.queries()["record_diff"](spark, at).collect()} == want
    assert (3, "o_custkey", "4", None) in want
