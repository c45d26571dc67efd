"""Cycles that hold every circular edge, against the definition, and components of many small scans together."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import graph as G
from loomgraph.shared import materialise


def random_edges(seed: int) -> list[tuple[str, str, str]]:
    rnd = random.Random(seed)
    out = {(s, f"n{rnd.randrange(n)}", f"n{rnd.randrange(n)}") for s, n, m in (("a", 9, 14), ("c", 6, 5), ("d", 1, 1)) for _ in range(m)}
    out |= {("ring", f"n{i:02d}", f"n{(i + 1) % 5:02d}") for i in range(5)} | {("ring", "n03", "n01")}
    return sorted(out)


def reach(edges):
    found = set(edges)
    while more := {(s, a, d) for s, a, b in found for t, c, d in edges if s == t and b == c} - found:
        found |= more
    return found


@pytest.mark.parametrize("seed", [1])
def test_every_circular_edge_lies_in_a_cycle(spark, seed):
    edges = random_edges(seed)
    df = materialise(spark.createDataFrame(edges, "scan_id string, src string, dst string"), "e")
    components = materialise(G.scc(G.participating(df), df), "c")
    way = reach(edges)
    circular = {(s, a, b) for s, a, b in edges if (s, b, a) in way or a == b}
    assert {(r.scan_id, r.src, r.dst) for r in G.circular_edges(df, components).where("circular").collect()} == circular
    cycles = G.edge_cycles(df, components)
    rows = cycles.collect()
    for r in rows:
        assert len(set(r.cycle)) == len(r.cycle) and r.cycle[0] == min(r.cycle)
        assert all((r.scan_id, a, b) in circular for a, b in zip(r.cycle, [*r.cycle[1:], r.cycle[0]], strict=True))
    assert len({(r.scan_id, tuple(r.cycle)) for r in rows}) == len(rows) <= len(circular)
    assert {(r.scan_id, r.src, r.dst) for r in G.hops_of(cycles).collect()} == circular


def test_small_scans_are_closed_together(spark, monkeypatch):
    monkeypatch.setattr(G, "SMALL_CORE", 10)
    rnd = random.Random(8)
    edges = sorted({(f"s{k}", f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for k in range(4) for _ in range(18)})
    df = materialise(spark.createDataFrame(edges, "scan_id string, src string, dst string"), "e")
    way = reach(edges)
    nodes = {(s, x) for s, a, b in edges for x in (a, b)}
    want = {(s, n): min([n, *(m for t, m in nodes if t == s and {(s, n, m), (s, m, n)} <= way)]) for s, n in nodes}
    assert {(r.scan_id, r.node): r.component for r in G.scc(G.participating(df), df).collect()} == want


def test_no_edges(spark):
    df = spark.createDataFrame([], "scan_id string, src string, dst string")
    assert G.edge_cycles(df, G.scc(G.participating(df), df)).count() == 0


def test_hubs_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "HUB", 40)
    monkeypatch.setattr(G, "SMALL_CORE", 10)
    rnd = random.Random(4)
    out = [("s", "hub", f"n{i:03d}") for i in range(300)] + [("s", f"n{i:03d}", "sink") for i in range(200, 290)]
    out += [("s", f"n{i:03d}", "hub") for i in range(0, 120, 3)] + [("s", f"n{i:03d}", f"n{rnd.randrange(i, 300):03d}") for i in range(150, 300)]
    out += [("s", f"m{i}", f"m{(i + 1) % 15}") for i in range(15)] + [("t", "hub", "x"), ("t", "x", "hub")]
    edges = sorted(set(out))
    df = materialise(spark.createDataFrame(edges, "scan_id string, src string, dst string"), "e")
    dealt = G.Dealt(df)
    sizes = {(r.src, r.part): r["count"] for r in dealt.edges.groupBy("scan_id", "src", "part").count().collect()}
    assert len([1 for s, _ in sizes if s == "hub"]) >= 8 and max(sizes.values()) <= 2 * G.HUB
    ends = spark.createDataFrame([("s", "hub"), ("s", "n201"), ("t", "x")], "scan_id string, src string")
    assert sorted(map(tuple, dealt.join(ends).select("scan_id", "src", "dst").collect())) == [e for e in edges if e[:2] in {("s", "hub"), ("s", "n201"), ("t", "x")}]
    assert dealt.join(ends.where("src = 'hub'"), "left_semi").count() == 300
    full = reach(edges)
    nodes = {(s, x) for s, a, b in edges for x in (a, b)}
    want = {(s, x): min([x, *(b for t, a, b in full if (t, a) == (s, x) and (s, b, x) in full)]) for s, x in nodes}
    rows = G.scc(spark.createDataFrame(sorted(nodes), "scan_id string, node string"), df, hops=2, trims=2).collect()
    assert {(r.scan_id, r.node): r.component for r in rows} == want
    found = G.reachable(spark.createDataFrame([("s", "n150")], "scan_id string, node string"), df).collect()
    assert {r.node for r in found} == {"n150"} | {b for t, a, b in full if (t, a) == ("s", "n150")}
