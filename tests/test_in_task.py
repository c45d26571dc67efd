"""Scans that a task takes whole give the rows of the loops of joins; views found from keys are those of the SQL."""

from __future__ import annotations

import random

import pytest

from loomgraph.operators import graph as G
from loomgraph.operators import in_task as I
from loomgraph.plans import bindings
from loomgraph.shared import materialise

KIND = "scan_id string, src string, dst string"


def many_scans(n: int = 40) -> list[tuple[str, str, str]]:
    rnd = random.Random(11)
    out = {(f"r{s}", f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}") for s in range(n) for _ in range(rnd.randrange(1, 26))}
    return sorted(out | {("wide", f"m{i:02d}", f"m{(i * 7 + 3) % 40:02d}") for i in range(40)} | {("wide", f"m{i:02d}", f"m{(i + 1) % 40:02d}") for i in range(40)})


def rows(df):
    return sorted((r.scan_id, r.component, tuple(r.cycle)) for r in df.collect())


@pytest.mark.parametrize("every_edge", [False, True])
def test_scans_in_tasks_have_the_cycles_of_the_loops(spark, monkeypatch, every_edge):
    df = materialise(spark.createDataFrame([*many_scans(), (None, "a", "a"), ("r1", None, "a"), ("r1", "a", None)], KIND), "e")
    components = materialise(G.scc(G.participating(df), df), "c")
    want = rows((G.edge_cycles if every_edge else G.find_cycles)(df, components))
    monkeypatch.setattr(G, "TASK_EDGES", 50)  # one of the scans goes through the loops
    mixed = rows(G.cycles(df, every_edge))
    monkeypatch.setattr(G, "TASK_EDGES", 10**6)
    monkeypatch.setattr(G, "scc", None)  # no rounds at all
    assert rows(G.cycles(df, every_edge)) == mixed == want
    assert any(len(c) > 3 for _, _, c in want) and any(len(c) == 1 for _, _, c in want)


def test_components_and_ways_in_tasks(spark, monkeypatch):
    edges = many_scans(12)
    df = materialise(spark.createDataFrame(edges, KIND), "e")
    nodes = spark.createDataFrame(sorted({(s, x) for s, a, b in edges for x in (a, b)} | {("r3", "alone")}), "scan_id string, node string")
    seeds = spark.createDataFrame([(f"r{s}", f"n{s % 12}") for s in range(0, 12, 2)] + [("wide", "m05"), ("gone", "x"), ("r0", None)], "scan_id string, node string")
    monkeypatch.setattr(G, "PIVOTS", 2)
    monkeypatch.setattr(G, "WIDE", 30)
    monkeypatch.setattr(G, "SMALL_CORE", 5)
    found = {}
    for most in (10**6, 50, 0):
        monkeypatch.setattr(G, "TASK_EDGES", most)
        found[most] = sorted(map(tuple, G.scc(nodes, df).collect())), sorted(map(tuple, G.reachable(seeds, df).collect()))
    assert found[10**6] == found[50] == found[0]
    assert ("gone", "x") in found[0][1] and len(found[0][1]) > 20


def test_numbers_rise_with_fewer_edges(spark):
    edges = sorted({("s", f"n{a}", f"n{b}") for a in range(9) for b in range(9) if a != b and (a < 3 or b < 2)} | {("t", "n1", "n2"), ("t", "n2", "n1")})
    numbers, e = G._numbered(materialise(spark.createDataFrame(edges, KIND), "e"))
    by = {r.n: (r.scan_id, r.node) for r in numbers.collect()}
    least = {x: min(sum((s, a) == x for s, a, _ in edges), sum((s, b) == x for s, _, b in edges)) for x in by.values()}
    assert len(least) == len(by) == 11 and [-least[by[n]] for n in sorted(by)] == sorted(-v for v in least.values())
    assert sorted((by[r.src][0], by[r.src][1], by[r.dst][1]) for r in e.collect()) == edges


def test_long_ways_need_no_recursion():
    n = 3000
    ring = [(f"n{i:04d}", f"n{(i + 1) % n:04d}") for i in range(n)]
    assert [(c, len(w)) for c, w in I.least_cycles(ring)] == [("n0000", n)] == [(c, len(w)) for c, w in I.cycles_of_edges(ring)]


@pytest.mark.parametrize("name", sorted(bindings.KEYED))
def test_keyed_views_are_the_views(spark, name):
    sf = "/root/testdata/sf0.001"
    keyed = bindings.view(spark, sf, name)
    plain = bindings.run_sql(spark, sf, bindings.VIEWS[name])
    assert keyed.columns == plain.columns and keyed.dtypes == plain.dtypes and plain.count() > 100
    assert keyed.exceptAll(plain).isEmpty() and plain.exceptAll(keyed).isEmpty()
