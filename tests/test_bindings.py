"""The derived code graph holds every hop of its tables; queries over it against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import graph_queries as Q
from loomgraph.plans.bindings import view

PART = "p_partkey long, p_brand string, p_type string, p_size int"
LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
ORDER = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string"
#: Orders as (priority, status) and lines of (part, supplier, quantity); each line calls the next.
ORDERS = [
    ("1-URGENT", "P", [(1, 1, 5.0), (2, 2, 50.0)]),
    ("5-LOW", "F", [(2, 2, 40.0), (3, 3, 30.0)]),
    ("3-MEDIUM", "O", [(3, 3, 11.0), (1, 1, 1.0)]),
    ("2-HIGH", "O", [(3, 3, 26.0), (4, 4, 2.0)]),
]


@pytest.fixture
def tables(spark, tmp_path):
    lines = [(o, n, p, s, q, 0.0, 0.0, "N", "F") for o, (_, _, ls) in enumerate(ORDERS) for n, (p, s, q) in enumerate(ls)]
    made = {
        "part": ([(k, "Brand#1", "T", 50) for k in (1, 2, 3, 4, 5, 40)], PART), "lineitem": (lines, LINE),
        "orders": ([(o, 1, p, s) for o, (p, s, _) in enumerate(ORDERS)], ORDER),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def file_no(c):
    return F.regexp_extract(c, r"(\d+)\.ts", 1).cast("int")


def test_import_edges_are_all_hops(spark, tables):
    got = {tuple(r) for r in view(spark, tables, "b_import_edges").select(file_no("src"), file_no("dst")).collect()}
    assert got == {(1, 2), (2, 3), (3, 1), (3, 4)}


def test_components_and_reach_of_all_hops(spark, tables):
    edges = {(ls[0][0], ls[1][0]) for _, _, ls in ORDERS}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    want = {n: min([n, *(b for b in range(1, 6) if {(n, b), (b, n)} <= reach)]) for e in edges for n in e}
    got = Q.QUERIES["scc"](spark, tables).select(file_no("node"), file_no("component")).collect()
    assert dict(map(tuple, got)) == want == {1: 1, 2: 1, 3: 1, 4: 4}
    (cycle,) = Q.QUERIES["find_cycles"](spark, tables).collect()
    assert cycle.cycle.count(" > ") == 2


def fn(file, name):
    return f"file:Brand#1/T/{file}.ts:fn:s{name}:1"


def test_calls_are_all_hops(spark, tables):
    got = {tuple(r) for r in view(spark, tables, "b_calls").select("source_id", "target_id").collect()}
    assert got == {(fn(1, 1), fn(2, 2)), (fn(2, 2), fn(3, 3)), (fn(3, 3), fn(1, 1)), (fn(3, 3), fn(4, 4))}
    assert Q.QUERIES["orphaned_functions"](spark, tables).count() == 0


def test_function_cycles_are_of_calls(spark, tables):
    (f,) = Q.QUERIES["function_cycles"](spark, tables).collect()
    assert f.nodes == ",".join(fn(n, n) for n in (1, 2, 3)) and f.title == "Circular call: s1 → s2 → s3 → s1"


def test_detect_warnings_runs_all_detectors(spark, tables):
    rows = Q.QUERIES["detect_warnings"](spark, tables).collect()
    large = [f"Large file: {k}.ts" for k in (1, 2, 3, 4, 40, 5)]
    unused = [f"Unused export: s{k}" for k in (2, 3, 4)]  # file 1 imports its own s1
    assert sorted(r.title for r in rows) == ["Circular call: s1 → s2 → s3 → s1", "Circular dependency: 1.ts → 2.ts → 3.ts → 1.ts", *large, *unused]


def test_external_detection(spark, tables):
    got = Counter((r.category, r.source) for r in Q.QUERIES["external_detection"](spark, tables).collect())
    assert got == {
        ("orphaned_code", "graph"): 5, ("circular_dependency", "graph"): 1, ("orphaned_code", "report"): 1, ("unused_export", "report"): 5,
        ("circular_dependency", "report"): 4, ("error", "unused"): 1,
    }
