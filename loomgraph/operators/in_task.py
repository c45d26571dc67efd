"""Graphs of scans that one task takes whole: components, cycles and reachability, scan after scan, in Python.

Every scan has a bounded number of edges (`graph.TASK_EDGES`); the loops of joins in `graph` are for the others, and both
give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KEY = "scan_id"
_CYCLES = pa.schema([(KEY, pa.string()), ("component", pa.string()), ("cycle", pa.list_(pa.string()))])
_NODES = pa.schema([(KEY, pa.string()), ("node", pa.string())])
_COMPONENTS = pa.schema([(KEY, pa.string()), ("node", pa.string()), ("component", pa.string())])
#: Values of a batch that leaves a task.
_BATCH = 50_000

Links = dict[str, list[str]]


def links(edges: list[tuple[str, str]]) -> Links:
    """The successors of each node, sorted, each once."""
    out: dict[str, set[str]] = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        if b not in out:
            out[b] = set()
    return {a: sorted(b) for a, b in out.items()}


def cyclic(out: Links) -> dict[str, str]:
    """The least node of its component for each node of a cycle (Tarjan, with a stack of its own)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    found: dict[str, str] = {}
    open_: list[str] = []
    done: set[str] = set()
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        open_.append(start)
        walk = [(start, iter(out[start]))]
        while walk:
            node, rest = walk[-1]
            for x in rest:
                if x not in index:
                    index[x] = low[x] = len(index)
                    open_.append(x)
                    walk.append((x, iter(out[x])))
                    break
                if x not in done and index[x] < low[node]:
                    low[node] = index[x]
            else:
                walk.pop()
                if walk and low[node] < low[walk[-1][0]]:
                    low[walk[-1][0]] = low[node]
                if low[node] == index[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(open_.pop())
                    done.update(members)
                    if len(members) > 1 or node in out[node]:
                        least = min(members)
                        found.update((m, least) for m in members)
    return found


def _tree(root: str, out: Links, of: dict[str, str]) -> dict[str, str | None]:
    """The node before each one on a shortest path from the root of a component (of several paths the least)."""
    before: dict[str, str | None] = {root: None}
    frontier = [root]  # in the order of their paths
    while frontier:
        new = []
        for node in frontier:
            for x in out[node]:
                if x not in before and of.get(x) == root:
                    before[x] = node
                    new.append(x)
        frontier = new
    return before


def least_cycles(edges: list[tuple[str, str]]) -> Iterator[tuple[str, list[str]]]:
    """(component, cycle): a shortest cycle through the least node of each cyclic component, and of these the least."""
    out = links(edges)
    of = cyclic(out)
    for root in {*of.values()}:
        before: dict[str, str | None] = {root: None}
        frontier, last = [root], None  # in the order of their paths
        while last is None:
            new = []
            for node in frontier:
                for x in out[node]:
                    if x == root:
                        last = node
                        break
                    if x not in before and of.get(x) == root:
                        before[x] = node
                        new.append(x)
                if last is not None:
                    break
            frontier = new
        way = []
        while last is not None:
            way.append(last)
            last = before[last]
        yield root, way[::-1]


def cycles_of_edges(edges: list[tuple[str, str]]) -> Iterator[tuple[str, list[str]]]:
    """(component, cycle): the cycles of `graph.edge_cycles`, each once."""
    out = links(edges)
    of = cyclic(out)
    inside: dict[str, list[tuple[str, str]]] = {}
    for a, to in out.items():
        if a in of:
            inside.setdefault(of[a], []).extend((a, b) for b in to if of.get(b) == of[a])
    for root, own in inside.items():
        before, after = _tree(root, out, of), _tree(root, links([(b, a) for a, b in own]), of)
        seen, last, up, place = set(), None, [], {}
        for a, b in own:
            if a != last:  # the way from a up to the root
                last, up, x = a, [], a
                while x is not None:
                    up.append(x)
                    x = before[x]
                place = {x: i for i, x in enumerate(up)}
            way, x = [], b
            while x not in place:
                way.append(x)
                x = after[x]
            way.append(x)
            way.extend(reversed(up[: place[x]]))
            at = way.index(min(way))
            way = way[at:] + way[:at]
            key = tuple(way) if len(way) <= 64 else hashlib.sha256(repr(way).encode()).digest()
            if key not in seen:
                seen.add(key)
                yield root, way


def reached(edges: list[tuple[str, str | None]]) -> Iterator[tuple[str]]:
    """The nodes that seeds, edges without an end, lead to, and the seeds."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        if b is not None:
            out.setdefault(a, []).append(b)
    rest = [a for a, b in edges if b is None]
    seen = set(rest)
    yield from ((a,) for a in seen)
    while rest:
        for x in out.pop(rest.pop(), ()):
            if x not in seen:
                seen.add(x)
                rest.append(x)
                yield (x,)


def members(edges: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(node, component) of the nodes of cycles."""
    yield from cyclic(links(edges)).items()


def _each(edges: DataFrame, solve: Callable, schema: pa.Schema, kinds: str) -> DataFrame:
    """The rows that solve() gives for the edges (src, dst) of each scan, behind its scan_id; each batch weighs little,
    whatever a scan has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, weight = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

        for scan, own in scans(batches):
            for row in solve(own):
                made.append((scan, *row))
                weight += len(row[-1]) + 2 if isinstance(row[-1], list) else 3
                if weight > _BATCH:
                    yield batch()
                    made, weight = [], 0
        if made:
            yield batch()

    return edges.select(KEY, "src", "dst").repartition(KEY).sortWithinPartitions(KEY).mapInArrow(run, kinds)


def scans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Each scan with its edges, of batches (scan_id, src, dst) in the order of scans."""
    last, own = None, []
    for b in batches:
        for scan, src, dst in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if scan != last:
                if own:
                    yield last, own
                last, own = scan, []
            own.append((src, dst))
    if own:
        yield last, own


def find_cycles(edges: DataFrame) -> DataFrame:
    return _each(edges, least_cycles, _CYCLES, f"{KEY} string, component string, cycle array<string>")


def edge_cycles(edges: DataFrame) -> DataFrame:
    return _each(edges, cycles_of_edges, _CYCLES, f"{KEY} string, component string, cycle array<string>")


def reachable(edges: DataFrame) -> DataFrame:
    return _each(edges, reached, _NODES, f"{KEY} string, node string")


def components(edges: DataFrame) -> DataFrame:
    return _each(edges, members, _COMPONENTS, f"{KEY} string, node string, component string")
