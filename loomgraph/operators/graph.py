"""Graph operators as loops of joins: components, cycles, reachability.  Nothing of the graph passes the driver but
counts; each round is written to the shared checkpoint folder, so a lost executor costs no more than its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise
from . import in_task

KEY = "scan_id"
#: Edges of a scan that one task takes whole.
TASK_EDGES = 20_000
#: Nodes up to which a graph's closure by squaring is cheaper than rounds of colours.
SMALL_CORE = 300
#: Best connected nodes whose components are looked for first; nodes from which on a walk takes one hop at a time.
PIVOTS, WIDE = 1000, 100_000
#: Edges of one node that a task may hold; those of a node with more are dealt to several parts.
HUB = 1_000_000


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage at a table in the folder that executors share."""
    return materialise(df, "graph")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _split(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(edges of scans that a task takes whole, those of all others) of a written table; None where there are none."""
    sizes = edges.groupBy(KEY).agg(F.count("*").alias("n"))
    large = F.col("n") > TASK_EDGES
    n_small, n_large = sizes.agg(F.count_if(~large), F.count_if(large)).first()
    if not n_small or not n_large:
        return (edges if n_small else None), (edges if n_large else None)
    named = _cut(sizes.where(large).select(KEY))  # fewer than edges / TASK_EDGES
    return edges.join(named, KEY, "left_anti"), _cut(edges.join(named, KEY, "left_semi"))


class Dealt:
    """Edges (scan_id, src, dst) for joins on src.  The edges of a hub are dealt to parts of about HUB edges by their other
    end, and what is joined to them comes once for each part (a vertex cut); where no node has so many, nothing changes.
    Hubs are fewer than edges / HUB."""

    def __init__(self, edges: DataFrame):
        self.edges, self.hubs = edges, None
        if edges.count() > HUB:
            hubs = edges.groupBy(KEY, "src").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1")
            self.hubs = _cut(hubs)
            if self.hubs.isEmpty():
                self.hubs = None
        if self.hubs is not None:
            part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
            self.edges = _cut(edges.join(self.hubs, [KEY, "src"], "left").select(*edges.columns, part.alias("part")))

    def join(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """rows (scan_id, src, ...) joined with the edges from there; left_semi: the edges whose src is among rows."""
        on, edges = [KEY, "src"], self.edges
        if self.hubs is not None:
            parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
            rows = rows.join(self.hubs, on, "left").withColumn("part", parts).drop("parts")
            on = [*on, "part"]
        out = edges.join(rows.select(on), on, "left_semi") if how == "left_semi" else rows.join(edges, on)
        return out.drop("part")


def reachable(seeds: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """scan_id, node: seeds (scan_id, node) and all that edges (scan_id, src, dst) lead to; `hops` joins between checks.
    Small scans go to tasks whole, seeds among the edges."""
    seeds = _cut(seeds.select(KEY, "node").where(f"{KEY} is not null and node is not null").distinct())
    edges = _cut(edges.select(KEY, "src", "dst").where(f"{KEY} is not null and src is not null and dst is not null"))
    rows = edges.unionByName(seeds.select(KEY, F.col("node").alias("src"), F.lit(None).cast("string").alias("dst")))
    small, large = _split(rows)
    parts = []
    if small is not None:
        parts.append(in_task.reachable(small))
    if large is not None:
        parts.append(_spread(_cut(large.where("dst is null").select(KEY, F.col("src").alias("node"))), _cut(large.where("dst is not null").distinct()), hops))
    return _union(parts, seeds)


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty.limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cycles(edges: DataFrame, every_edge: bool = False) -> DataFrame:
    """scan_id, component, cycle: find_cycles (or edge_cycles) of all of edges (scan_id, src, dst); small scans go to tasks
    whole."""
    edges = _cut(edges.select(KEY, "src", "dst").where(f"{KEY} is not null and src is not null and dst is not null"))
    small, large = _split(edges)
    parts = []
    if small is not None:
        parts.append((in_task.edge_cycles if every_edge else in_task.find_cycles)(small))
    if large is not None:
        components = _cut(scc(participating(large), large))
        parts.append((edge_cycles if every_edge else find_cycles)(large, components))
    return _union(parts, _empty(edges.sparkSession, f"{KEY} string, component string, cycle array<string>"))


def _spread(found: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """reachable() over written tables without repeated rows.  A large frontier goes one hop at a time, so that every node
    goes on once; a small one `hops` at a time."""
    frontier, dealt = found, Dealt(edges)
    while n := frontier.count():
        step, new = frontier, None
        for _ in range(hops if n < WIDE else 1):
            step = dealt.join(step.withColumnRenamed("node", "src")).select(KEY, F.col("dst").alias("node")).distinct()
            new = step if new is None else new.unionByName(step)
        frontier = _cut(new.distinct().join(found, [KEY, "node"], "left_anti"))
        found = found.unionByName(frontier)  # each part is a written table
    return found


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, F.col("dst").alias("src"), F.col("src").alias("dst"))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edges with neither end among the nodes that are gone (scan_id, node)."""
    for end in ("src", "dst"):
        edges = edges.join(gone.select(KEY, F.col("node").alias(end)), [KEY, end], "left_anti")
    return edges.select(KEY, "src", "dst")


def _spread_min(labels: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Least label that reaches each node along edges, to the fixpoint; labels: scan_id, node, label, a written table.  Only
    what has changed goes on, a large part of it one hop at a time; what a node had before stays in an earlier table."""
    least = lambda df: df.groupBy(KEY, "node").agg(F.min("label").alias("label"))
    dealt, parts, changed = Dealt(edges), labels, labels
    while n := changed.count():
        step, came = changed, None
        for _ in range(hops if n < WIDE else 1):
            step = least(dealt.join(step.withColumnRenamed("node", "src")).select(KEY, F.col("dst").alias("node"), "label"))
            came = step if came is None else came.unionByName(step)
        old = least(parts).withColumnRenamed("label", "old")
        changed = _cut(least(came).join(old, [KEY, "node"], "left").where("old is null or label < old").drop("old"))
        parts = parts.unionByName(changed)
    return _cut(least(parts))


def _coloured(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """scan_id, node, component (least seed of it) of the components of those seeds (scan_id, node) that no lesser seed leads
    to: all nodes take the least seed that reaches them, and what leads back to a seed inside its colour is its component."""
    colour = _spread_min(_cut(seeds.select(KEY, "node", F.col("node").alias("label"))), edges, hops)
    frontier = found = _cut(colour.where("node = label"))
    dealt = Dealt(_turned(edges))
    while n := frontier.count():
        step, new = frontier, None
        for _ in range(hops if n < WIDE else 1):
            step = dealt.join(step.withColumnRenamed("node", "src")).select(KEY, F.col("dst").alias("node"), "label").distinct()
            step = step.join(colour, [KEY, "node", "label"], "left_semi")
            new = step if new is None else new.unionByName(step)
        frontier = _cut(new.distinct().join(found, [KEY, "node", "label"], "left_anti"))
        found = found.unionByName(frontier)
    return found.withColumnRenamed("label", "component")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan_id, node, n; edges of the numbers): every node has a number of its own, which is less the more edges it has both
    in and out.  The edges have one scan_id, as no two scans share a number."""
    out, into = (edges.groupBy(KEY, F.col(c).alias("node")).agg(F.count("*").alias(n)) for c, n in (("src", "o"), ("dst", "i")))
    both = out.join(into, [KEY, "node"], "full").select(KEY, "node", F.least(F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))).alias("d"))
    order = [F.desc("d"), F.asc(KEY), F.asc("node")]
    # ranges in order, so numbers rise with them; written, so that they stay
    numbers = _cut(_cut(both).repartitionByRange(*order).sortWithinPartitions(*order).select(KEY, "node", F.monotonically_increasing_id().alias("n")))
    for end in ("src", "dst"):
        edges = edges.join(numbers.select(KEY, F.col("node").alias(end), F.col("n").alias(f"_{end}")), [KEY, end])
    return numbers, _cut(edges.select(F.lit(0).alias(KEY), F.col("_src").alias("src"), F.col("_dst").alias("dst")))


def _joined_components(edges: DataFrame, hops: int, trims: int) -> DataFrame:
    """scan_id, node, component for the nodes of cycles of more than one node, by rounds of joins over numbers."""
    numbers, rest = _numbered(edges)
    best = participating(rest).orderBy("node").limit(PIVOTS)
    done = _cut(_coloured(best, rest, hops))
    rest = _trimmed(_without(rest, done), trims)
    while not rest.isEmpty():
        ends = _cut(participating(rest))
        if ends.count() <= SMALL_CORE:
            done = done.unionByName(_cut(_closure_components(rest)))
            break
        part = _cut(_coloured(ends, rest, hops))
        done = done.unionByName(part)
        rest = _trimmed(_without(rest, part), trims)
    named = _cut(numbers.join(done.select(F.col("node").alias("n"), F.col("component").alias("c")), "n").select(KEY, "node", "c"))
    return named.join(named.groupBy("c").agg(F.min("node").alias("component")), "c").select(KEY, "node", "component")


def _trimmed(edges: DataFrame, trims: int) -> DataFrame:
    """edges without nodes that nothing enters or leaves, as far as rounds of `trims` steps take away a tenth each."""
    edges = _cut(edges)
    left = edges.count()
    while left:
        now = edges
        for _ in range(trims):
            into, out = now.select(KEY, F.col("dst").alias("src")).distinct(), now.select(KEY, F.col("src").alias("dst")).distinct()
            if left > HUB:  # each step from written tables: a hub's edges go in parts from either end
                entered = _cut(Dealt(now).join(into, "left_semi").select(KEY, "src", "dst"))
                now = _cut(_turned(Dealt(_turned(entered)).join(out.withColumnRenamed("dst", "src"), "left_semi")))
            else:
                now = now.join(into, [KEY, "src"], "left_semi").join(out, [KEY, "dst"], "left_semi")
        edges = _cut(now.select(KEY, "src", "dst"))
        before, left = left, edges.count()
        if left > 0.9 * before:
            break
    return edges


def _closure_components(edges: DataFrame) -> DataFrame:
    """scan_id, node, component by squaring the relation of a small graph: nodes that reach each other belong together."""
    reach, n = _cut(edges.select(KEY, "src", "dst").distinct()), -1
    while (now := reach.count()) != n:
        n = now
        step = reach.withColumnRenamed("dst", "mid").join(reach.withColumnRenamed("src", "mid"), [KEY, "mid"]).select(KEY, "src", "dst")
        reach = _cut(reach.unionByName(step).distinct())
    back = reach.select(KEY, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach.join(back, [KEY, "src", "dst"]).groupBy(KEY, F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("component"))


def scc(nodes: DataFrame, edges: DataFrame, hops: int = 4, trims: int = 4) -> DataFrame:
    """scan_id, node, component (least node of the strongly connected component), size, in_cycle.

    nodes: scan_id, node; edges: scan_id, src, dst (those with an unknown end are dropped).  Small scans go to tasks whole.
    The nodes of the others get numbers, best connected ones first.  The components of the first few numbers go first, by
    what they reach and what reaches them.  From the rest, nodes without edges in or out are trimmed; a small rest is
    closed by squaring; else a round colours every node with the least number that reaches it, and walks back from each
    colour's root; what the walk meets is the root's component.  All scans go through the rounds together.
    """
    nodes = _cut(nodes.select(KEY, "node").distinct())  # a written side: adaptive execution splits the joins for a hub
    known = edges.select(KEY, "src", "dst").distinct()
    for end in ("src", "dst"):
        known = known.join(nodes.withColumnRenamed("node", end), [KEY, end], "left_semi")
    known = _cut(known)
    loops = known.where("src = dst").select(KEY, F.col("src").alias("node"))
    small, large = _split(known.where("src <> dst"))
    done = []
    if small is not None:
        done.append(in_task.components(small))
    if large is not None:
        done.append(_joined_components(large, hops, trims))
    done = _union([_cut(d) for d in done], nodes.withColumn("component", F.col("node")))
    named = nodes.join(done, [KEY, "node"], "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy(KEY, "component").agg(F.count("*").alias("size"))
    looped = loops.withColumn("loop", F.lit(True))
    out = named.join(sizes, [KEY, "component"]).join(looped, [KEY, "node"], "left")
    return out.select(KEY, "node", "component", "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("in_cycle"))


def circular_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """edges with `circular`: both ends in one cyclic component."""
    c = components.where("in_cycle")
    out = edges.join(c.select(KEY, F.col("node").alias("src"), F.col("component").alias("_a")), [KEY, "src"], "left")
    out = out.join(c.select(KEY, F.col("node").alias("dst"), F.col("component").alias("_b")), [KEY, "dst"], "left")
    return out.withColumn("circular", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def find_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """scan_id, component, cycle: for each cyclic component, a shortest cycle through its least node, from that node (one
    of a component; edge_cycles gives cycles that hold every circular edge).

    Breadth-first search from the roots, one array a reached node (the least path of its length); a component leaves the
    frontier when it is closed.
    """
    cyclic = components.where("in_cycle").select(KEY, "node", "component")
    inside = edges.select(KEY, "src", "dst").distinct()
    inside = inside.join(cyclic.withColumnRenamed("node", "src"), [KEY, "src"])
    inside = _cut(inside.join(cyclic.select(KEY, F.col("node").alias("dst"), F.col("component").alias("c2")), [KEY, "dst"]).where("component = c2").select(KEY, "component", "src", "dst"))
    seen = _cut(cyclic.where("node = component").select(KEY, "component", "node", F.array("node").alias("path")))
    frontier, closed = seen, _empty(edges.sparkSession, f"{KEY} string, component string, cycle array<string>")
    while not frontier.isEmpty():
        f = frontier.withColumnRenamed("node", "src")
        step = _cut(f.join(inside, [KEY, "component", "src"]).select(KEY, "component", F.col("dst").alias("node"), "path"))
        ends = step.where("node = component").groupBy(KEY, "component").agg(F.min("path").alias("cycle"))
        closed = _cut(closed.unionByName(ends))
        new = step.where("node <> component").groupBy(KEY, "component", "node").agg(F.min("path").alias("path"))
        new = new.join(closed.select(KEY, "component"), [KEY, "component"], "left_anti").join(seen.select(KEY, "component", "node"), [KEY, "component", "node"], "left_anti")
        frontier = _cut(new.select(KEY, "component", "node", F.concat("path", F.array("node")).alias("path")))
        seen = _cut(seen.unionByName(frontier))
    return closed


def _paths(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """scan_id, component, node, path: a shortest path from its component's root to each node (of several the one whose
    beginning is least), by breadth-first search; roots: scan_id, component, node, path."""
    frontier = seen = roots
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("node", "src").join(edges, [KEY, "component", "src"])
        new = step.groupBy(KEY, "component", F.col("dst").alias("node")).agg(F.min("path").alias("path")).join(seen.select(KEY, "component", "node"), [KEY, "component", "node"], "left_anti")
        frontier = _cut(new.select(KEY, "component", "node", F.concat("path", F.array("node")).alias("path")))
        seen = seen.unionByName(frontier)  # each part is a written table
    return _cut(seen)


def edge_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """scan_id, component, cycle: simple cycles, from their least node, in which every edge of a cyclic component lies.

    An edge from u to v is closed by the way from v back to the component's root and on to u, along two trees of shortest
    paths (into the root and out of it).  Where these two ways meet for the first time, seen from v, the first is left for
    the second, so no node comes twice.  The same cycle found from several edges counts once; cycles of the same nodes in
    another order stay apart, as they hold other edges.
    """
    cyclic = components.where("in_cycle").select(KEY, "node", "component")
    inside = edges.select(KEY, "src", "dst").distinct().join(cyclic.withColumnRenamed("node", "src"), [KEY, "src"])
    inside = _cut(inside.join(cyclic.select(KEY, F.col("node").alias("dst"), F.col("component").alias("c2")), [KEY, "dst"]).where("component = c2").select(KEY, "component", "src", "dst"))
    roots = _cut(cyclic.where("node = component").select(KEY, "component", "node", F.array("node").alias("path")))
    there = _paths(roots, inside).select(KEY, "component", F.col("node").alias("src"), F.col("path").alias("there"))
    turned = inside.select(KEY, "component", F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = _paths(roots, turned).select(KEY, "component", F.col("node").alias("dst"), F.reverse("path").alias("back"))
    both = inside.join(there, [KEY, "component", "src"]).join(back, [KEY, "component", "dst"])
    meet = F.get(F.array_intersect("back", "there"), F.lit(0))
    both = both.withColumn("meet", meet)
    way = F.concat(F.slice("back", F.lit(1), F.array_position("back", F.col("meet")).cast("int")), F.expr("slice(there, cast(array_position(there, meet) as int) + 1, size(there))"))
    both = both.withColumn("way", way).withColumn("first", F.array_position("way", F.array_min("way")).cast("int"))
    turned_to = F.concat(F.expr("slice(way, first, size(way))"), F.expr("slice(way, 1, first - 1)"))
    return both.select(KEY, "component", turned_to.alias("cycle")).distinct()


def hops_of(cycles: DataFrame) -> DataFrame:
    """scan_id, src, dst: the edges of cycles, each once."""
    rows = cycles.select(KEY, "cycle", F.posexplode("cycle").alias("pos", "src"))
    return rows.select(KEY, "src", F.get("cycle", F.pmod(F.col("pos") + 1, F.size("cycle"))).alias("dst")).distinct()


def participating(edges: DataFrame) -> DataFrame:
    return edges.select(KEY, F.col("src").alias("node")).unionByName(edges.select(KEY, F.col("dst").alias("node"))).distinct()


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scan_id, node, neighbour: neighbours in either direction, and the node itself."""
    both = edges.select(KEY, F.col("src").alias("node"), F.col("dst").alias("neighbour")).unionByName(edges.select(KEY, F.col("dst").alias("node"), F.col("src").alias("neighbour")))
    own = nodes.select(KEY, "node", F.col("node").alias("neighbour"))
    return both.join(nodes.select(KEY, "node").distinct(), [KEY, "node"], "left_semi").unionByName(own).distinct()


def most_connected(edges: DataFrame, k: int) -> DataFrame:
    """The k nodes of most edges (of each scan), both directions counted; each task passes on its own k at most."""
    from pyspark.sql import Window as W

    ends = edges.select(KEY, F.col("src").alias("node")).unionByName(edges.select(KEY, F.col("dst").alias("node")))
    degree = ends.groupBy(KEY, "node").agg(F.count("*").alias("degree"))
    order = W.partitionBy(KEY).orderBy(F.desc("degree"), "node")
    return degree.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
