"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Links that a task reduces at a time.
LINKS_PER_TASK = 200_000


def _forest(links: DataFrame, tasks: int) -> DataFrame:
    """Each task's links (u, v) reduced to stars: every node but the least of its part, with that least node."""
    import pandas as pd

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while (y := up.get(x, x)) != top:
                up[x], x = top, y
            return top

        for pdf in batches:
            for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in list(up)]
        for at in range(0, len(pairs), 50_000):
            yield pd.DataFrame(pairs[at : at + 50_000], columns=["u", "v"], dtype="int64")

    return links.select("u", "v").repartition(tasks).mapInPandas(reduce, "u long, v long")


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step of alternating stars over links (u, v) with u > v: large stars tie each greater neighbour of a node to
    the node's least neighbour, small stars tie the node itself and its lesser neighbours to it."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(materialise(least, "least"), "u")  # written, so that the join can split a node of many links
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for each node that a link names; links to itself count as nodes.

    Tasks first reduce LINKS_PER_TASK links each to stars.  When one task was enough these are the components; else
    alternating large and small stars join them: the number of links never grows, and each round is two joins whose
    keys are nodes.  Both sides of each join come from the shared folder by shuffles of their own, so adaptive execution
    splits a node of very many links.  Each round is written there.
    Null ends are ignored; an empty table gives an empty table.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ends = materialise(ends, "links")
    alone = ends.where("u = v").select("u").distinct()
    tasks = max(1, -(-ends.count() // LINKS_PER_TASK))
    now = materialise(_forest(ends.where("u <> v"), tasks), "links")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()

    before = state(now) if tasks > 1 else (0, 0)
    for _ in range(rounds):
        if before[0] == 0:
            break
        now = materialise(_stars(_stars(now, True), False), "links")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    tied = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = tied.unionByName(roots)
    rest = alone.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found.select("node"), "node", "left_anti")
    return found.unionByName(rest)
