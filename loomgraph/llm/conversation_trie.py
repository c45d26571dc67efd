"""Prefix trie of conversations with count-min screening (operator 13).

A node is a sequence of first turns (role, text); the conversations that begin with it are its members.  A prefix has a
digest of 128 bits: the exclusive or of its turns' digests, each mixed with the turn's place, so prefixes of a very long
conversation are computed in blocks by many tasks and put together.

A count-min sketch of all prefix digests screens them: it never estimates too low, so an estimate of one proves a
singleton.  Whatever lies below a singleton is one too, and is emitted where it stands, without a shuffle.  Only turns
whose parent may be shared are grouped exactly by their digest.  The sketch has four counters for each turn in each of its
two rows, but SKETCH_CELLS at most (a byte each, so what is broadcast is 64 MB at most): beyond that more prefixes pass
for shared, and the result stays exact.

Sums over subtrees need no walk down the tree.  Each node belongs to its smallest member; what a member owns is the end
of its path.  The subtree of a node is what its members own at its depth or below, so sums run along each conversation
from its end, and add up over the members of each node.

Conversations with a common beginning meet in one key: grouping combines before it shuffles, nodes are written before
turns are joined to them, so that a join's large side can be split; identifiers of conversations that end at a node are
sorted by ranges and hashed as texts of many identifiers, as they come.

Edge cases: null roles and texts count as empty; turns that stand at the same place are taken by the digest of role and
text, repeated ones each; turns of a null conv_id belong to no conversation; other columns are ignored; an empty table
gives an empty table, conversations without turns only a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rollup import ranked
from .common import materialise

#: Turns of one conversation that one task takes together.
BLOCK = 4096
#: Counters of a row of the sketch: at most so many, and a power of two.
SKETCH_CELLS = 1 << 25
#: Counters of a part of the sketch, and identifiers of a text that is hashed at once.
PART, IDS = 1 << 16, 50_000

NODE = ["p1", "p2"]


def _half(hexadecimal: Column, at: int) -> Column:
    return F.conv(F.substring(hexadecimal, at, 15), 16, 10).cast("long")


def numbered_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, pos (from 1), x and y (digest of role and text), bytes (of the text): the turns in order, null first."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", _half(F.col("digest"), 1).alias("x"), _half(F.col("digest"), 16).alias("y"), "bytes")
    order = [F.col("turn").asc_nulls_first(), F.col("x").asc(), F.col("y").asc(), F.col("bytes").asc()]
    return ranked(rows, ["conv_id"], order, "pos").drop("turn")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("m"))


def rebuilt(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations with their lengths m): each conversation c takes over the first h turns of conversation
    c - c % every, h = crc32(c as text) % heads, and keeps its own behind its first h."""
    turns = materialise(turns, "turns")
    own = materialise(lengths(turns).withColumnRenamed("m", "n"), "conversations")
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    plan = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    plan = plan.withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("m", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    plan = materialise(plan.select("conv_id", "base", "h", "k", "n", "m"), "plan")
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base")
    taken = first.join(plan.select("conv_id", "base", "h", "m"), "base").where("pos <= h").select("conv_id", F.col("pos").cast("long").alias("d"), "x", "y", "bytes", "m")
    # a very long conversation is joined block by block
    blocks = plan.select("conv_id", "h", "k", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {BLOCK}"))).alias("block"))
    kept = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv_id", "block"]).where("pos > h")
    kept = kept.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "x", "y", "bytes", "m")
    return taken.unionByName(kept), plan.select("conv_id", "m")


def _along(rows: DataFrame, sums: dict[str, Column], total, backwards: bool = False) -> DataFrame:
    """rows with running totals (by `total`, an aggregate) along each conversation; a long one is taken in blocks, whose
    own totals are put before."""
    rows = rows.withColumn("block", F.expr(f"d div {BLOCK}"))
    order = lambda c: F.col(c).desc() if backwards else F.col(c)
    edge = W.partitionBy("conv_id").orderBy(order("block")).rowsBetween(W.unboundedPreceding, -1)
    parts = rows.where(f"m >= {BLOCK}").groupBy("conv_id", "block").agg(*(total(c).alias(n) for n, c in sums.items()))
    ahead = materialise(parts.select("conv_id", "block", *(F.coalesce(total(F.col(n)).over(edge), F.lit(0)).cast("long").alias(f"_{n}") for n in sums)), "blocks")
    inside = W.partitionBy("conv_id", "block").orderBy(order("d")).rowsBetween(W.unboundedPreceding, 0)
    own = rows.select("*", *(total(c).over(inside).alias(n) for n, c in sums.items())).join(ahead, ["conv_id", "block"], "left")
    put = total is F.bit_xor
    out = {n: (F.col(n).bitwiseXOR(F.coalesce(F.col(f"_{n}"), F.lit(0))) if put else F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))) for n in sums}
    return own.withColumns(out).drop("block", *(f"_{n}" for n in sums))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, d, m, bytes, p1, p2 (digest of the first d turns), q1, q2 (of the first d - 1)."""
    mixed = turns.withColumns({c: F.xxhash64(F.lit(i), "d", "x", "y") for i, c in enumerate(("a", "b"))})
    rows = _along(mixed, {"p1": F.col("a"), "p2": F.col("b")}, F.bit_xor)
    return rows.select("conv_id", "d", "m", "bytes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("a")).alias("q1"), F.col("p2").bitwiseXOR(F.col("b")).alias("q2"))


def _cells(a: np.ndarray, b: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (a.view(np.uint64) & mask).astype(np.int64), (b.view(np.uint64) & mask).astype(np.int64) + cells


class Sketch:
    """Count-min sketch of prefix digests, counters stopping at two: two rows of `cells` bytes."""

    def __init__(self, rows: DataFrame, most: int):
        n = rows.count()
        self.cells = min(most, max(PART // 2, 1 << (4 * n).bit_length()))
        cells, part = self.cells, PART

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(2 * cells, np.uint8)
            for batch in batches:
                for at in _cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells):
                    cell, times = np.unique(at, return_counts=True)
                    counts[cell] = np.minimum(2, counts[cell] + np.minimum(2, times)).astype(np.uint8)
            for i in range(0, 2 * cells, part):
                if counts[i : i + part].any():
                    yield pa.RecordBatch.from_pydict({"part": [i // part], "counts": [counts[i : i + part].tobytes()]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, None
            out = lambda: pa.RecordBatch.from_pydict({"part": [now], "counts": [total.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))
            for batch in batches:
                for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = np.frombuffer(counts.as_buffer(), np.uint8)
                    if i != now:
                        if now is not None:
                            yield out()
                        now, total = i, own.copy()
                    else:
                        total = np.minimum(2, total + own).astype(np.uint8)
            if now is not None:
                yield out()

        filled = rows.select("p1", "p2").mapInArrow(fill, "part int, counts binary")
        merged = materialise(filled.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "part int, counts binary"), "sketch")
        counts = np.zeros(2 * cells, np.uint8)
        for r in merged.toLocalIterator():
            counts[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["counts"], np.uint8)
        self.counts = rows.sparkSession.sparkContext.broadcast(counts)

    def shared(self, a: str, b: str) -> Column:
        """Whether a digest's estimate is two or more; false proves that the prefix has one member."""
        counts, cells = self.counts, self.cells

        @F.pandas_udf("boolean")
        def judge(x: pd.Series, y: pd.Series) -> pd.Series:
            i, j = _cells(x.to_numpy(np.int64), y.to_numpy(np.int64), cells)
            return pd.Series(np.minimum(counts.value[i], counts.value[j]) > 1)

        return judge(a, b)


def _end_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256: of the ascending identifiers at each node, joined by commas."""
    kind, key = "p1 long, p2 long, first long, ids string", ["p1", "p2"]
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, ids = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.concatenate([[True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]), [True]])) if len(ids) else np.zeros(0, int)
            spans = [(a, min(a + IDS, y)) for x, y in zip(cut, cut[1:], strict=False) for a in range(x, y, IDS)]
            rows = [(int(p1[a]), int(p2[a]), int(ids[a]), ",".join(map(str, ids[a:b].tolist()))) for a, b in spans]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        kinds = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])
        out: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
        for batch in batches:
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if (a, b) != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if out:
                yield batch_of()
                out = []
        if now is not None:
            out.append((*now, sha.hexdigest()))
            yield batch_of()

    sorted_ = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    chunks = sorted_.select(*key, "conv_id").mapInArrow(texts, kind)
    return chunks.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digests, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, sketch_cells: int = SKETCH_CELLS) -> DataFrame:
    """The trie of turns (conv_id, d, x, y, bytes, m: turns of the conversation) and conversations (conv_id, m).

    One row a node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over
    the node's subtree: bytes of each node's last text for all its members but one), ends_sha256.
    """
    rows = materialise(prefixes(turns), "prefixes")
    conversations = materialise(conversations, "conversations")
    n_all, smallest = conversations.agg(F.count("*"), F.min("conv_id")).first()
    sketch = Sketch(rows, sketch_cells)
    may = sketch.shared("q1", "q2") | (F.col("d") == 1)
    asked = materialise(rows.where(may), "asked")
    empty = F.sha2(F.lit("").cast("binary"), 256)

    tail = rows.where(~may)
    last = F.col("d") == F.col("m")
    tails = tail.select(
        "conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).alias("n_convs"), F.when(last, 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"),
        F.lit(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(empty).alias("ends_sha256"),
    )

    # exact groups; members' sums are joined to them later
    nodes = materialise(asked.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.count_if(last).alias("n_ends"), F.max("d").alias("depth"), F.max("bytes").alias("bytes"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    ), "nodes")
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("parent"), F.col("n_convs").alias("parent_convs"))
    children = materialise(nodes.groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("children")), "children")
    alone = F.col("n_convs") == 1
    # a leaf is counted at its node, or where its only member's singletons begin; a parent that isn't here has one member
    begins = (F.col("depth") == 1) | (F.coalesce("parent_convs", F.lit(1)) > 1)
    leaf = F.when(alone, begins).otherwise(F.col("n_ends") == F.col("n_convs")).cast("long")
    nodes = nodes.join(parents, ["q1", "q2"], "left").join(children, NODE, "left").select(
        *NODE, "owner", "depth", "n_convs", "n_ends",
        F.when(F.col("depth") == 1, F.lit(smallest)).otherwise(F.coalesce("parent", "owner")).alias("parent_conv_id"),
        F.when(alone, 1 - F.col("n_ends")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    nodes = materialise(nodes, "nodes")

    own = asked.select("conv_id", "d", "m", *NODE).join(nodes.select(*NODE, "owner", "leaf", "saved", "n_convs"), NODE)
    mine = lambda c: F.when(F.col("owner") == F.col("conv_id"), F.col(c)).otherwise(0)
    own = own.select("conv_id", "d", "m", *NODE, mine("leaf").alias("leaf"), mine("saved").alias("saved"), (F.col("n_convs") > 1).alias("many"))
    along = _along(own, {"leaves": F.col("leaf"), "bytes": F.col("saved")}, F.sum, backwards=True).where("many")
    sums = along.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("bytes").alias("bytes"))

    turnless = conversations.where("m = 0").select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv_id")
    ends = materialise(_end_digests(asked.where(last).select(*NODE, "conv_id").unionByName(turnless)), "ends")
    shared = nodes.join(sums, NODE, "left").join(ends, NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("bytes", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    if not n_all:
        return shared
    at_root = ends.where("p1 = 0 and p2 = 0").first()
    top = nodes.agg(
        F.lit(smallest).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_all).cast("long").alias("n_convs"), F.count_if(F.col("depth") == 1).alias("n_children"),
        F.greatest(F.lit(1), F.coalesce(F.sum("leaf"), F.lit(0))).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), (F.lit(at_root["ends_sha256"]) if at_root else empty).alias("ends_sha256"),
    )
    kinds = [F.col(c).cast("string" if c == "ends_sha256" else "long") for c in shared.columns]
    return shared.select(kinds).unionByName(tails.select(kinds)).unionByName(top.select(kinds))


def conversation_trie(conversations: DataFrame, sketch_cells: int = SKETCH_CELLS) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = materialise(numbered_turns(conversations), "turns")
    whole = materialise(lengths(turns), "lengths")
    blocks = whole.select("conv_id", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"m div {BLOCK}"))).alias("block"))
    rows = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv_id", "block"]).select("conv_id", F.col("pos").cast("long").alias("d"), "x", "y", "bytes", "m")
    return prefix_trie(rows, whole, sketch_cells)
