"""Near-duplicates: an LSH forest over MinHash signatures, with links confirmed on full sets (operator 4).

A document's set is its distinct k-word shingles (with fewer words, the whole sequence as one; without words, empty).
Documents are linked when their sets' Jaccard similarity reaches the threshold.

1. Signatures: one pass makes each document's set, a 128-bit key of the set and a signature of HASHES min-hashes.
   Documents of equal sets become one class, named by its least identifier: copies cost one row each from here on,
   and are pre-aggregated, so that a set which very many documents have meets in no task.
2. Forest: TREES sorted orders of the classes.  Tree t's key is the signature read from hash DEPTH * t on (and around
   its end), so a sorted order is a trie.  Candidates are neighbours by longest common prefix: each class and the
   WINDOW classes before it in the order, as far as DEPTH hashes agree.  In a region of few classes these are all of
   its pairs; in a crowded one they are the pairs with the deepest prefixes, so depth follows the region.  At
   similarity s a tree holds a pair's prefix with probability s^DEPTH: at 0.8 all 24 trees miss it with 3e-6.  A window
   doesn't cross from one range of an order to the next, so a tree can also miss a pair of the WINDOW classes at
   either side of such a cut; ranges are few against classes.
3. Links within crowded regions: pairs of the first trees are confirmed first, and joined into components; of the
   other pairs, those inside one component can't change the result and are left out.  What a window can't reach in a
   region of more classes than it holds (members that are still in other components than the region's) is compared
   with all of the region in blocks, by signatures and then by full sets (each pair in the first tree that it shares);
   blocks are bounded in members and in bytes of their sets.
4. Confirmation compares the full sets as sorted 64-bit hashes of shingles (see Runs: different words share a hash with
   probability 2^-56 at most, whatever they are).  Components come from star contraction.

Edge cases: null identifiers keep a row but are linked with nothing; null, empty and blank texts have empty sets;
repeated rows of one identifier are one node; ties go to the least identifier; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, batches_of, bounded_batches, gram_hashes, map_rows, materialise
from .components import components

TREES, DEPTH, KEY_HASHES = 24, 4, 12
HASHES = TREES * DEPTH
WINDOW = 8
FIRST_TREES = 3
#: Share of equal hashes below which a pair can't reach the threshold: this many standard deviations off.
DEVIATIONS = 5.0
#: Rows of the sorted orders for a task.
ORDER_ROWS = 1_000_000
#: Members of a crowded region that are compared in one task, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1000, 32_000_000

_R = np.random.default_rng(977)
_XOR = _R.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _R.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column: pa.Array, k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words has one shingle, its words."""
    runs = Runs(column, lower=lower)
    for a, b in runs:
        if a == b:
            yield np.zeros(0, np.uint64)
        else:
            yield np.unique(gram_hashes(runs.hash[a:b], min(k, b - a)) + np.uint64(min(k, b - a)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES min-hashes, 16 bits of each kept; computed in blocks."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, ((x[at : at + 1024, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    mixed = low * np.uint32(0x85EBCA6B)
    return ((mixed ^ (mixed >> np.uint32(13))) >> np.uint32(16)).astype(">u2")


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary()), ("sketch", pa.binary())])


def signatures(docs: DataFrame, k: int, lower: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key, signature, sketch (a bit of each hash); the last three are null for empty sets."""

    def per_task():
        def each(batch):
            for d, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k, lower), strict=True):
                if len(s):
                    low = signature(s)
                    yield d, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), low.tobytes(), np.packbits(low & 1).tobytes()
                else:
                    yield d, 0, None, None, None

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, "doc_id long, n_shingles long, set_key binary, signature binary, sketch binary", _SIGNED, per_task)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32())])
REGION = f"xxhash64(tree, substring(key, 1, {2 * DEPTH})) AS region"


def forest(classes: DataFrame) -> DataFrame:
    """tree, key, sketch, cls: the sorted orders, still unsorted."""
    trees = classes.select("cls", "signature", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    key = F.expr(f"substring(concat(signature, signature), tree * {2 * DEPTH} + 1, {2 * KEY_HASHES})")
    return trees.select("tree", key.alias("key"), "sketch", "cls")


def neighbours(orders: DataFrame, partitions: int, threshold: float) -> DataFrame:
    """a < b, tree: candidate pairs from each sorted order.  The orders are dealt by ranges of (tree, key, cls), so a
    crowded region is cut also inside one key.  Pairs whose sketches differ in more bits than DEVIATIONS allow at the
    threshold (a bit differs with probability (1 - similarity) / 2) leave at once."""
    differ = (1 - threshold) / 2
    most = int(HASHES * differ + DEVIATIONS * (HASHES * differ * (1 - differ)) ** 0.5)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros((0, HASHES // 32), np.uint32), np.zeros(0, np.int64))
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(len(batch), -1)[:, 0]
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(len(batch), -1)
            new = (batch.column(0).to_numpy(), keys.astype(np.uint64), bits, batch.column(3).to_numpy())
            tree, prefix, sketch, cls = (np.concatenate(x) for x in zip(kept, new, strict=True))
            old, found = len(kept[0]), []
            for w in range(1, min(WINDOW, len(tree) - 1) + 1):
                same = (tree[w:] == tree[:-w]) & (prefix[w:] == prefix[:-w]) & (cls[w:] != cls[:-w])
                at = np.flatnonzero(same)
                at = at[at + w >= old]
                at = at[np.bitwise_count(sketch[at] ^ sketch[at + w]).sum(axis=1) <= most]
                found.append((cls[at], cls[at + w], tree[at]))
            if found:
                x, y, t = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(t)], schema=_PAIRS)
            kept = tree[-WINDOW:], prefix[-WINDOW:], sketch[-WINDOW:], cls[-WINDOW:]

    dealt = orders.repartitionByRange(partitions, "tree", "key", "cls").sortWithinPartitions("tree", "key", "cls")
    return dealt.mapInArrow(pairs, "a long, b long, tree int")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; sets: cls, hashes (sorted 64-bit, as bytes)."""
    share = round(threshold * 100)

    def per_task():
        def each(batch):
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share):
                    yield a, b

        return each

    ends = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a")
    ends = ends.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b")
    return map_rows(ends.select("a", "b", "x", "y"), "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]), per_task)


def crowded(orders: DataFrame) -> DataFrame:
    """tree, region (tree and first DEPTH hashes), members, cls: classes in regions of more than a window reaches."""
    named = orders.select("tree", F.expr(REGION), "cls")
    counted = named.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > WINDOW + 1)
    counted = materialise(counted, "regions")  # written, so that the join can split a region of very many members
    return named.join(counted, "region").select("tree", "region", "members", "cls")


def strays(member: DataFrame, classes: DataFrame, sets: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between a crowded region's members of different components; member: see crowded().

    A region's main component is its most frequent one; strays are members of the others.  Both sides are dealt to
    blocks of about BLOCK members, and each pair of blocks is compared in one task, so no task grows with a region:
    signatures first, then the full sets of those that may be linked.  One link to a component is enough.
    """
    member = member.join(found.select(F.col("node").alias("cls"), "component"), "cls", "left")
    member = materialise(member.select("tree", "region", "members", "cls", F.coalesce("component", "cls").alias("component")), "region-members")
    sizes = member.groupBy("region", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("region").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("parts"))
    main = materialise(main.where("parts > 1"), "regions")
    mixed = member.join(main, "region").join(classes.select("cls", "signature"), "cls").join(sets, "cls")
    mixed = materialise(mixed, "region-mixed")
    weight = materialise(mixed.groupBy("region").agg(F.sum(F.length("hashes")).alias("bytes")), "regions")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    mixed = mixed.join(weight, "region").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = [F.col(c).alias(c) for c in ("region", "cls", "component", "signature", "hashes", "tree")]  # columns of their own for each side
    left = mixed.where("component <> main").select(*columns, F.col("block").alias("sblock"), every.alias("block"))
    right = mixed.select(*columns, every.alias("sblock"), F.col("block").alias("block"))
    floor = threshold - DEVIATIONS * (threshold * (1 - threshold) / HASHES) ** 0.5
    share = round(threshold * 100)

    def compare(key, x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        if len(x) and len(y):
            t = x["tree"][0].as_py()
            ys = np.frombuffer(b"".join(y["signature"].to_pylist()), ">u2").reshape(-1, HASHES)
            yc, yk, yh = y["cls"].to_pylist(), y["component"].to_numpy(), y["hashes"]
            for c, k, s, h in zip(x["cls"].to_pylist(), x["component"].to_pylist(), x["signature"].to_pylist(), x["hashes"].to_pylist(), strict=True):
                same = ys == np.frombuffer(s, ">u2")
                near = (same.mean(axis=1) >= floor) & (yk != k)
                if t:  # a pair belongs to the first tree whose prefix it shares
                    near &= ~same[:, : t * DEPTH].reshape(len(ys), t, DEPTH).all(axis=2).any(axis=1)
                linked, own = set(), np.frombuffer(h, np.uint64)
                for i in np.flatnonzero(near).tolist():
                    if yk[i] not in linked and similar(own, np.frombuffer(yh[i].as_py(), np.uint64), share):
                        linked.add(yk[i])
                        out.append((min(c, yc[i]), max(c, yc[i])))
        pairs = list(dict.fromkeys(out))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    keys = ["region", "sblock", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """Whether 100 * intersection >= share * union, for sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common * 100 >= share * (len(both) - common)


def near_duplicates(
    docs: DataFrame, k: int = 5, threshold: float = 0.8, lower: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable), kept (doc_id = component_id).

    Documents without words are in a component of their own; rows of a null doc_id have a null component and are kept.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    signed = materialise(signatures(docs, k, lower, id_col, text_col), "signatures")
    keyed = signed.where("doc_id is not null and set_key is not null")
    one = keyed.groupBy("set_key").agg(F.min(F.struct("doc_id", "signature", "sketch")).alias("c"))
    classes = materialise(one.select(F.col("c.doc_id").alias("cls"), "set_key", "c.signature", "c.sketch"), "classes")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * TREES // ORDER_ROWS))
    orders = forest(classes)
    pairs = neighbours(orders, partitions, threshold).groupBy("a", "b").agg(F.min("tree").alias("tree"))
    pairs = materialise(pairs, "pairs")

    member = materialise(crowded(orders), "crowded")
    named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(member.select("cls"))
    sets = materialise(class_sets(docs, classes, named.distinct(), k, lower, id_col, text_col), "sets")
    first = pairs.where(F.col("tree") < FIRST_TREES).select("a", "b")
    links = materialise(confirmed(first, sets, threshold), "links-first")
    found = components(links)
    rest = apart(pairs.where(F.col("tree") >= FIRST_TREES).select("a", "b"), found)
    links = links.unionByName(materialise(confirmed(rest, sets, threshold), "links-rest"))
    found = components(links)
    late = materialise(strays(member, classes, sets, found, threshold), "links-strays")
    if not late.isEmpty():
        found = components(links.unionByName(late))
    # an identifier that stands for several sets (repeated rows) ties their classes together
    own = materialise(signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if not own.isEmpty():
        twice = keyed.join(own, "doc_id").join(classes.select("set_key", "cls"), "set_key").select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))
        ends = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(ends.unionByName(twice))
    # written, so that a set of very many documents can be split; documents without words stay out of the join
    of_set = classes.select("set_key", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("set_key", F.coalesce("component", "cls").alias("of_set"))
    worded = keyed.select("doc_id", "n_shingles", "set_key").join(materialise(of_set, "components"), "set_key").select("doc_id", "n_shingles", "of_set")
    others = signed.where("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("of_set"))
    component = F.coalesce("of_set", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return worded.unionByName(others).select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    out = pairs
    for end in "ab":
        out = out.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return out.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def class_sets(docs: DataFrame, classes: DataFrame, named: DataFrame, k: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """cls, hashes: the full sets of the classes that candidates name, made anew from one document of each class."""

    def per_task():
        def each(batch):
            for c, key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), k, lower), strict=True):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == key:
                    yield c, s.tobytes()

        return each

    texts = docs.select(F.col(id_col).cast("long").alias("cls"), F.col(text_col).alias("text"))
    rows = texts.join(classes.select("cls", "set_key").join(named, "cls", "left_semi"), "cls").select("cls", "set_key", "text")
    made = map_rows(rows, "cls long, hashes binary", pa.schema([("cls", pa.int64()), ("hashes", pa.binary())]), per_task, 500)
    return made.dropDuplicates(["cls", "hashes"])
