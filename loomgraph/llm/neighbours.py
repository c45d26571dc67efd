"""Approximate nearest neighbours by an inverted multi-index (operator 3).

Vectors are scaled to length 1 and cut in two halves, and each half is quantised by a codebook of its own; a vector's
cell is its pair of centroids.  A query walks over cells in ascending sum of its two halves' squared distances to the
centroids, by a heap over the two sorted lists, until the cells hold the share of vectors that the index was tuned to;
the vectors of these cells are ranked by exact cosine.

1. Equal vectors become one class with its KEEP least identifiers: no result needs more of them.  They are
   pre-aggregated by salt, so a vector that is very common meets in no task.
2. Codebooks come from k-means on a bounded sample of classes (those of least hash), and grow with the table: about one
   cell for CELL classes, from 24 to 512 centroids a half, SAMPLE classes or 32 for each centroid.  Every class is indexed.
3. The share to visit is measured: PROBES query classes are held against all classes by brute force, and the least
   share that finds TARGET of their neighbours is taken (the data decide: without structure it is large).
4. Queries and classes meet by bundles: small cells in a row are packed to about SLICE classes, larger ones are dealt to
   several bundles.  A query goes to each bundle of its cells once, with the cells' numbers; the queries of a bundle are
   dealt to parts of about QUERIES, so no task holds more than a bundle and a part.  A bundle is sent once for each of
   its parts and not at all where no query visits it, so copies are bounded by the bundles and a QUERIES-th of the
   visits.  Scores are a matrix product, and each query keeps its best few of its cells.

Edge cases: null vectors, zero vectors, vectors with null or non-finite components or of another length than most take
no part, and null identifiers neither; of rows that repeat an identifier each counts; ties go to the smaller
identifier; fewer candidates than asked for are returned as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, mix64

CENTROIDS, MOST_CENTROIDS, CELL = 24, 512, 1_000
SAMPLE, PROBES = 8_000, 100
TARGET = 0.95
SALTS, SLICE, QUERIES = 16, 2_000, 4_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of Lloyd's iteration; fewer than k when x has fewer rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
    return c


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = first, second
        self.half = first.shape[1]

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to its centroids."""
        halves = unit[:, : self.half], unit[:, self.half :]
        return [(h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1) for h, c in zip(halves, self.books, strict=True)]

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(axis=1) for d in self.distances(unit))
        return a * len(self.books[1]) + b

    def walk(self, d1: np.ndarray, d2: np.ndarray) -> Iterator[int]:
        """Cells in ascending d1[i] + d2[j]."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        heap, width = [(d1[o1[0]] + d2[o2[0]], 0, 0)], len(self.books[1])
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(o1[i]) * width + int(o2[j])
            if j + 1 < len(o2):
                heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))

    def visited(self, d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, most: float) -> list[int]:
        """The nearest cells that have vectors, until they hold `most` of them."""
        out, held = [], 0
        for cell in self.walk(d1, d2):
            if held >= most:
                break
            if sizes[cell]:
                out.append(cell)
                held += int(sizes[cell])
        return out


class Bundles:
    """Where the classes of each cell are: bundles first[c] .. first[c] + parts[c] - 1."""

    def __init__(self, sizes: np.ndarray, most: int):
        self.parts = np.maximum(1, -(-sizes // most))
        self.first = np.zeros(len(sizes), np.int64)
        bundle, held = 0, 0
        for c, n in enumerate(sizes.tolist()):
            if held + n > most and held:
                bundle, held = bundle + 1, 0
            self.first[c] = bundle
            held += n
            if n > most:  # a cell of several bundles has these to itself
                bundle, held = bundle + int(self.parts[c]), 0

    def of_classes(self, cells: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return self.first[cells] + (mix64(cls.astype(np.int64).view(np.uint64)) % self.parts[cells].astype(np.uint64)).astype(np.int64)

    def of_query(self, cells: list[int]) -> dict[int, list[int]]:
        """The cells to look at in each bundle."""
        out: dict[int, list[int]] = {}
        for c in cells:
            for k in range(int(self.parts[c])):
                out.setdefault(int(self.first[c]) + k, []).append(c)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 2))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine in double precision, each pair summed on its own, so that equal vectors get equal scores."""
    dot = np.einsum("qd,nd->qn", q, x)
    return dot / np.sqrt(np.einsum("qd,qd->q", q, q))[:, None] / np.sqrt(np.einsum("nd,nd->n", x, x))[None, :]


def vector_classes(vectors: DataFrame, keep: int, every: int, id_col: str, vector_col: str) -> DataFrame:
    """cls, vector, ids (the `keep` least), queries (whether an identifier divisible by `every` has it)."""
    v = F.col(vector_col).cast("array<double>")
    clean = F.size(v) > 0
    clean &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(clean)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("vector") == (lengths["n"] if lengths else 0))
    is_query = F.max(F.col("id") % every == 0)
    least = F.slice(F.array_sort(F.collect_list("id")), 1, keep)
    part = rows.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(least.alias("ids"), is_query.alias("asks"))
    whole = part.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("ids"), F.max("asks").alias("asks"))
    return whole.select(F.col("ids")[0].alias("cls"), "vector", "ids", "asks")


def _top(scores: np.ndarray, ids: np.ndarray, n: int) -> list[int]:
    """Places of the n best, ties to the smaller id."""
    if len(scores) > 4 * n:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:n].tolist()


def nearest(vectors: DataFrame, n: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the n nearest others of each row whose identifier is divisible by `every`."""
    spark = vectors.sparkSession
    keep = n + 1
    classes = materialise(vector_classes(vectors, keep, every, id_col, vector_col), "vector-classes")
    out = T.StructType([T.StructField(k, t) for k, t in (("query_id", T.LongType()), ("rank", T.IntegerType()), ("vec_id", T.LongType()), ("score", T.DoubleType()))])
    total = classes.count()
    centroids = int(min(MOST_CENTROIDS, max(CENTROIDS, (total / CELL) ** 0.5)))
    sample = classes.select("vector").orderBy(F.xxhash64("cls"), "cls").limit(max(SAMPLE, 32 * centroids)).toArrow()
    if not len(sample):
        return spark.createDataFrame([], out)
    x = unit(_matrix(sample["vector"]))
    half = max(1, x.shape[1] // 2)
    rest = x[:, half:] if x.shape[1] > half else np.zeros((len(x), 1))
    x = np.concatenate([x[:, :half], rest], axis=1)
    index = MultiIndex(kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids, seed=2))

    def padded(column: pa.Array) -> np.ndarray:
        u = unit(_matrix(column))
        return u if u.shape[1] > half else np.concatenate([u, np.zeros((len(u), 1))], axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(padded(b.column(1))), pa.int32())], [*b.schema.names, "cell"])

    indexed = materialise(classes.mapInArrow(assign, "cls long, vector array<double>, ids array<long>, asks boolean, cell int"), "vector-index")
    sizes = np.zeros(len(index.books[0]) * len(index.books[1]), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # one row a cell
        sizes[r[0]] = r[1]
    share = tuned_share(indexed, index, sizes, n, target, padded)
    bundles, most = Bundles(sizes, SLICE), share * sizes.sum()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            d1, d2 = index.distances(padded(b.column(1)))
            q, bundle, cells = [], [], []
            for i, cls in enumerate(b.column(0).to_pylist()):
                for k, c in bundles.of_query(index.visited(d1[i], d2[i], sizes, most)).items():
                    q.append(cls)
                    bundle.append(k)
                    cells.append(c)
                if len(q) >= 5000 or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(bundle, pa.int64()), pa.array(cells, pa.list_(pa.int32()))], ["q", "bundle", "cells"])
                    q, bundle, cells = [], [], []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own = bundles.of_classes(b.column(3).to_numpy(), b.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], [*b.schema.names, "bundle"])

    asking = indexed.where("asks").select("cls", "vector")
    visits = materialise(asking.mapInArrow(visit, "q long, bundle long, cells array<int>"), "vector-visits")
    demand = materialise(visits.groupBy("bundle").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "vector-demand")
    part = F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part")
    questions = visits.join(demand, "bundle").select("q", "bundle", part, "cells").join(asking.withColumnRenamed("cls", "q"), "q")
    stored = indexed.select("cls", "vector", "ids", "cell").mapInArrow(place, "cls long, vector array<double>, ids array<long>, cell int, bundle long")
    stored = stored.join(demand, "bundle").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def rank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            xs, cls, cell, ids = _matrix(right["vector"]), right["cls"].to_numpy(), right["cell"].to_numpy(), right["ids"].to_pylist()
            look = np.zeros(len(sizes), bool)
            for lo in range(0, len(left), 256):
                some = left.slice(lo, 256)
                for q, cells, s in zip(some["q"].to_pylist(), some["cells"].to_pylist(), _cosine(_matrix(some["vector"]), xs), strict=True):
                    look[cells] = True
                    mine = np.flatnonzero(look[cell])
                    look[cells] = False
                    best = [(-float(s[mine[i]]), v, q) for i in _top(s[mine], cls[mine], keep) for v in ids[mine[i]]]
                    rows += [(q, v, -m) for m, v, q in sorted(best)[:keep]]
        q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    met = questions.groupBy("bundle", "part").cogroup(stored.groupBy("bundle", "part"))
    found = met.applyInArrow(rank, "q long, vec_id long, score double")
    # the best of a query class, then those of each of its queries without itself
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id", "score")))
    best = found.groupBy("q").agg(F.slice(order, 1, keep).alias("best"))
    best = materialise(best, "vector-best")  # written, so that the join can split a vector of very many queries
    rows = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    queries = rows.where(F.col("query_id") % every == 0).join(indexed.where("asks").select("cls", "vector"), "vector").select("query_id", F.col("cls").alias("q"))
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, n)
    ranked = queries.join(best, "q").select("query_id", F.posexplode(others).alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def tuned_share(indexed: DataFrame, index: MultiIndex, sizes: np.ndarray, n: int, target: float, padded) -> float:
    """The least share of classes to visit that finds `target` of the neighbours of PROBES query classes, measured
    against all classes."""
    probes = indexed.where("asks").select("cls", "vector").orderBy(F.xxhash64("cls", F.lit(7)), "cls").limit(PROBES).toArrow()
    if not len(probes):
        return 1.0
    q, own = _matrix(probes["vector"]), probes["cls"].to_numpy()
    d1, d2 = index.distances(padded(probes["vector"]))
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[float, int]]] = [[] for _ in own]
        for b in batches:
            if len(b):
                cls, cell = b.column(0).to_numpy(), b.column(2).to_numpy()
                for i, s in enumerate(_cosine(q, _matrix(b.column(1)))):
                    s = np.where(cls == own[i], -2.0, s)
                    top = np.argpartition(-s, min(n, len(s) - 1))[:n]
                    kept[i] = sorted(kept[i] + [(float(s[j]), int(cell[j])) for j in top if s[j] > -2], reverse=True)[:n]
        rows = [(i, s, c) for i, k in enumerate(kept) for s, c in k]
        if rows:
            i, s, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(s, pa.float64()), pa.array(c, pa.int32())], ["i", "s", "c"])

    found = indexed.select("cls", "vector", "cell").mapInArrow(best, "i int, s double, c int")
    top = found.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "c")), asc=False), 1, n).alias("top")).collect()
    needed = []
    for r in top:  # how many classes are visited before the cell of each neighbour is through
        want, held = [x["c"] for x in r["top"]], 0
        for cell in index.walk(d1[r["i"]], d2[r["i"]]):
            needed += [held] * want.count(cell)
            want = [c for c in want if c != cell]
            held += int(sizes[cell])
            if not want:
                break
    if not needed:
        return 1.0
    needed.sort()
    return min(1.0, (needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] + 1) / max(1, sizes.sum()))
