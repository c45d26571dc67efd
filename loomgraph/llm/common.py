"""Helpers that several training-data operators share."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import bucketed, materialise, shared_dir  # noqa: F401  the operators take them from here

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = re.compile("[^\x20\x09-\x0d]+")

#: Rows an Arrow batch may hold: documents can have 100,000 characters each.
BATCH_ROWS = 1000


def words(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def bounded_batches(spark: SparkSession) -> None:
    """Long texts must not meet in one huge Arrow batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; null identifiers count as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def held_out(doc_id: Column) -> Column:
    return fold_of(doc_id) == 0


def bounded_sample(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """At most `most` different rows (doc_id, text and others) and `most_bytes` of their texts: those of least hash, but
    no text of more than a quarter of the bytes.  Only hashes and lengths meet in one task; copies of a row count once."""
    named = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    least = named.where(size <= most_bytes // 4).groupBy("h").agg(F.max(size).cast("long").alias("bytes")).orderBy("h").limit(most)
    upto = least.withColumn("upto", F.sum("bytes").over(Window.orderBy("h"))).where(F.col("upto") <= most_bytes)
    return named.join(F.broadcast(materialise(upto.select("h"), "sample")), "h").dropDuplicates(["h"]).drop("h")


#: Bytes of a run from which on a digest takes the place of the weighted sum.
LONG_RUN = 1 << 14


#: Classes of bytes: white space, letters and digits (all of UTF-8's longer sequences count so), the rest.
SPACE, LETTER, OTHER = 0, 1, 2
WORD_CLASS = np.full(256, LETTER, np.uint8)
WORD_CLASS[[0x20, *range(9, 14)]] = SPACE
TOKEN_CLASS = np.full(256, OTHER, np.uint8)
TOKEN_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
TOKEN_CLASS[[0x20, *range(9, 14)]] = SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, for arrays of np.uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd weight for each place of a run.
WEIGHT = np.random.default_rng(20240229).integers(0, 2**63, LONG_RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and where each text starts (one entry more than texts)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Runs:
    """Maximal runs of bytes of one class within each text of a column, white space left out; all as arrays.

    start, end: byte positions; hash: np.uint64 of each run's bytes; of: first run of each text (one entry more
    than texts); kind: class of each run.  Works in blocks of about BLOCK bytes, which stay in the CPU's cache.

    The hash is the sum of the bytes, each times a random weight of its own place, modulo 2^64: two different runs,
    whatever they are, agree with probability 2^-56 at most over the choice of the weights (no power of one base
    stands behind it, so there are no pairs that collide for every choice).  Runs of LONG_RUN bytes or more have a
    blake2b digest instead.
    """

    BLOCK = 1 << 16

    def __init__(self, column: pa.Array, classes: np.ndarray = WORD_CLASS, lower: bool = False):
        raw, self.texts = utf8(column)
        self.raw = raw = LOWER[raw] if lower else raw
        texts = self.texts
        parts, at = [], 0
        while at < len(texts) - 1:
            to = max(at + 1, int(np.searchsorted(texts, texts[at] + self.BLOCK, "right")) - 1)
            parts.append(self._block(raw[texts[at] : texts[to]], texts[at:to] - texts[at], classes, int(texts[at])))
            at = to
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        self.start, self.end, self.kind, self.hash = (np.concatenate(x) for x in zip(*(parts or [empty]), strict=True))
        self.of = np.searchsorted(self.start, texts)

    @staticmethod
    def _block(raw: np.ndarray, starts: np.ndarray, classes: np.ndarray, shift: int):
        kinds = classes.take(raw)
        cut = np.empty(len(raw), bool)
        if len(raw):
            cut[0] = True
            np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
            cut[starts[starts < len(raw)]] = True
        first = np.flatnonzero(cut)
        if not len(first):
            return first + shift, first + shift, kinds[:0], np.zeros(0, np.uint64)
        size = np.diff(first, append=len(raw))
        place = np.arange(len(raw)) - np.repeat(first, size)
        long = size >= LONG_RUN
        if long.any():
            place = np.minimum(place, LONG_RUN - 1)
        h = np.add.reduceat(WEIGHT.take(place) * (raw.astype(np.uint64) + np.uint64(1)), first)
        for i in np.flatnonzero(long).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : first[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
        real = kinds[first] != SPACE
        first, size = first[real], size[real]
        return first + shift, first + size + shift, kinds[first], mix64(h[real])

    def __iter__(self):
        """(first run, last run + 1) of each text."""
        return zip(self.of[:-1].tolist(), self.of[1:].tolist(), strict=True)


def take_runs(column: pa.Array, size: int = 2_000_000) -> Iterator[pa.Array]:
    """Slices of a column of texts, about `size` bytes each."""
    at, ends = 0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0), np.int64))
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield column.slice(at, to - at)
        at = to


def same_bytes(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of two byte arrays are equal; size: of each, at least 1."""
    if not len(size):
        return np.zeros(0, bool)
    ends = np.cumsum(size)
    first = ends - size
    step = np.arange(ends[-1])
    differ = x.take(np.repeat(x_start - first, size) + step) != y.take(np.repeat(y_start - first, size) + step)
    return ~np.logical_or.reduceat(differ, first) if differ.any() else np.ones(len(size), bool)


class IdTable:
    """Ids of words, found by their hash in sorted arrays and confirmed on their bytes: about 30 bytes a word.  Emptied
    when it holds `most` of them."""

    def __init__(self, most: int = 1_500_000):
        self.most = most
        self._empty()

    def _empty(self) -> None:
        # sorted hashes and the entry of each; entries in the order of their coming: where ids and bytes start, how many
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0
        self.rows = np.zeros((4, 1 << 12), np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(0, len(self.keys) - 1))
        return at, (self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def _add(self, at: np.ndarray, keys: np.ndarray, flat: np.ndarray, size: np.ndarray, words: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.filled + len(words) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        n = len(self.keys)
        while n + len(keys) > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
        self.pool[self.used : self.used + len(flat)] = flat
        self.bytes[self.filled : self.filled + len(words)] = words
        self.rows[:, n : n + len(keys)] = self.used + np.cumsum(size) - size, size, self.filled + np.cumsum(length) - length, length
        self.used, self.filled = self.used + len(flat), self.filled + len(words)
        place = at + np.arange(len(at))  # as np.insert does, but once for both
        old = np.ones(n + len(keys), bool)
        old[place] = False
        merged, entry = np.empty(n + len(keys), np.uint64), np.empty(n + len(keys), np.int32)
        merged[old], merged[place] = self.keys, keys
        entry[old], entry[place] = self.entry, np.arange(n, n + len(keys))
        self.keys, self.entry = merged, entry

    def ids(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (bytes raw[start:end] with their hashes) in order, flat, and how many each word has.

        make(i) gives the same for new words, i being places in `hashes`.  A word whose bytes are not those that its
        hash stands for goes to make() by itself.
        """
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, hit = self._find(keys)
        if not hit.all():
            if len(self.keys) + len(keys) > self.most:
                self._empty()
                at, hit = self._find(keys)
            new = first[~hit]
            flat, size = make(new)
            length = end[new] - start[new]
            begun = np.cumsum(length) - length
            words = raw.take(np.repeat(start[new] - begun, length) + np.arange(length.sum()))
            self._add(at[~hit], keys[~hit], flat, size, words, length)
            at, hit = self._find(keys)
        length = end - start
        begin, size, word, stored = self.rows[:, self.entry[at]][:, back] if len(keys) else self.rows[:, :0]
        mine = stored == length
        if mine.all():
            mine = same_bytes(raw, start, self.bytes, word, length)
        else:
            mine[mine] = same_bytes(raw, start[mine], self.bytes, word[mine], length[mine])
        odd = np.flatnonzero(~mine)
        pool = self.pool
        if len(odd):
            flat, own = make(odd)
            begin[odd], size[odd] = len(pool) + np.cumsum(own) - own, own
            pool = np.concatenate([pool, flat])
        ends = np.cumsum(size)
        place = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return pool[place], size


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (np.uint64), in order."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(k):
            out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
            out ^= out >> np.uint64(29)
        out = mix64(out)
    return out


def batches_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, schema: str, arrow: pa.Schema, per_task: Callable[[], Callable], rows_out: int = 4000) -> DataFrame:
    """mapInArrow with a function that is set up once in each task.

    per_task() runs in the task and returns f(batch) -> iterable of tuples; they leave in batches of rows_out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = per_task()
        out: list[tuple] = []
        for batch in batches:
            for row in f(batch):
                out.append(row)
                if len(out) >= rows_out:
                    yield batches_of(out, arrow)
                    out = []
        if out:
            yield batches_of(out, arrow)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
