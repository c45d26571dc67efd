"""Periodic runs of words by recursive frequency splitting (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least
max(least, times * q) words that no neighbouring word extends.  Each of its words stands in it `times` times or more.  So
a word that occurs more rarely in the current segment (at first the whole text) is in no run and splits the segment;
pieces are judged again, by their own counts, until nothing changes, and pieces of fewer than `least` words go.  What is
left is scanned lag by lag: a run of period q holds `times - 1` whole blocks of q words that start at multiples of q, so
lag q compares only neighbouring blocks (first words, then sums over the blocks), and where two agree the stretch is
followed to both ends on the words themselves.  A segment of m words costs m log m, whatever its periods.

Words are compared by exact numbers (a dictionary of their bytes), never by hashes; sums over blocks only propose.  Each
row is judged alone: there is no shuffle, and a task holds one batch of texts at a time.

Edge cases: null, empty and blank texts have no words and no runs, their collapsed text is empty; repeated rows are
judged each; a null identifier stays null; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Runs, bounded_batches, mix64, take_runs

#: Pairs of lag and block that are compared at once.
PAIRS = 1_000_000

_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered(column: pa.Array) -> tuple[Runs, np.ndarray]:
    """The words of a column of texts, and a number for each that two words share when their bytes are the same."""
    found = Runs(column)
    size = found.end - found.start
    ends = np.cumsum(size)
    place = np.repeat(found.start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(found.raw.take(place))])
    return found, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def split_by_frequency(word: np.ndarray, of: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Segments (first, end) of the words of several texts in which every word occurs `times` times or more, each at
    least `least` words long; of: where each text starts, one entry more than texts."""
    stable: list[tuple[int, int]] = []
    first, end = of[:-1], of[1:]
    while True:
        long = end - first >= least
        first, end = first[long], end[long]
        if not len(first):
            return sorted(stable)
        size = end - first
        segment = np.repeat(np.arange(len(first)), size)
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        _, back, count = np.unique(segment * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        often = count[back] >= times
        whole = np.logical_and.reduceat(often, np.cumsum(size) - size)
        stable += zip(first[whole].tolist(), end[whole].tolist(), strict=True)
        keep = often & ~whole[segment]
        at, segment = at[keep], segment[keep]
        cut = np.ones(len(at), bool)
        cut[1:] = (np.diff(at) != 1) | (np.diff(segment) != 0)
        begun = np.flatnonzero(cut)
        first, end = at[begun], at[np.append(begun[1:], len(at)) - 1] + 1 if len(at) else at


def _proposals(w: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(lag, first, end): stretches of whole blocks, by lag and place, whose neighbours seem to agree; only those of as
    many blocks as a run of that lag holds."""
    m = len(w)
    mixed = mix64(w.astype(np.uint64) + np.uint64(1))
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(m, 0x9FB21C651E98DF25, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[:m], dtype=np.uint64)])
    lags = np.arange(1, m // times + 1)
    blocks = m // lags - 1
    upto = np.cumsum(blocks)
    done = 0
    while done < len(lags):
        to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, "right")))
        q, n = lags[done:to], blocks[done:to]
        done = to
        lag = np.repeat(q, n)
        a = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * lag
        hit = np.flatnonzero(w[a] == w[a + lag])
        a, lag = a[hit], lag[hit]
        hit = np.flatnonzero((total[a + lag] - total[a]) * power[lag] == total[a + 2 * lag] - total[a + lag])
        if not len(hit):
            continue
        a, lag = a[hit], lag[hit]
        cut = np.ones(len(a), bool)
        cut[1:] = (np.diff(lag) != 0) | (np.diff(a) != lag[1:])
        begun = np.flatnonzero(cut)
        last = np.append(begun[1:], len(a)) - 1
        q = lag[begun]
        enough = last - begun + 2 >= np.maximum(times - 1, (least - q + 1) // q)
        begun, last = begun[enough], last[enough]
        yield from zip(lag[begun].tolist(), a[begun].tolist(), (a[last] + 2 * lag[last]).tolist(), strict=True)


def _agreeing(same: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def lag_scan(w: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """Every run (start, length, period) of a segment, by start and period.

    Lags rise, so a stretch that was found before has its smallest period already.  Blocks inside a run whose period
    divides the lag lead to that run again and are passed over, up to the block behind which it ends.
    """
    m = len(w)
    found: dict[tuple[int, int], int] = {}
    runs: list[tuple[int, int, int]] = []
    cover = np.full(m, -1)
    for q, a, b in _proposals(w, least, times):
        while a + 2 * q <= b and cover[a] >= 0:
            lo, hi, p = runs[cover[a]]
            if q % p or a + 2 * q > hi:
                break
            a += ((hi - a) // q - 1) * q
        if a + 2 * q > b:
            continue
        # the blocks before and behind don't agree as a whole, so the ends are less than q words away
        x, y = max(0, a - q), min(m, b + q)
        for s, e in _agreeing(w[x : y - q] == w[x + q : y]):
            lo, hi = x + s, x + e + q
            if hi - lo >= max(least, times * q) and (lo, hi) not in found:
                found[lo, hi] = q
                cover[lo:hi] = len(runs)
                runs.append((lo, hi, q))
    return sorted((lo, hi - lo, q) for lo, hi, q in runs)


def _joined(found: Runs, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    doc = np.repeat(np.arange(len(found.of) - 1), np.diff(found.of))[kept]
    start, size = found.start[kept], (found.end - found.start)[kept]
    gap = np.zeros(len(size), np.int64)
    gap[1:] = doc[1:] == doc[:-1]
    ends = np.cumsum(size + gap)
    step, run = np.arange(size.sum()), np.cumsum(size) - size
    out = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint8)
    out[np.repeat(ends - size - run, size) + step] = found.raw.take(np.repeat(start - run, size) + step)
    offsets = np.concatenate([[0], ends])[np.searchsorted(doc, np.arange(len(found.of)))].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(found.of) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed: the words without those
    that a run holds behind its first period, joined by one space.  times: 3 or more."""
    if times < 3 or least < 1:
        raise ValueError("times must be 3 or more, least 1 or more")
    bounded_batches(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in take_runs(batch.column(1)):
                found, word = numbered(some)
                runs: list[list[dict]] = [[] for _ in some]
                kept = np.ones(len(word), bool)
                for first, end in split_by_frequency(word, found.of, least, times):
                    doc = int(np.searchsorted(found.of, first, "right")) - 1
                    for start, length, period in lag_scan(word[first:end], least, times):
                        kept[first + start + period : first + start + length] = False
                        runs[doc].append({"start": first + start - int(found.of[doc]), "length": length, "period": period})
                columns = [batch.column(0).slice(at, len(some)), pa.array(np.diff(found.of), pa.int64()), pa.array(runs, _FOUND), _joined(found, np.flatnonzero(kept)).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(some)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame, one_in: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: of the documents whose crc32(doc_id as text; null: empty) is divisible by one_in, the words from
    some place a on repeat the p words that stand there, both drawn from the crc32; all others are unchanged."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = rows.withColumn("w", F.when((F.col("h") % one_in == 0) & F.col("text").isNotNull(), words)).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / one_in)
    rows = rows.withColumn("g", g).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    a, rest = F.col("a").cast("int"), (F.col("n") - F.col("a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(again, F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def _strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the first."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, and digests of all runs and of the
    collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = F.col("top")
    return found.withColumn("top", _strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
