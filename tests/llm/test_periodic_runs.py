"""Operator 12 against a plain search of all periods, on crafted texts and on the whole query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomgraph.llm.periodic_runs import lag_scan, numbered, periodic_runs, run_digests, split_by_frequency, with_repeats
from loomgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(w: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)  # a multiple of a smaller period spans the same stretch
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def expected(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id if doc_id is not None else "").encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def crafted(seed: int, n: int) -> list[str | None]:
    rnd = random.Random(seed)
    out: list[str | None] = [None, "", " \n\t ", "a", "a " * 23, "a " * 24, "x " + "a b " * 12 + "y"]
    for _ in range(n):
        parts: list[str] = []
        for _ in range(rnd.randint(0, 5)):
            unit = [f"é{rnd.randrange(rnd.choice([1, 2, 3, 10, 1000]))}" for _ in range(rnd.randint(1, 30))]
            parts += (unit * rnd.randint(1, 12))[rnd.randint(0, 3) :] if rnd.random() < 0.6 else unit
        out.append(rnd.choice([" ", "\n\t "]).join(parts))
    return out


def test_scan_against_all_periods():
    texts = crafted(7, 600)
    found, word = numbered(pa.array(texts))
    got: list[list] = [[] for _ in texts]
    for first, end in split_by_frequency(word, found.of, 24, 3):
        doc = next(d for d in range(len(texts)) if found.of[d] <= first < found.of[d + 1])
        got[doc] += [(s + first - int(found.of[doc]), length, q) for s, length, q in lag_scan(word[first:end], 24, 3)]
    assert [sorted(g) for g in got] == [plain((t or "").split()) for t in texts]


def test_long_texts_are_cheap():
    import numpy as np

    assert lag_scan(np.zeros(50_000, np.int64), 24, 3) == [(0, 50_000, 1)]
    assert lag_scan(np.tile(np.arange(10_000), 5), 24, 3) == [(0, 50_000, 10_000)]


@pytest.mark.parametrize("least,times", [(24, 3), (10, 4), (6, 3)])
def test_other_bounds(spark, least, times):
    rows = [(i, t) for i, t in enumerate(crafted(least, 60))]
    got = {r.doc_id: [(x.start, x.length, x.period) for x in r.runs] for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), least, times).collect()}
    assert got == {i: plain((t or "").split(), least, times) for i, t in rows}


def test_odd_tables(spark):
    rows = [(i % 50 if i % 11 else None, t, "x", 1) for i, t in enumerate(crafted(3, 150))]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, runs string, period int")
    got = sorted(map(repr, map(tuple, run_digests(periodic_runs(with_repeats(docs))).collect())))
    assert got == sorted(repr(expected(d, t)) for d, t, _, _ in rows * 2)
    empty = run_digests(periodic_runs(with_repeats(docs.limit(0))))
    assert empty.count() == 0 and len(empty.columns) == 8


def test_query_on_whole_texts(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    got = sorted(map(tuple, QUERIES["op12_periodic_runs"](spark, SF).collect()))
    assert got == sorted(expected(d, t) for d, t in zip(docs["doc_id"], docs["text"], strict=True))
    assert sum(r[1] for r in got) > 5
