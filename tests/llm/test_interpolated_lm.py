"""Operator 11 against a plain model of the same kind that keeps all counts in dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomgraph.llm.interpolated_lm import BEGIN, _pack, _unpack, expectation_maximisation, language_model_scores, mixture
from loomgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(ASCII)), None]


def fold_of(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7


def plain(rows, order):
    """Rows (doc_id, n_tokens, n_known, base, score) of the same model; weights by the same cells."""
    def grams(part):
        c = [Counter() for _ in range(order + 1)]
        for d, t in part:
            w = tokens_of(t)
            padded = [BEGIN] * (order - 1) + w
            c[0][()] += 1
            for i in range(len(w)):
                for k in range(1, order + 1):
                    c[k][tuple(padded[i + order - k : i + order])] += 1
        return c

    def estimates(t, c, less):
        w = tokens_of(t)
        padded = [BEGIN] * (order - 1) + w
        count = lambda g: c[len(g)][g] - (less[len(g)][g] if less else 0)
        n = sum(c[1].values()) - (sum(less[1].values()) if less else 0)
        docs = c[0][()] - (less[0][()] if less else 0)
        for i in range(len(w)):
            own = count((w[i],))
            p, level = [(own + 1) / (n + len(c[1]) + 1), own / max(1, n)], 0
            for k in range(2, order + 1):
                context = docs if i == 0 else count(tuple(padded[i + order - k : i + order - 1]))
                p.append(count(tuple(padded[i + order - k : i + order])) / max(1, context))
                level += min(31, context.bit_length()) * 32 ** (k - 2)
            yield p, level, own

    training = [r for r in rows if fold_of(r[0]) != 2]
    c, less = grams(training), grams([r for r in training if fold_of(r[0]) == 5])
    cells: dict = {}
    for d, t in training:
        if fold_of(d) == 5:
            for p, level, _ in estimates(t, c, less):
                cell = tuple(min(63, 1 + math.floor(-2 * math.log2(x))) if x > 0 else 0 for x in p[1:])
                cells.setdefault(level, {}).setdefault(cell, []).append(p)
    learned = {}
    for level, by in cells.items():
        n = np.array([len(x) for x in by.values()], float)
        learned[level] = int(n.sum()), expectation_maximisation(np.array([np.mean(x, 0) for x in by.values()]), n)
    total = sum(c[1].values())
    weights = mixture(order, total, learned)
    out = []
    for d, t in rows:
        all_ = list(estimates(t, c, None))
        base = sum(math.log10(p[0]) for p, _, _ in all_)
        out.append((d, fold_of(d) == 2, len(all_), sum(own > 0 for *_, own in all_), total, base, sum(math.log10(weights[level] @ p) for p, level, _ in all_)))
    return out


def same(got, want):
    key = lambda r: (repr(r[:5]), r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def crafted(seed, n):
    rnd = random.Random(seed)
    texts = [None, "", " \n\t", "A a", "É é"]
    for _ in range(n):
        texts.append(rnd.choice([" ", "\n"]).join(f"W{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.randrange(60))))
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("order,piece,bucket", [(2, 16_000_000, 16_000_000), (2, 700, 900), (3, 1500, 900)])
def test_against_dictionaries(spark, order, piece, bucket):
    rows = crafted(order, 160)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, n_tokens int")
    same(language_model_scores(docs, order=order, piece_bytes=piece, bucket_bytes=bucket).collect(), plain(rows, order))


def test_repeated_rows_and_long_texts(spark):
    rows = [(7, "a b c"), (7, "a b c"), (8, "b " * 60_000)] * 3 + [(i, f"a b w{i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(language_model_scores(docs, piece_bytes=4000).collect(), plain(rows, 2))


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert language_model_scores(docs).count() == 0
    held = next(i for i in range(100) if fold_of(i) == 2)
    got = language_model_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_the_mixture_is_a_distribution():
    w = mixture(2, 100, {3: (10, [0.2, 0.3, 0.5])})
    assert np.allclose(w.sum(1), 1) and w[0, 2] == 0 and np.allclose(w[3], [0.2, 0.3, 0.5])


def test_packed_numbers():
    for x in ([], [0], [1, 255, 256], [2**63 - 1, 5]):
        assert _unpack(_pack(np.array(x, np.uint64))).tolist() == x


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = list(zip(docs["doc_id"], docs["text"], strict=True))
    got = QUERIES["op11_interpolated_lm"](spark, SF).collect()
    same(got, plain(rows, 2))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
