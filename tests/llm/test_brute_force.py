"""Operators that SQL can't express, against plain versions on small corpora."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import components, language_id, near_dup, neighbours, quality, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def corpus(seed=0):
    """Originals, exact copies, near copies in a chain, and passages that documents share."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, passage = [text(r.randrange(1, 300)) for _ in range(60)], text(60)
    for d in docs[:10]:
        docs.append(list(d))
    base = text(250)
    for _ in range(40):
        base = list(base)
        base[r.randrange(len(base))] = "changed" + str(r.random())[2:6]
        docs.append(base)
    for i in range(20):
        docs.append(text(40) + passage[: 30 + i * 2] + text(40))
    docs.append(["same"] * 100)
    return [(i * 3 + 1, " ".join(d)) for i, d in enumerate(docs)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    sets, up = {}, {}
    for d, t in corpus():
        w = WORD.findall(t.lower())
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs, k=k).collect()}
    assert got == {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


@pytest.mark.parametrize("crowd", [300, 1])
def test_substring_dedup(docs, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    texts = {d: WORD.findall(t) for d, t in corpus()}
    seen = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    want = {}
    for d, w in texts.items():
        gone = [any(seen[tuple(w[j : j + 35])] > 1 for j in range(max(0, i - 34), min(i, len(w) - 35) + 1)) for i in range(len(w))]
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, 35).collect()} == want


def test_suffix_automaton_statistics():
    r = random.Random(3)
    for _ in range(30):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 25))] for _ in range(4)]
        a = substring_dedup.SuffixAutomaton()
        for s in seqs:
            a.add([*s, -1])
        a.finish()
        count = Counter(tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        for s in seqs:
            want = [max((n for n in range(1, e + 1) if count[tuple(s[e - n : e])] > 1), default=0) for e in range(1, len(s) + 1)]
            assert a.statistics(s) == want


@pytest.mark.parametrize("per_task", [200_000, 50])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "LINKS_PER_TASK", per_task)
    r, up = random.Random(1), {}
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1080)] + [(9999, 9999)]
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    assert len(got) == len(up) and {x.node: x.component for x in got} == {n: root(n) for n in up}


def test_neighbours_recall(spark):
    x = np.random.default_rng(0).normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, n=5, every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d = x.astype(np.float64)
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -s.round(12)))[:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s[v] - w) < 1e-12 for _, v, w in mine)
        hits += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hits / 150 >= 0.9


def test_models_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels, "doc_id", "left_semi")
    q = quality.quality_scores(some, labels).join(labels, "doc_id").where("held_out")
    assert q.where("predicted = quality").count() >= 0.97 * q.count()
    t = toxicity.toxicity_scores(some, labels).join(labels, "doc_id").where("held_out")
    assert t.where("predicted = toxic").count() >= 0.95 * t.count() and t.where("toxic = 1 and predicted = 1").count() >= 0.75 * t.where("toxic = 1").count()
    p = language_id.predict_language(some).where("held_out").join(some.select("doc_id", "lang"), "doc_id")
    assert p.where("lang_pred = lang").count() >= 0.97 * p.count()


def test_offending_sentences(spark):
    bad = "fine words here. you total blockhead friend. more fine words."
    docs = spark.createDataFrame([(i, bad if i % 3 == 0 else "fine words here. you total friend. more fine words.") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = toxicity.train_toxicity(docs, labels)
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == set(range(0, 300, 3)) and {bad.encode()[r.start_byte : r.end_byte].decode() for r in found} == {"you total blockhead friend"}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = spark.createDataFrame(kept.collect(), docs.schema)
        if name == "secrets":
            assert docs.where("text like '%AKIA%' and length(regexp_extract(text, 'AKIA[A-Z0-9]{16}', 0)) > 0").count() == 0
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in r.text for r in docs.collect() for b in benchmark)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_crowded_regions_find_every_link(spark, monkeypatch):
    """A window of one class and one tree leave most links of a crowd to the comparison of regions."""
    monkeypatch.setattr(near_dup, "WINDOW", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(50):
        t = list(base)
        for _ in range(r.randrange(0, 16)):
            t[r.randrange(200)] = f"x{r.random()}"
        texts.append(t)
    sets = {i: {tuple(t[j : j + 2]) for j in range(199)} for i, t in enumerate(texts)}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_dup.near_duplicates(df, k=2).collect()} == {i: root(i) for i in sets}
