"""What substring dedup writes and shuffles, and rows whose texts are equal."""

import random
import subprocess

import pytest

from loomgraph.llm import substring_dedup


def letters(r, n):
    return [f"{r.getrandbits(24):06x}" for _ in range(n)]


def bytes_moved(spark) -> int:
    """Shuffled so far, and in the tables of the shared folder."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(True)
    shuffled = sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return shuffled + int(subprocess.run(["du", "-sb", shared], capture_output=True, check=True).stdout.split()[0])


def test_words_of_repeats_travel_once(spark):
    r = random.Random(8)
    families = [letters(r, 600) for _ in range(40)]
    texts = [" ".join(f[:at] + letters(r, 1) + f[at:]) for f in families for at in (100, 200, 300, 400, 500, 590, 50, 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = bytes_moved(spark)
    got = substring_dedup.remove_repeats(docs, 35)
    assert got.where("n_removed < 500").count() == 0
    assert bytes_moved(spark) - before < 3.5 * sum(map(len, texts))  # 4.1 times when passages carried their words


@pytest.mark.parametrize("crowd", [300, 0])
def test_rows_of_equal_text(spark, monkeypatch, crowd):
    """Equal texts are worked on once; each of their rows has its result, whatever its identifier."""
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    r = random.Random(9)
    shared, twin, alone = letters(r, 40), letters(r, 90), letters(r, 90)
    part = letters(r, 30) + shared + letters(r, 30)
    other = letters(r, 50) + shared
    rows = [(1, twin), (1, twin), (2, twin), (None, twin), (None, part), (3, part[:30] + part[70:]), (4, other), (5, alone), (None, []), (6, [])]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows] + [(None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, 35).collect())
    assert got == sorted([(0, 0, 0), (0, 0, 0), (0, 90, 90), (0, 100, 40), (1, 90, 90), (1, 90, 90), (2, 90, 90), (3, 60, 0), (4, 90, 40), (5, 90, 0), (6, 0, 0)])
    kept = {r.kept for r in substring_dedup.remove_repeats(docs, 35, texts=True).collect()}
    assert kept == {"", " ".join(part[:30] + part[70:]), " ".join(other[:50]), " ".join(alone)}
