"""Toxicity by multiple-instance learning (operator 5).

A document is a bag of sentences.  A sentence's logit is a bias and the weights of its words: of each word as a whole
and of its first 4 to 7 bytes, which stand for a stem with any ending; all fall into BUCKETS by hash.  The document is toxic if one of its sentences is, by noisy-or: p = 1 - prod(1 - p_s).  Weights are
trained from document labels alone, by Adagrad on the documents' log loss, in numpy, on at most SAMPLE labelled
rows of the training folds and SAMPLE_BYTES of their texts (those of least hash).  Words that fewer than LEAST_DOCS of these have get no weight.
Afterwards the same sentence scores say where a document offends.

Sentences end at . ! ? and line ends; words are runs of letters and digits in lower case.

Edge cases: null and empty texts have no sentence and score 0; without labels of both kinds all scores are the share
of label 1 (0 without labels); repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, TOKEN_CLASS, WEIGHT, Runs, held_out, map_rows, mix64, take_runs
from .quality import training_sample

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SAMPLE, SAMPLE_BYTES = 8_000, 32_000_000
LEAST_DOCS = 4
BATCH, LEAST_EPOCHS, LEAST_STEPS, RATE, START, SHRINK = 64, 8, 600, 0.3, -6.0, 3e-4
CALM = 1e-2
PREFIXES = (4, 5, 6, 7)
PARTS = len(PREFIXES) + 1

_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True


class Bags:
    """The words of some texts: PARTS buckets and the sentence (numbered over all texts) of each; the text of each sentence."""

    def __init__(self, texts: pa.Array):
        runs = Runs(texts, TOKEN_CLASS, lower=True)
        word = runs.kind == LETTER
        self.start, self.end = runs.start[word], runs.end[word]
        self.texts, self.n = runs.texts, len(runs.texts) - 1
        text = np.searchsorted(runs.texts, self.start, "right") - 1
        ends = np.cumsum(_ENDS[runs.raw])[self.start] if len(self.start) else np.zeros(0, np.int64)
        new = np.append(True, (ends[1:] != ends[:-1]) | (text[1:] != text[:-1]))[: len(self.start)]
        self.sentence = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.sentence_text = text[self.first]
        self.parts = np.empty((len(self.start), PARTS), np.int32)
        self.parts[:, 0] = runs.hash[word] >> np.uint64(64 - BUCKET_BITS)
        raw, sums = np.append(runs.raw, np.zeros(PREFIXES[-1], np.uint8)), np.zeros(len(self.start), np.uint64)
        for i in range(PREFIXES[-1]):  # a shorter word's own bytes make its longer prefixes too
            inside = self.start + i < self.end
            sums += np.where(inside, WEIGHT[i] * (raw[self.start + i].astype(np.uint64) + np.uint64(1)), np.uint64(0))
            if i + 1 in PREFIXES:
                self.parts[:, 1 + PREFIXES.index(i + 1)] = mix64(sums + np.uint64(i)) >> np.uint64(64 - BUCKET_BITS)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, prior: float | None = None):
        self.w, self.bias, self.prior = weights.astype(np.float32), bias, prior

    def sentences(self, bags: Bags) -> np.ndarray:
        """The probability of each sentence."""
        z = np.bincount(bags.sentence, self.w.take(bags.parts).sum(axis=1), len(bags.first)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def documents(self, bags: Bags, p: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(bags.n, self.prior)
        return 1 - np.exp(np.bincount(bags.sentence_text, np.log1p(-np.minimum(p, 1 - 1e-12)), bags.n))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11) -> Model:
    """docs: sentence (n) and buckets (n x PARTS) of each document's words."""
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS), START, float(y.mean()) if len(y) else 0.0)
    df = np.zeros(BUCKETS, np.int32)
    for _, parts in docs:
        df[np.unique(parts)] += 1
    known = df >= LEAST_DOCS
    sentences = np.array([int(s[-1]) + 1 if len(s) else 0 for s, _ in docs])
    rng, w, bias = np.random.default_rng(seed), np.zeros(BUCKETS), START
    square, bias_square = np.full(BUCKETS, CALM), CALM
    size = min(BATCH, max(8, len(docs) // 8))
    for _ in range(max(LEAST_EPOCHS, -(-LEAST_STEPS * size // len(docs)))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), size):
            some = order[at : at + size]
            n = sentences[some]
            shift = np.cumsum(n) - n
            sentence = np.concatenate([docs[i][0] + a for i, a in zip(some, shift, strict=True)])
            parts = np.concatenate([docs[i][1] for i in some])
            of = np.repeat(np.arange(len(some)), n)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[parts].sum(axis=1), n.sum()) + bias, -30, 30)))
            p = np.clip(p, 1e-9, 1 - 1e-9)
            doc = np.clip(1 - np.exp(np.bincount(of, np.log1p(-p), len(some))), 1e-6, 1 - 1e-9)
            pull = np.where(y[some] > 0, -(1 - doc) / doc, 1.0)  # d loss / d z_s = pull * p_s
            dz = pull[of] * p / len(some)
            g = np.bincount(parts.ravel(), np.repeat(dz[sentence], PARTS), BUCKETS) * known
            touched = np.flatnonzero(g)
            square[touched] += g[touched] ** 2
            w[touched] -= RATE * g[touched] / np.sqrt(square[touched])
            w[touched] = np.sign(w[touched]) * np.maximum(np.abs(w[touched]) - SHRINK, 0)
            gb = float(dz.sum())
            bias_square += gb * gb
            bias -= 0.1 * RATE * gb / bias_square**0.5
    return Model(w, bias)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """The sample's words go to the driver as sentence and buckets, 24 bytes each, and no text: 24 bytes for two of
    SAMPLE_BYTES at most."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("words", pa.binary())])

    def per_task():
        def each(batch):
            bags = Bags(batch.column(2))
            cut = np.searchsorted(bags.start, bags.texts)
            for i, (d, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                s, parts = bags.sentence[cut[i] : cut[i + 1], None], bags.parts[cut[i] : cut[i + 1]]
                yield d, y, np.hstack([s - (s[0] if len(s) else 0), parts]).astype(np.int32).tobytes()

        return each

    rows = map_rows(training_sample(docs, labels, label, most, SAMPLE_BYTES), "doc_id long, label double, words binary", schema, per_task, 200).toArrow()
    y, ids = rows["label"].to_numpy().astype(np.float64), rows["doc_id"].to_numpy()
    bags = [np.frombuffer(x.as_py(), np.int32).reshape(-1, 1 + PARTS) for x in rows["words"]]
    order = sorted(range(len(bags)), key=lambda i: (ids[i], len(bags[i]), bags[i].tobytes()[:64]))
    return fit([(bags[i][:, 0], bags[i][:, 1:]) for i in order], y[order] if len(y) else y)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()), ("n_offending", pa.int64())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("score", pa.float64())])


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, n_offending (sentences of at least the threshold)."""
    model = model or train_toxicity(docs, labels, label)

    def per_task():
        def each(batch):
            ids = iter(batch.column(0).to_pylist())
            for some in take_runs(batch.column(1)):
                bags = Bags(some)
                p = model.sentences(bags)
                counts = np.bincount(bags.sentence_text, minlength=bags.n), np.bincount(bags.sentence_text, p >= threshold, bags.n).astype(np.int64)
                for row in zip(np.clip(model.documents(bags, p), 0, 1).tolist(), *(c.tolist() for c in counts), strict=True):
                    yield next(ids), *row

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_rows(rows, "doc_id long, score double, n_sentences long, n_offending long", _SCORED, per_task)
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "n_sentences", "n_offending")


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start_byte, end_byte (of a sentence's words in the UTF-8 text), score, for sentences of at least the threshold."""

    def per_task():
        def each(batch):
            bags = Bags(batch.column(1))
            p = model.sentences(bags)
            last = np.append(bags.first[1:], len(bags.start)) - 1
            ids = batch.column(0).to_pylist()
            for s in np.flatnonzero(p >= threshold).tolist():
                t = int(bags.sentence_text[s])
                yield ids[t], int(bags.start[bags.first[s]] - bags.texts[t]), int(bags.end[last[s]] - bags.texts[t]), float(p[s])

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, "doc_id long, start_byte long, end_byte long, score double", _SPANS, per_task)
