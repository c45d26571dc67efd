"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network (operator 9).

1. Word vectors.  Tokens (runs of letters and digits, runs of other characters, lower case) fall into BUCKETS by hash.
   Each token has a random index vector of NONZERO entries +1 or -1 of DIM; a bucket's vector is the sum of the index
   vectors of its tokens' neighbours, up to REACH places away, over all documents.  Tasks sum in one integer matrix
   and Spark adds these up, so the result doesn't depend on how the rows are dealt.
2. Pooling.  Mean, deviation and mean absolute step between neighbours of a document's word vectors, and its length.
3. Network.  One hidden tanh layer and a sigmoid, trained by Adam in numpy on at most SAMPLE labelled rows of the training
   folds and SAMPLE_BYTES of their texts (those of least hash); a fifth of them sets the temperature of the probabilities.

Edge cases: null and empty texts pool to zeros and get a score like any other; without labels of both kinds all
scores are the share of label 1 (0.5 without labels); contradicting labels of one identifier count as the greater;
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKEN_CLASS, Runs, bounded_batches, bounded_sample, held_out, map_rows

BUCKETS, DIM, NONZERO, REACH = 8192, 32, 2, 2
FEATURES = 3 * DIM + 1
SAMPLE, SAMPLE_BYTES = 20_000, 256_000_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 25, 128, 0.004, 1e-4


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and hash of each token, and the first token of each text (one entry more than texts)."""
    runs = Runs(column, TOKEN_CLASS, lower=True)
    return (runs.hash >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), runs.hash, runs.of


def word_vector_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, v0 .. v(DIM-1): summed index vectors of neighbours, over all texts."""
    schema = pa.schema([("bucket", pa.int32()), *((f"v{i}", pa.int64()) for i in range(DIM))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(BUCKETS * DIM), False
        for batch in batches:
            any_rows = True
            bucket, h, of = _tokens(batch.column(0))
            text = np.repeat(np.arange(len(of) - 1), np.diff(of)).astype(np.int32)
            for at in range(0, len(bucket), 200_000):
                b, x, t = (c[max(0, at - REACH) : at + 200_000] for c in (bucket, h, text))
                new = at - max(0, at - REACH)
                for step in range(1, REACH + 1):
                    pair = np.flatnonzero(t[step:] == t[:-step])
                    pair = pair[pair + step >= new]
                    for i, j in ((pair, pair + step), (pair + step, pair)):
                        row, other = b[i].astype(np.int64) * DIM, x[j]
                        for n in range(NONZERO):
                            bits = (other >> np.uint64(6 * n)).astype(np.int64)
                            place, sign = bits & (DIM - 1), 1.0 - 2.0 * (bits >> 5 & 1)
                            total += np.bincount(row + place, sign, BUCKETS * DIM)
        if any_rows:
            rows = np.rint(total).astype(np.int64).reshape(BUCKETS, DIM)
            used = np.flatnonzero(rows.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.ascontiguousarray(rows[used, i])) for i in range(DIM))], schema=schema)

    bounded_batches(docs.sparkSession)
    made = docs.select(F.col(text_col).alias("text")).mapInArrow(sums, "bucket int, " + ", ".join(f"v{i} long" for i in range(DIM)))
    return made.groupBy("bucket").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM, of fixed size: rows of length 1 after the mean direction is taken away."""
    found = word_vector_sums(docs, text_col).toArrow()
    vectors = np.zeros((BUCKETS, DIM))
    if len(found):
        vectors[found["bucket"].to_numpy()] = np.column_stack([found[f"v{i}"].to_numpy() for i in range(DIM)])
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)
    used = size[:, 0] > 0
    if used.any():
        vectors[used] -= vectors[used].mean(axis=0)
    return vectors.astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    bucket, _, of = _tokens(column)
    out = np.zeros((len(of) - 1, FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
        if a == b:
            continue
        n, mean, square, step = b - a, np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
        for at in range(a, b, 4096):
            v = vectors[bucket[at : min(b, at + 4097)]]  # one more, for the step into the next block
            own = v[:4096]
            mean += own.sum(axis=0)
            square += np.einsum("ij,ij->j", own, own)
            if len(v) > 1:
                step += np.abs(v[1:] - v[:-1]).sum(axis=0)
        mean /= n
        out[i, :DIM], out[i, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(square / n - mean * mean, 0))
        out[i, 2 * DIM : 3 * DIM], out[i, -1] = step / max(1, n - 1), np.log1p(n)
    return out


class Network:
    """FEATURES -> HIDDEN tanh -> sigmoid((.) / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.trained = 0 < y.sum() < len(y)
        if not self.trained:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        last = rng.permutation(len(x)) if len(x) >= 50 else np.arange(len(x))
        held, fit = last[: len(x) // 5], last[len(x) // 5 :]
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(fit)
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                xs, h = x[some], np.tanh(x[some] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[some]) / len(some)
                dh = np.outer(d, self.p[2]) * (1 - h * h)
                grads = [xs.T @ dh + DECAY * self.p[0], dh.sum(axis=0), h.T @ d + DECAY * self.p[2], d.sum(keepdims=True)]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for p, g, a, b in zip(self.p, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            z, t = self._logits(x[held]), np.exp(np.linspace(-1.5, 2.0, 71))
            loss = [np.logaddexp(0, np.where(y[held] > 0, -z, z) / k).mean() for k in t]
            self.temperature = float(t[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, label, text of at most `most` labelled rows of the training folds and `most_bytes` of their texts.

    The identifiers of least hash are chosen first; then their rows are bounded, as an identifier may stand on many."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id")
    return bounded_sample(rows, most, most_bytes).select("doc_id", "label", "text")


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all documents, network from the sample."""
    vectors = word_vectors(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("x", pa.binary())])

    def per_task():
        def each(batch):
            for d, y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pooled(batch.column(2), vectors), strict=True):
                yield d, y, x.tobytes()

        return each

    rows = map_rows(training_sample(docs, labels, label, most), "doc_id long, label double, x binary", schema, per_task).toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, FEATURES).astype(np.float64)
    y = rows["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[:2], rows["doc_id"].to_numpy())) if len(y) else np.zeros(0, int)
    return vectors, Network(x[order], y[order])


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold)."""
    vectors, network = train_quality(docs, labels, label)

    def per_task():
        def each(batch):
            yield from zip(batch.column(0).to_pylist(), network.scores(pooled(batch.column(1), vectors)).tolist(), strict=True)

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = map_rows(rows, "doc_id long, score double", _SCORED, per_task)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The documents with a score of at least the threshold, all columns as they are."""
    import pandas as pd

    vectors, network = train_quality(docs, labels, label)

    def score(texts):
        return pd.Series(network.scores(pooled(pa.array(texts, pa.string(), from_pandas=True), vectors)))

    score.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    score = F.pandas_udf(score, "double")
    bounded_batches(docs.sparkSession)
    return docs.where(score(F.col("text").cast("string")) >= threshold)
