"""Language identification by a byte convolutional network (operator 10).

A text is cut into windows of WINDOW bytes.  Filters of widths 2, 3 and 4 (FILTERS of each) run over a window's bytes;
as the input is one-hot, a filter is a table of one weight a place and byte.  The greatest response of each filter in
a window, rectified, feeds a softmax over the languages.  A text's scores are its windows' log-probabilities, averaged
by the bytes they hold.

Training is in numpy: back-propagation through the place of each maximum, on all windows of at most SAMPLE rows of the
training folds and SAMPLE_BYTES of their texts.  Each language has an equal share of the rows (all of its rows, if these
are fewer): those of least hash.  Only hashes and lengths are gathered to choose them, and no text goes through one task.
Widths 2 to 4 are applied by tables of byte pairs, in batches of windows.

Edge cases: null texts and texts without a letter get `und` and score 0, and so do all texts when no document of the
training folds has a language; with one language it is predicted for all; ties go to the first language in order;
repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_rows, materialise, take_runs, utf8

WINDOW, STRIDE = 259, 256
WIDTHS, FILTERS = (2, 3, 4), 16
SAMPLE, SAMPLE_BYTES = 3000, 8_000_000
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.01, 1e-4
_LETTER = regex.compile(r"\p{L}")


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        self.languages = languages
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.25, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.out, self.out_bias = rng.normal(0, n**-0.5, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
        self.pairs: list | None = None

    def tabulate(self) -> None:
        """Tables of byte pairs for applying the network."""
        two = lambda t: (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS)
        t2, t3, t4 = self.tables
        self.pairs = [two(t2), two(t3[:2]), t3[2], two(t4[:2]), two(t4[2:])]

    def _responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width: windows x places x filters."""
        if self.pairs is None:
            return [sum(t[i][x[:, i : x.shape[1] - w + 1 + i]] for i in range(w)) for w, t in zip(WIDTHS, self.tables, strict=True)]
        p = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        t2, a3, b3, a4, b4 = self.pairs
        return [t2.take(p, axis=0), a3.take(p[:, :-1], axis=0) + b3.take(x[:, 2:], axis=0), a4.take(p[:, :-2], axis=0) + b4.take(p[:, 2:], axis=0)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([np.maximum(r.max(axis=1) + b, 0) for r, b in zip(self._responses(x), self.bias, strict=True)], axis=1)
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 4) -> None:
        """Adam on the windows' cross entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.out_bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                xs, n = x[some], len(some)
                responses = self._responses(xs)
                best = [r.argmax(axis=1) for r in responses]
                top = [np.take_along_axis(r, b[:, None, :], 1)[:, 0] + c for r, b, c in zip(responses, best, self.bias, strict=True)]
                pooled = np.concatenate([np.maximum(t, 0) for t in top], axis=1)
                z = pooled @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = z / z.sum(axis=1, keepdims=True)
                d[np.arange(n), y[some]] -= 1
                d /= n
                back = d @ self.out.T
                grads_t, grads_b = [], []
                for k, (w, b, t) in enumerate(zip(WIDTHS, best, top, strict=True)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS] * (t > 0)
                    table = np.zeros((w, 256, FILTERS), np.float32)
                    cols = np.broadcast_to(np.arange(FILTERS), b.shape)
                    for i in range(w):
                        np.add.at(table[i], (xs[np.arange(n)[:, None], b + i], cols), g)
                    grads_t.append(table)
                    grads_b.append(g.sum(axis=0))
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for p, g, a, s in zip(params, [*grads_t, *grads_b, pooled.T @ d + DECAY * self.out, d.sum(axis=0)], m, v, strict=True):
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (zeros behind the end), the text of each and the bytes it adds."""
    raw, starts = utf8(texts)
    size = np.diff(starts)
    n = np.maximum(1, -(-np.maximum(size - 3, 1) // STRIDE))
    of = np.repeat(np.arange(len(size)), n)
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = np.arange(WINDOW)[None, :] + (starts[:-1][of] + at)[:, None]
    inside = place < starts[1:][of][:, None]
    x = np.where(inside, np.append(raw, 0)[np.minimum(place, len(raw))], 0).astype(np.uint8)
    return x, of, np.minimum(size[of] - at, STRIDE).clip(1)


def train_language_id(docs: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network | None:
    """None when no document of the training folds has a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = materialise(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    languages = sorted(r[0] for r in sizes.select("lang").collect())
    if not languages:
        return None
    quota, size = max(1, most // len(languages)), F.octet_length("text")
    # about twice the quota of each language, then exactly: copies of a row count once
    some = known.join(sizes, "lang").where((F.pmod("h", F.lit(1 << 30)) < (1 << 30) * 2.0 * quota / F.col("n")) & (size <= most_bytes // 4))
    some = some.groupBy("lang", "h").agg(F.max(size).cast("long").alias("bytes"))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= quota)
    some = some.withColumn("upto", F.sum("bytes").over(Window.orderBy("rank", "lang"))).where(F.col("upto") <= most_bytes)
    chosen = known.join(F.broadcast(materialise(some.select("lang", "h"), "sample")), ["lang", "h"]).dropDuplicates(["lang", "h"])
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("windows", pa.binary())])

    def per_task():
        def each(batch):
            for d, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield d, lang, windows_of(pa.array([text]))[0].tobytes()

        return each

    chosen = chosen.select("doc_id", "lang", "text")
    rows = map_rows(chosen, "doc_id long, lang string, windows binary", schema, per_task, 500).toArrow().sort_by([("doc_id", "ascending"), ("windows", "ascending")])
    x = [np.frombuffer(w.as_py(), np.uint8).reshape(-1, WINDOW) for w in rows["windows"]]
    place = {lang: i for i, lang in enumerate(languages)}
    y = np.repeat([place[lang] for lang in rows["lang"].to_pylist()], [len(w) for w in x])
    network = Network(languages)
    network.fit(np.concatenate(x), y)
    network.tabulate()
    return network


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict_language(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its probability)."""
    network = network or train_language_id(docs)

    def per_task():
        def each(batch):
            ids = iter(batch.column(0).to_pylist())
            for some in take_runs(batch.column(1), 500_000):
                if network is not None:
                    x, of, size = windows_of(some)
                    logs = np.concatenate([network.log_probabilities(x[i : i + 64]) for i in range(0, len(x), 64)])
                    total = np.stack([np.bincount(of, logs[:, k] * size, len(some)) for k in range(len(network.languages))], axis=1)
                    total /= np.bincount(of, size, len(some))[:, None]
                    p = np.exp(total - total.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                for i, text in enumerate(some.to_pylist()):
                    if network is None or text is None or not _LETTER.search(text):
                        yield next(ids), "und", 0.0
                    else:
                        yield next(ids), network.languages[best[i]], float(min(1.0, p[i, best[i]]))

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    predicted = map_rows(rows, "doc_id long, lang_pred string, score double", _PREDICTED, per_task)
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
