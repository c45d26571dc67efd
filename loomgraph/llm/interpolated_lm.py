"""Language-model scores by deleted interpolation (operator 11).

The probability of a token is a mixture of its maximum-likelihood estimates behind contexts of every length below
`order`, and of the add-one estimate, which gives unseen tokens their share.  The mixture's weights depend on how often
the contexts were seen (buckets of powers of two) and are learned by expectation-maximisation on counts that were held
out: those of a seventh of the training documents, taken away from all others' counts (deleted), so that a token of this
seventh meets the model that the rest would give.

Counts stay with the data.  Texts are dealt to pieces of bounded size by a hash; a piece asks for each of its different
n-grams once, however often they stand in it, so a word that is everywhere costs one entry a piece.  Askings are dealt
by ranges of the n-grams' hashes to buckets of bounded size, which sum what the pieces bring and answer with whole counts
in the order asked.  Answers meet the texts again by piece.  All documents of the training part are counted; the driver
sees sums and at most 32 ** (order - 1) rows of weights.

For the expectation steps tokens of like estimates are taken together: cells of half powers of two in each estimate, with
the means of what falls in them.  So a bucket's table is bounded and its steps run in one task, whatever the corpus.

N-grams are told apart by 63-bit hashes of their words; two collide with probability 2^-55 or so.

Edge cases: null, empty and blank texts are the end token alone; a null identifier counts as the empty text for the
split; repeated rows are counted and scored each; without training documents every token has probability 1 / 1, without
held-out counts the weights are equal; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Runs, bounded_batches, materialise, mix64

PIECE_BYTES = 8_000_000
#: Text whose n-grams of one order go to one bucket, about.
BUCKET_BYTES = 16_000_000
LEVELS, CELLS = 32, 64
STEPS = 300

END, BEGIN = np.uint64(0x0E4D), np.uint64(0xBE61)
TRAIN, DELETED, HELD_OUT = 0, 1, 2

_ASKED = "gram_order int, bucket int, chunk int, piece int, deleted boolean, n_asked int, grams binary, counts binary"
_ANSWER = "gram_order int, bucket int, chunk int, piece int, counts binary, deleted_counts binary, types long, tokens long, deleted_tokens long"


def _pack(x: np.ndarray) -> bytes:
    """Numbers of as many bytes as the largest needs, by planes: a byte for their number, then the lowest bytes of all."""
    wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([wide]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


class Tokens:
    """Tokens of a column of texts: the words in lower case, then one end for each text; gram(k): 63-bit hashes of the
    last k tokens at each place, places before a text's start being one mark."""

    def __init__(self, texts: pa.Array):
        words = Runs(texts, lower=True)
        count = np.diff(words.of)
        self.of = np.concatenate([[0], np.cumsum(count + 1)])
        self.first = np.zeros(self.of[-1], bool)
        self.first[self.of[:-1]] = True
        self.ends = self.of[1:] - 1
        self.doc = np.repeat(np.arange(len(count)), count + 1)
        self.one = np.full(self.of[-1], END, np.uint64)
        is_word = np.ones(self.of[-1], bool)
        is_word[self.ends] = False
        self.one[is_word] = words.hash
        self._last = (1, self.one)

    def before(self, x: np.ndarray, begin) -> np.ndarray:
        """x at the token before; begin where a text starts."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = begin
        return out

    def gram(self, k: int) -> np.ndarray:
        at, g = self._last
        if at > k:
            at, g = 1, self.one
        while at < k:
            g = mix64(self.before(g, BEGIN) * np.uint64(0x9FB21C651E98DF25) + self.one)
            at += 1
        self._last = (at, g)
        return g >> np.uint64(1)


def _rounds(batches: Iterator[pa.RecordBatch], piece_bytes: int):
    """(chunk, piece, answers of the chunk, rows) of sorted batches, answers before texts: a piece begins where the bytes
    before it in its chunk pass a multiple of piece_bytes, wherever batches end."""
    at, held, upto, answers = None, [], 0, {}
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        if "counts" in batch.schema.names:
            asked = pc.is_valid(batch.column("counts"))
            for row in batch.filter(asked).to_pylist():
                answers.setdefault(row["chunk"], []).append(row)
            batch = batch.filter(pc.invert(asked))
            chunks = batch.column("chunk").to_numpy()
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        edges = np.flatnonzero(np.diff(chunks, prepend=-1, append=-1)) if len(chunks) else []
        for a, b in zip(edges, edges[1:], strict=False):
            if at is None or at[0] != chunks[a]:
                upto = 0
            piece = (upto + np.cumsum(size[a:b]) - size[a:b]) // piece_bytes
            upto += int(size[a:b].sum())
            cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1))
            for x, y in zip(cuts, cuts[1:], strict=False):
                key = (int(chunks[a]), int(piece[x]))
                if at is not None and key != at:
                    yield *at, answers.get(at[0], []), pa.Table.from_batches(held).combine_chunks()
                    held = []
                    if at[0] != key[0]:
                        answers.pop(at[0], None)
                at = key
                held.append(batch.slice(a + x, y - x))
    if held:
        yield *at, answers.get(at[0], []), pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


class Model:
    def __init__(self, spark, rows: DataFrame, order: int, piece_bytes: int, bucket_bytes: int):
        size = {r["part"]: (r["n"], r["b"] or 0) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()}
        docs = lambda part: size.get(part, (0, 0))[0]
        bytes_of = lambda *parts: sum(size.get(p, (0, 0))[1] for p in parts)
        self.order, self.piece_bytes = order, piece_bytes
        self.documents, self.deleted_documents = docs(TRAIN) + docs(DELETED), docs(DELETED)
        self.plain = max(1, -(-bytes_of(TRAIN, HELD_OUT) // piece_bytes))
        self.chunks = self.plain + max(1, -(-bytes_of(DELETED) // piece_bytes))
        self.buckets = max(1, -(-bytes_of(TRAIN, DELETED, HELD_OUT) // bucket_bytes))
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.chunks)
        name = F.xxhash64("doc_id", "text")
        chunk = F.when(F.col("part") == DELETED, self.plain + F.pmod(name, F.lit(self.chunks - self.plain))).otherwise(F.pmod(name, F.lit(self.plain)))
        self.rows = rows.select("doc_id", "part", "text", name.alias("name"), chunk.cast("int").alias("chunk"))

    def _askings(self) -> DataFrame:
        order, buckets, piece_bytes = self.order, self.buckets, self.piece_bytes
        names = [f.split()[0] for f in _ASKED.split(", ")]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, piece, _, rows in _rounds(batches, piece_bytes):
                part = _column(rows, "part").to_numpy()
                tokens = Tokens(_column(rows, "text"))
                counted = (part != HELD_OUT)[tokens.doc].astype(np.uint64)
                for k in range(1, order + 1):
                    marked = np.sort(tokens.gram(k) << np.uint64(1) | counted)
                    gram = marked >> np.uint64(1)
                    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                    counts, gram = np.add.reduceat(marked & np.uint64(1), first), gram[first]
                    bucket = ((gram >> np.uint64(31)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    for b in np.unique(bucket).tolist():
                        x, y = np.searchsorted(bucket, [b, b + 1])
                        row = (k, b, chunk, piece, bool(part[0] == DELETED), int(y - x), _pack(np.diff(gram[x:y], prepend=np.uint64(0))), _pack(counts[x:y]))
                        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)}, schema=_arrow(_ASKED))

        dealt = self.rows.repartition(self.tasks, "chunk").sortWithinPartitions("chunk", "doc_id", "name")
        return dealt.mapInArrow(ask, _ASKED)

    def count(self) -> None:
        """Sums the n-grams; self.answers: what each piece asked for, in its order."""
        if 1 << 32 <= self.buckets:
            raise ValueError("more buckets than ranges of hashes")

        def answer(asked: pd.DataFrame) -> pd.DataFrame:
            asked = asked.sort_values(["chunk", "piece"])
            grams = [np.cumsum(_unpack(x), dtype=np.uint64) for x in asked["grams"]]
            counts = np.concatenate([_unpack(x) for x in asked["counts"]]).astype(np.int64)
            different, back = np.unique(np.concatenate(grams), return_inverse=True)
            gone = np.repeat(asked["deleted"].to_numpy(bool), asked["n_asked"].to_numpy())
            total, deleted = (np.bincount(back, c, len(different)).astype(np.int64) for c in (counts, counts * gone))
            out = asked[["gram_order", "bucket", "chunk", "piece"]].copy()
            ends = np.cumsum(asked["n_asked"].to_numpy())[:-1]
            out["counts"] = [_pack(x) for x in np.split(total[back], ends)]
            out["deleted_counts"] = [_pack(x) for x in np.split(deleted[back], ends)]
            for name, n in (("types", (total > 0).sum()), ("tokens", total.sum()), ("deleted_tokens", deleted.sum())):
                out[name] = [int(n), *[0] * (len(out) - 1)]
            return out

        asked = self._askings().repartition(max(self.tasks, self.order * self.buckets), "gram_order", "bucket")
        self.answers = materialise(asked.groupBy("gram_order", "bucket").applyInPandas(answer, _ANSWER), "counts")
        sums = self.answers.where("gram_order = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "deleted_tokens"))).first()
        self.types, self.tokens, self.deleted_tokens = map(int, sums)

    def _met(self, only_deleted: bool) -> DataFrame:
        """Texts and the answers to their pieces, chunk by chunk."""
        of = (F.col("chunk") >= self.plain) if only_deleted else F.lit(True)
        none = lambda kind: F.lit(None).cast(kind)
        texts = self.rows.where(of).select("chunk", "doc_id", "part", "text", "name", none("int").alias("gram_order"), none("int").alias("bucket"), none("int").alias("piece"), none("binary").alias("counts"), none("binary").alias("deleted_counts"))
        answers = self.answers.where(of).select("chunk", none("long").alias("doc_id"), none("int").alias("part"), none("string").alias("text"), none("long").alias("name"), "gram_order", "bucket", "piece", "counts", "deleted_counts")
        both = texts.unionByName(answers).repartition(self.tasks, "chunk")
        return both.sortWithinPartitions("chunk", F.col("counts").isNull(), "doc_id", "name")

    def estimates(self, deleted: bool):
        """A function of batches: (rows, tokens, whole counts of the tokens, estimates from the add-one one up to the longest
        context's, level of the contexts) of each piece; deleted: with the deleted part's counts taken away."""
        order, piece_bytes = self.order, self.piece_bytes
        n_docs = self.documents - (self.deleted_documents if deleted else 0)
        n_tokens, types = self.tokens - (self.deleted_tokens if deleted else 0), self.types

        def each(batches: Iterator[pa.RecordBatch]):
            for _, piece, answers, rows in _rounds(batches, piece_bytes):
                tokens = Tokens(_column(rows, "text"))
                counts: list[np.ndarray] = []
                for k in range(1, order + 1):
                    mine = sorted((a for a in answers if a["piece"] == piece and a["gram_order"] == k), key=lambda a: a["bucket"])
                    whole = np.concatenate([_unpack(a["counts"]) for a in mine]).astype(np.int64)
                    if deleted:
                        whole -= np.concatenate([_unpack(a["deleted_counts"]) for a in mine]).astype(np.int64)
                    _, back = np.unique(tokens.gram(k), return_inverse=True)
                    counts.append(whole[back])
                p = [(counts[0] + 1) / (n_tokens + types + 1), counts[0] / max(1, n_tokens)]
                level = np.zeros(len(counts[0]), np.int64)
                for k in range(2, order + 1):
                    context = tokens.before(counts[k - 2], n_docs)
                    p.append(counts[k - 1] / np.maximum(1, context))
                    level += np.minimum(LEVELS - 1, np.frexp(context.astype(float))[1]) * LEVELS ** (k - 2)
                yield rows, tokens, counts[0], p, level

        return each

    def learn(self) -> None:
        """self.weights: a row of the mixture's weights for each level of the contexts."""
        each, n_p = self.estimates(True), self.order + 1
        sums = [f"p{i}" for i in range(n_p)]
        schema = "level long, cell long, n long, " + ", ".join(f"{c} double" for c in sums)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, _, _, p, level in each(batches):
                cell = level.copy()
                for x in p[1:]:
                    cell = cell * CELLS + np.where(x > 0, np.minimum(CELLS - 1, 1 + np.floor(-2 * np.log2(np.maximum(x, 1e-300)))), 0).astype(np.int64)
                key, back, n = np.unique(cell, return_inverse=True, return_counts=True)
                columns = [key // CELLS ** (n_p - 1), key % CELLS ** (n_p - 1), n, *(np.bincount(back, x) for x in p)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_arrow(schema))

        def mix(pdf: pd.DataFrame) -> pd.DataFrame:
            n = pdf["n"].to_numpy(float)
            weights = expectation_maximisation(pdf[sums].to_numpy() / n[:, None], n)
            return pd.DataFrame({"level": [pdf["level"].iloc[0]], "n": [int(n.sum())], "weights": [weights.tolist()]})

        counted = self._met(True).mapInArrow(cells, schema).groupBy("level", "cell").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))
        rows = counted.groupBy("level").applyInPandas(mix, "level long, n long, weights array<double>").collect()
        self.weights = mixture(self.order, self.tokens, {r["level"]: (r["n"], r["weights"]) for r in rows})

    def scores(self) -> DataFrame:
        each, weights, known_of, n_tokens, floor = self.estimates(False), self.weights, self.tokens, self.tokens, self.tokens + self.types + 1
        schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, tokens, count, p, level in each(batches):
                mixed = np.zeros(len(level))
                for i, x in enumerate(p):
                    mixed += weights[level, i] * x
                first = tokens.of[:-1]
                columns = [
                    _column(rows, "doc_id"), pa.array(_column(rows, "part").to_numpy() == HELD_OUT), pa.array(np.diff(tokens.of), pa.int64()), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                    pa.array(np.full(len(first), n_tokens, np.int64)), pa.array(np.add.reduceat(np.log10((count + 1) / floor), first)), pa.array(np.add.reduceat(np.log10(mixed), first)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_arrow(schema))

        return self._met(False).mapInArrow(score, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def expectation_maximisation(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a mixture of estimates (columns of p) for rows that stand n times; each estimate has one more token."""
    weights = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(STEPS):
        share = p * weights
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        new = (share.sum(0) + 1) / (n.sum() + p.shape[1])
        if np.abs(new - weights).max() < 1e-7:
            return new
        weights = new
    return weights


def mixture(order: int, tokens: int, learned: dict[int, tuple[int, list[float]]]) -> np.ndarray:
    """Weights for every level of the contexts: the learned ones, else their mean by tokens, else equal ones.  Estimates
    behind contexts that were never seen have none, so the weights of the rest sum to one and the mixture stays a
    distribution."""
    total = sum(n for n, _ in learned.values())
    usual = sum(n * np.asarray(w) for n, w in learned.values()) / total if total else np.full(order + 1, 1 / (order + 1))
    out = np.tile(usual, (LEVELS ** (order - 1), 1))
    for level, (_, w) in learned.items():
        out[level] = w
    for k in range(2, order + 1):
        unseen = np.arange(len(out)) // LEVELS ** (k - 2) % LEVELS == 0
        out[unseen, k] = 0
    if not tokens:
        out[:, 1:] = 0
    return out / out.sum(1, keepdims=True)


def language_model_scores(
    docs: DataFrame, order: int = 2, folds: int = 7, held_out: int = 2, deleted: int = 5, piece_bytes: int = PIECE_BYTES, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one, without contexts), score (the mixture's), both
    log10 probabilities of the text.

    Documents whose crc32(doc_id as text) modulo folds is held_out are not learned from; those where it is `deleted` give
    the held-out counts for the weights.  order: length of the longest n-grams, 2 or more.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    part = F.when(fold == held_out, HELD_OUT).when(fold == deleted, DELETED).otherwise(TRAIN)
    model = Model(spark, docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), F.col(text_col).alias("text")), order, piece_bytes, bucket_bytes)
    model.count()
    model.learn()
    return model.scores()
