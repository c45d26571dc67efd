"""Token-id output: sorted-string-table shards (operator 1).

A shard is one file of documents in ascending order of their identifier:

* data blocks of about BLOCK_BYTES: entries (shared, unshared, value length as unsigned LEB128, unshared key bytes,
  value), the key's first `shared` bytes being those of the key before; each RESTART-th entry stores its key whole,
  and the block ends with the offsets of those entries (uint32) and their count, for binary search inside a block;
* a sparse index: for each block its last key, offset, length and tokens before it;
* a Bloom filter over the keys (10 bits a key, 7 probes);
* a footer of fixed size: offsets of index and filter, documents, tokens, magic.

Keys are the identifier as 8 bytes, big-endian with the sign flipped, so that byte order is number order; a null
identifier has the empty key and sorts first.  Values are the ids as little-endian unsigned integers of 16 or 32
bits.  Repeated identifiers are kept, all of them; get() returns every one.

Edge cases: a null or empty text has the end id alone; an empty table gives no shard, and reading none gives an
empty table; columns other than the two named are ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, IdTable, Runs, batches_of, bounded_batches, materialise, shared_dir, take_runs

MAGIC = b"LGSST001"
FOOTER = struct.Struct("<QQQQQQB7s8s")
BLOCK_BYTES = 1 << 16
RESTART = 16
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b + i * i) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Writes one shard to a binary stream; keys must come in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.docs = self.tokens = 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.last, self.n, self.before = bytearray(), [], b"", 0, self.tokens

    def add(self, key: bytes, value: bytes) -> None:
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.docs += 1
        self.tokens += len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _end_block(self) -> None:
        if self.n:
            self.block += np.array([*self.restarts, len(self.restarts)], "<u4").tobytes()
            self.index.append((self.last, self.at, len(self.block), self.before))
            self._write(bytes(self.block))
        self._new_block()

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._write(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) + _varint(t) for k, o, n, t in self.index))
        bloom_at, bits = self.at, max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._write(bytes(bloom))
        self._write(FOOTER.pack(index_at, len(self.index), bloom_at, bits, self.docs, self.tokens, self.width, b"", MAGIC))


class ShardReader:
    """Reads a shard from a seekable stream: all entries in order, or those of one key."""

    def __init__(self, stream):
        self.f = stream
        size = self.f.seek(0, 2) or self.f.tell()
        head = self._read(size - FOOTER.size, FOOTER.size)
        index_at, blocks, bloom_at, self.bits, self.docs, self.tokens, self.width, _, magic = FOOTER.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        data, at, self.index = self._read(index_at, bloom_at - index_at), 0, []
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            k, at = data[at : at + n], at + n
            o, at = _read_varint(data, at)
            m, at = _read_varint(data, at)
            t, at = _read_varint(data, at)
            self.index.append((k, o, m, t))
        self.bloom_at, self.bloom = bloom_at, None

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _entries(self, block: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end = len(block) - 4 * (int.from_bytes(block[-4:], "little") + 1)
        key = b""
        while at < end:
            shared, at = _read_varint(block, at)
            more, at = _read_varint(block, at)
            n, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + more]
            at += more
            yield key, block[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(identifier, tokens before it in this shard, ids as bytes)."""
        for _, at, n, before in self.index:
            for key, value in self._entries(self._read(at, n)):
                yield id_of(key), before, value
                before += len(value) // self.width

    def may_hold(self, doc_id: int | None) -> bool:
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, (self.bits + 7) // 8)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of each document of this identifier: Bloom filter, binary search over blocks, then over restarts."""
        key, found = key_of(doc_id), []
        if not self.may_hold(doc_id):
            return found
        for _, at, n, _ in self.index[bisect.bisect_left(self.index, key, key=lambda x: x[0]) :]:
            block = self._read(at, n)
            restarts = np.frombuffer(block[-4 * (int.from_bytes(block[-4:], "little") + 1) : -4], "<u4").tolist()
            i = bisect.bisect_left(restarts, key, key=lambda o: next(self._entries(block, o))[0])
            for k, v in self._entries(block, restarts[max(0, i - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
        return found


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


#: ASCII marks that the pre-tokenizer parts from letters before them; an apostrophe may belong to what follows.
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of stretches, one stretch after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _texts(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[str]:
    return [raw[a : a + n].tobytes().decode("utf-8", "replace") for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def _column(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of bytes as a column of texts, unchecked."""
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(raw.take(_places(start, size))))


def _settled(words: list[str]) -> bool:
    """Whether lower case keeps words of letters so (it makes a letter and a mark of some) and composing (NFC) changes none."""
    text = " ".join(words)
    return unicodedata.is_normalized("NFC", text) and text.lower().replace(" ", "").isalpha()


def _letters(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words are letters alone, and stay so through normalisation; broken UTF-8 is none.  size: at least 1."""
    flat = raw.take(_places(start, size))
    first = np.cumsum(size) - size
    found = np.logical_and.reduceat(_LETTER.take(flat), first)
    other = np.flatnonzero(np.maximum.reduceat(flat, first) > 127)
    if len(other):
        some = _column(raw, start[other], size[other])
        try:
            some.validate(full=True)
        except pa.ArrowInvalid:
            some = pa.array(_texts(raw, start[other], size[other]), pa.large_string())
        other, words = other[np.asarray(alpha := pc.utf8_is_alpha(some))], some.filter(alpha).to_pylist()
        found[other] = _settled(words) or [_settled([w]) for w in words]
    return found


class WordEncoder:
    """Texts -> ids, for tokenizers that drop white space and mark the ends of words: the tokenizers library encodes
    each new word once, and words that come again are looked up (by a hash, confirmed on their bytes).

    A word's ids don't depend on its neighbours, for normalisation works on characters and the pre-tokenizer splits
    at white space.  It also splits between letters and ASCII marks (but the apostrophe), so words of letters with a
    tail of marks are encoded without it, and the tail by itself.  New words of letters go to the library many in one
    text; the word-end marks tell their ids apart.
    """

    GROUP = 256
    WORDS = 1_000_000  # at most in each of two tables, about 80 bytes a word

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.parts, self.tails = IdTable(self.WORDS), IdTable(self.WORDS), IdTable(self.WORDS // 10)

    def _grouped(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, flat, and how many each has: many words in a text, one by one where the library
        doesn't split as expected."""
        first = np.cumsum(size + 1) - size - 1
        spaced = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        spaced[_places(first, size)] = raw.take(_places(start, size))
        cuts = [*first[:: self.GROUP].tolist(), len(spaced)]
        texts = [spaced[a:b].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        flat, sizes = [], []
        for text, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            each = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(each) != text.count(" "):
                ids, each = self._singly(text.split(" ")[:-1])
            flat.append(ids)
            sizes.append(each)
        return np.concatenate(flat), np.concatenate(sizes)

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _parts(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, flat and in order, and how many each has; plain: those of letters alone."""
        rest = np.flatnonzero(~plain)
        found = [self._grouped(raw, start[plain], size[plain])] if plain.any() else []
        for g in range(0, len(rest), self.GROUP):
            some = rest[g : g + self.GROUP]
            found.append(self._singly(_texts(raw, start[some], size[some])))
        flat, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        back = np.argsort(np.concatenate([np.flatnonzero(plain), rest]))
        begin = (np.cumsum(sizes) - sizes)[back]
        return flat.take(_places(begin, sizes[back])), sizes[back]

    def _known(self, table: IdTable, raw: np.ndarray, start: np.ndarray, size: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        runs = Runs(_column(raw, start, size))
        return table.ids(runs.raw, runs.start, runs.end, runs.hash, lambda new: self._parts(raw, start[new], size[new], plain[new]))

    def _new_words(self, runs: Runs, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = runs.end[at] - runs.start[at]
        raw = runs.raw.take(_places(runs.start[at], size))
        start = np.cumsum(size) - size
        tail = size + start - np.maximum.reduceat(np.where(_MARK.take(raw), 0, np.arange(1, len(raw) + 1)), start)
        tail = np.where(tail < size, tail, 0)
        plain = _letters(raw, start, size - tail)
        tail[~plain] = 0
        own = _places(start[plain], (size - tail)[plain])
        lower = raw.copy()
        lower[own] = LOWER.take(raw[own])
        flat, sizes = self._known(self.parts, lower, start, size - tail, plain)
        marked = np.flatnonzero(tail)
        if len(marked):  # the tails' ids go in behind their parts
            more, each = self._known(self.tails, raw, (start + size - tail)[marked], tail[marked], np.zeros(len(marked), bool))
            flat = np.insert(flat, np.repeat(np.cumsum(sizes)[marked], each), more)
            sizes[marked] += each
        return flat, sizes

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for some in take_runs(texts):
            runs = Runs(some)
            flat, size = self.words.ids(runs.raw, runs.start, runs.end, runs.hash, lambda at, runs=runs: self._new_words(runs, at))
            ends = np.append(0, np.cumsum(size))[runs.of]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield flat[a:b]


@functools.lru_cache(maxsize=1)
def _encoder(tokenizer_path: str) -> WordEncoder:
    """One for all tasks that run in a worker process: what one task has encoded, later ones look up."""
    return WordEncoder(tokenizer_path)


def write_token_shards(
    docs: DataFrame,
    tokenizer_path: str,
    out_dir: str,
    end_id: int = 1,
    vocabulary: int = 49_408,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode and write documents as shards below out_dir; returns the manifest (shard, path, docs, tokens).

    One range shuffle of the texts brings them into ascending order; encoding and writing happen in the task that
    got a range, so ids never pass through Spark.  A task writes under a name of its own and the manifest names the
    files that count, so repeated or lost attempts do no harm.  out_dir is a URI that pyarrow.fs can open.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    width = 2 if vocabulary <= 65_536 and end_id < 65_536 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder, writer, end = _encoder(tokenizer_path), None, end_id.to_bytes(width, "little")
        fs, folder = _open(out_dir)
        path = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.sst"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    stream = fs.open_output_stream(path)
                    writer = ShardWriter(stream, width)
                writer.add(key_of(doc_id), ids.astype(f"<u{width}").tobytes() + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield batches_of([(context.partitionId(), path.rsplit("/", 1)[1], writer.docs, writer.tokens)], _MANIFEST)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return ordered.mapInArrow(write, "shard int, path string, docs long, tokens long")


_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_shards(manifest: DataFrame, out_dir: str) -> DataFrame:
    """Read the shards that a manifest names: doc_id, start, n_tokens, ids_crc32 of ids as unsigned 32-bit integers.

    start counts the tokens of all documents before; the shards' totals are summed over the manifest, which has one
    row a shard.
    """
    from pyspark.sql import Window

    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    named = manifest.select("shard", "path", F.coalesce(before, F.lit(0)).cast("long").alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, folder = _open(out_dir)
                with fs.open_input_file(f"{folder}/{row['path']}") as f:
                    shard, rows = ShardReader(f), []
                    for doc_id, start, value in shard:
                        ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                        rows.append((doc_id, row["before"] + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) >= 4000:
                            yield batches_of(rows, _READ)
                            rows = []
                    if rows:
                        yield batches_of(rows, _READ)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write shards to the shared folder, then read them back."""
    out_dir = shared_dir(spark, "token-shards")
    manifest = materialise(write_token_shards(docs, tokenizer_path, out_dir, end_id), "token-manifest")
    return read_token_shards(manifest, out_dir)
