"""Byte-level BPE as a streaming transducer, and its decoder (operator 2).

Encoding.  A Transducer reads one text chunk by chunk and lets ids go as soon as they are stable; every text goes
through one.  Two lookaheads say when:

* A piece of the pre-tokenizer's pattern is settled when three more characters have been read behind its end, for the
  pattern looks no further; in plain text (single spaces before words) a word is settled when the next space is read.
* A piece that is still open is merged by the merge list with a bounded view to the right: a token can leave when no
  later byte can take it apart.  MergeTable.lookahead is how many bytes to the right can matter at most.  It is
  computed from the list alone: rule i = (s, z) can take a token s away from what stands left of it; whether z stood
  there when rule i ran depends on z's own bytes and on rules before i that could have taken the tokens at z's right
  edge, so

      reach(i) = len(z) + max(reach(j) : j < i, rule j takes a token of z's right edge),

  and the lookahead is the greatest reach.  PieceTransducer keeps that many bytes and a block; tokens that end
  `lookahead` bytes or more before the end of what was read leave.

So a transducer's state (`kept` characters, or a PieceTransducer's bytes) is bounded, however long a text or a piece of
it is.  Chunks are of CHUNK characters for every text, so all texts but the shortest leave most of their ids before their
end is read, and a piece that is still open after a chunk goes by the merge list's lookahead.  Batched form: the
transducers of many texts take a chunk each in one step, and the words that they settle in it are merged together; words
that come again are remembered in tables of bounded size.

Decoding is a state machine over ids: bytes of ids in, characters out, with the bytes of an unfinished character as
its state; malformed bytes become U+FFFD as in the tokenizers library.

Edge cases: null and empty texts have no ids and decode to the empty text; special tokens' strings in a text become
their ids, as the library does; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, SPACE, IdTable, Runs, map_rows, take_runs, utf8

# White space of Unicode, and the pattern of byte-level pre-tokenizers.
_S = r"\t-\r \x85\xa0  -     　"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", rf"[^{_S}\p{{L}}\p{{N}}]+", rf"[{_S}]+")]
#: Characters of a chunk; bytes of a word, and pieces, up to which they are remembered.
CHUNK, MEMO_BYTES, MEMO_PIECES = 2048, 400, 200_000
#: Words of a step from which on they are remembered in the large table, which is dear to add to.
MANY_WORDS = 10_000
#: Only spaces part words here; bytes after a space that make a text hard.
SPACE_ONLY = np.full(256, LETTER, np.uint8)
SPACE_ONLY[32] = SPACE
ODD_BYTE = np.zeros(256, bool)
ODD_BYTE[[*range(9, 14), *range(0x1C, 0x21)]] = True
NO_RULE = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Vocabulary and merge list of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocabulary.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.base = [0] * 256
        for c, b in alphabet.items():
            if c in vocabulary:
                self.base[b] = vocabulary[c]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rules.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        self.lookahead = self._lookahead()
        self._tabulate()

    def _lookahead(self) -> int:
        """See the module's text; edge[t] holds the tokens that stood at t's right edge while t grew."""
        made: dict[int, list[int]] = {}
        reach: dict[int, int] = {}
        edge: dict[int, set[int]] = {}
        for (s, z), (_, new) in sorted(self.rules.items(), key=lambda x: x[1][0]):
            at_edge = edge.setdefault(z, {z})
            most = len(self.bytes[z]) + max(reach.get(t, 0) for t in at_edge)
            reach[s] = max(reach.get(s, 0), most)
            edge.setdefault(new, {new}).update(at_edge)
            made.setdefault(new, []).append(z)
        return max(reach.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece, or of what is left of it: lowest rank first, leftmost first among equals."""
        ids = list(map(self.base.__getitem__, data))
        if len(ids) > 40:
            return self._merge_long(ids)
        rules = self.rules
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                r = rules.get((ids[i], ids[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """merge() of many short pieces at once: in each round, every piece gets its lowest pair merged."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not sizes.sum():
            return [() for _ in pieces]
        ids = np.array(self.base, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        of = np.repeat(np.arange(len(pieces)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, new = self._pairs(ids, of)
        while len(ids):
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            over = np.repeat(best == NO_RULE, size)
            if over.any():  # pieces without a rule leave
                done.append((of[over], ids[over]))
                ids, of, rank, new = ids[~over], of[~over], rank[~over], new[~over]
                continue
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.append(True, of[hit[1:]] != of[hit[:-1]])]  # the leftmost
            ids[hit] = new[hit]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged token stands after the others have gone
            ids, of, rank, new = ids[keep], of[keep], rank[keep], new[keep]
            for x in (at, at[(at > 0)] - 1):
                x = x[np.append(of[1:] == of[:-1], False)[x]]
                rank[x], new[x] = self._find(ids[x], ids[x + 1])
            last = np.append(of[1:] != of[:-1], True)
            rank[last] = NO_RULE
        of, ids = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(of, kind="stable")
        flat, at = ids[order].tolist(), np.searchsorted(of[order], np.arange(len(pieces) + 1)).tolist()
        return [tuple(flat[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def _pairs(self, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, new = np.full(len(ids), NO_RULE), np.zeros(len(ids), np.int64)
        x = np.flatnonzero(of[1:] == of[:-1])
        rank[x], new[x] = self._find(ids[x], ids[x + 1])
        return rank, new

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair, by a table with open addressing."""
        want = a << 20 | b
        slot = self._slots(want)
        for _ in range(self.probes):
            miss = (self.keys[slot] != want) & (self.keys[slot] >= 0)
            if not miss.any():
                break
            slot = np.where(miss, (slot + 1) & self.mask, slot)
        hit = self.keys[slot] == want
        return np.where(hit, self.ranks[slot], NO_RULE), np.where(hit, self.made[slot], 0)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _tabulate(self) -> None:
        self.bits = max(8, len(self.rules).bit_length() + 2)
        self.mask, self.probes = (1 << self.bits) - 1, 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.made = np.zeros((2, 1 << self.bits), np.int64)
        pairs = np.array(list(self.rules), np.int64).reshape(-1, 2)
        for key, slot, (rank, new) in zip((pairs[:, 0] << 20 | pairs[:, 1]).tolist(), self._slots(pairs[:, 0] << 20 | pairs[:, 1]).tolist(), self.rules.values(), strict=True):
            n = 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & self.mask, n + 1
            self.probes = max(self.probes, n)
            self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, new

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, n log n."""
        n, rules = len(ids), self.rules
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = new, 1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rules.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, r[1], ids[x], ids[y]))
        return [t for t, g in zip(ids, gone, strict=True) if not g]


class PieceTransducer:
    """Bytes of one piece in, ids out as soon as they are stable."""

    def __init__(self, table: MergeTable, block: int = 4096):
        self.table, self.most, self.pending = table, table.lookahead + block, b""

    def push(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.most):
            self.pending += data[at : at + self.most]
            if len(self.pending) > self.most:
                done = 0
                for t in self.table.merge(self.pending):
                    end = done + len(self.table.bytes[t])
                    if end + self.table.lookahead > len(self.pending):
                        break
                    yield t
                    done = end
                self.pending = self.pending[done:]

    def end(self) -> list[int]:
        ids, self.pending = self.table.merge(self.pending), b""
        return ids


class Transducer:
    """The state of one text: what was read and isn't settled."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.kept, self.begun, self.pushes = encoder, "", False, 0
        #: of an open piece longer than a chunk: its transducer and the pattern of what may go on with it
        self.long: PieceTransducer | None = None
        self.run = None

    def push(self, chunk: str) -> list[int]:
        return self.encoder.step([self], [chunk], [False])[0].tolist()

    def end(self) -> list[int]:
        return self.encoder.step([self], [""], [True])[0].tolist()


class Encoder:
    """Steps of transducers, and the words that they remember together."""

    def __init__(self, table: MergeTable):
        self.table = table
        #: ids of a word with the space before it
        self.words = IdTable()
        self.few_words = IdTable(50_000)
        self.memo: dict[str, list[int]] = {}
        self.special = [s.encode() for s in table.special]

    def step(self, streams: list[Transducer], chunks: list[str], ends: list[bool]) -> list[np.ndarray]:
        """Each transducer reads its chunk (the last one of its text or not): the ids that became stable."""
        last = np.array(ends, bool)
        held = pa.array([t.kept + c for t, c in zip(streams, chunks, strict=True)], pa.large_string())
        runs = Runs(held, SPACE_ONLY)
        hard = self._hard(runs, np.array([t.begun for t in streams]))
        for i, t in enumerate(streams):
            t.pushes += 1
            hard[i] |= t.long is not None
        # the settled words of plain texts: all but the last one, which may grow
        size = np.diff(runs.of)
        take = np.ones(len(runs.start), bool)
        take[runs.of[1:][(size > 0) & ~last] - 1] = False
        take[np.repeat(hard, size)] = False
        first = runs.of[:-1][(size > 0) & ~hard & ~np.array([t.begun for t in streams])]
        head = first[take[first]]  # words without a space before them
        take[head] = False
        at = np.flatnonzero(take)
        sizes = np.zeros(len(runs.start), np.int64)
        known = self.words if len(at) >= MANY_WORDS else self.few_words
        flat, sizes[at] = known.ids(runs.raw, runs.start[at], runs.end[at], runs.hash[at], lambda x: self._new_words(runs, at[x]))
        upto = np.append(0, np.cumsum(sizes))
        heads = set(head.tolist())
        out = []
        for i, ((a, b), t) in enumerate(zip(runs, streams, strict=True)):
            if hard[i]:
                text = held[i].as_py()
                found = [x for ids in self._pieces(t, text, ends[i]) for x in ids]
                out.append(np.array(found, np.int32))
                t.begun |= bool(text) and len(t.kept) < len(text)
                continue
            ids = flat[upto[a] : upto[b]]
            if a < b and a in heads:
                ids = np.concatenate([np.array(self._head(runs.raw[runs.start[a] : runs.end[a]].tobytes().decode("utf-8")), np.int32), ids])
            if ends[i] or a == b:
                t.kept = "" if ends[i] else held[i].as_py()
            else:
                space = t.begun or b - a > 1
                t.kept = (" " if space else "") + runs.raw[runs.start[b - 1] : runs.end[b - 1]].tobytes().decode("utf-8")
                t.begun |= b - a > 1
            out.append(ids)
        return out

    def _new_words(self, runs: Runs, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = runs.raw.tobytes()
        cut = [PIECE.findall(" " + raw[a:b].decode("utf-8")) for a, b in zip(runs.start[at].tolist(), runs.end[at].tolist(), strict=True)]
        pieces = sorted(set().union(*cut))
        ids = dict(zip(pieces, self.table.merge_many([p.encode() for p in pieces]), strict=True))
        found = [[i for p in parts for i in ids[p]] for parts in cut]
        return np.array([i for x in found for i in x], np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _head(self, text: str) -> list[int]:
        return [i for p in PIECE.findall(text) for i in self._merge(p)]

    def _merge(self, piece: str) -> list[int]:
        ids = self.memo.get(piece)
        if ids is None:
            ids = self.table.merge(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    @staticmethod
    def _hard(runs: Runs, begun: np.ndarray) -> np.ndarray:
        """Texts that words with a space before them don't make up, or that hold very long words.  A text that goes on
        (begun) starts with such a space."""
        raw, starts = runs.raw, runs.texts
        hard = np.zeros(len(starts) - 1, bool)
        if not len(raw):
            return hard
        then = np.append(raw[1:], 32)
        then[starts[1:][starts[1:] > 0] - 1] = 32
        second = np.append(raw[2:], [0, 0])[: len(raw)]
        odd = ODD_BYTE[then] | ((then == 0xC2) & ((second == 0x85) | (second == 0xA0)))
        odd |= ((then == 0xE1) & (second == 0x9A)) | ((then == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((then == 0xE3) & (second == 0x80))
        at = np.flatnonzero((raw == 32) & odd)
        hard[np.searchsorted(starts, at, "right") - 1] = True
        full = np.diff(starts) > 0
        hard[full] |= (raw[starts[:-1][full]] == 32) != begun[full]
        long = runs.start[runs.end - runs.start > MEMO_BYTES]
        hard[np.searchsorted(starts, long, "right") - 1] = True
        return hard

    def _pieces(self, t: Transducer, kept: str, last: bool) -> Iterator[Iterable[int]]:
        """Any text: pieces of the pattern, those of more than a chunk by way of a PieceTransducer."""
        if t.long is not None:
            m = t.run.match(kept)
            end = m.end() if m else 0
            keep = 0 if last and end == len(kept) else t.run is RUNS[3]  # white space leaves its last character to what follows
            upto = max(0, end - keep)
            yield t.long.push(kept[:upto].encode("utf-8", "surrogatepass"))
            if end == len(kept) and not last:
                t.kept = kept[upto:]
                return
            yield t.long.end()
            kept, t.long = kept[upto:], None
        done = 0
        for m in PIECE.finditer(kept):
            if m.end() > len(kept) - 3 and not last:
                break
            yield self._merge(m[0])
            done = m.end()
        kept = kept[done:]
        if len(kept) >= CHUNK:
            m = PIECE.match(kept)
            if m.end() == len(kept):
                t.run = next(r for r in RUNS if r.match(m[0], len(m[0]) - 1))
                t.long, upto = PieceTransducer(self.table), len(kept) - (t.run is RUNS[3])
                yield t.long.push(kept[:upto].encode("utf-8", "surrogatepass"))
                kept = kept[upto:]
        t.kept = kept

    def _segments(self, text: str) -> list[tuple[str, int | None]]:
        """Text between special tokens, and the special token after it."""
        out, at = [], 0
        for m in re.finditer("|".join(map(re.escape, sorted(self.table.special, key=len, reverse=True))), text):
            out.append((text[at : m.start()], self.table.special[m[0]]))
            at = m.end()
        return [*out, (text[at:], None)]

    def encode_column(self, texts: pa.Array) -> Iterator[list[np.ndarray] | Iterator[np.ndarray]]:
        """For each text, its ids in parts, one for each chunk.  Texts of a run are read together; one that fills a run
        by itself, or holds special tokens, is read when its parts are."""
        for some in take_runs(texts):
            rows = [x or "" for x in some.to_pylist()]
            raw = utf8(some)[0].tobytes()
            marked = any(s in raw for s in self.special)
            alone = [len(rows) == 1 or marked and any(s in x for s in self.table.special) for x in rows]
            found = iter(self._together([x for x, a in zip(rows, alone, strict=True) if not a]))
            for x, a in zip(rows, alone, strict=True):
                yield self.parts(x) if a else next(found)

    def _together(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Parts of each text; in each step all texts that go on read a chunk."""
        streams, parts = [Transducer(self) for _ in texts], [[] for _ in texts]
        live, at = list(range(len(texts))), 0
        while live:
            ends = [at + CHUNK >= len(texts[i]) for i in live]
            for i, ids in zip(live, self.step([streams[i] for i in live], [texts[i][at : at + CHUNK] for i in live], ends), strict=True):
                parts[i].append(ids)
            live, at = [i for i, end in zip(live, ends, strict=True) if not end], at + CHUNK
        return parts

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """The ids of one text, chunk by chunk."""
        text = text or ""
        for segment, special in self._segments(text) if any(s in text for s in self.table.special) else [(text, None)]:
            t = Transducer(self)
            for at in range(0, len(segment), CHUNK):
                yield self.step([t], [segment[at : at + CHUNK]], [at + CHUNK >= len(segment)])[0]
            if special is not None:
                yield np.array([special], np.int32)

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.parts(text) for i in part.tolist()]


class Decoder:
    """Ids in, characters out; the bytes of an unfinished character wait."""

    def __init__(self, table: MergeTable):
        self.bytes = table.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def end(self) -> str:
        return self.state.decode(b"", True)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: array of ids of each whole text."""

    def per_task():
        encoder = Encoder(MergeTable(tokenizer_path))

        def each(batch):
            for d, parts in zip(batch.column(0).to_pylist(), encoder.encode_column(batch.column(1)), strict=True):
                yield d, [i for part in parts for i in part.tolist()]

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), per_task, 200)


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give the empty text."""

    def per_task():
        table = MergeTable(tokenizer_path)

        def each(batch):
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                decoder = Decoder(table)
                yield d, "".join([*(decoder.push(ids[i : i + 4096]) for i in range(0, len(ids or ()), 4096)), decoder.end()])

        return each

    rows = encoded.select(F.col("doc_id").cast("long"), "ids")
    return map_rows(rows, "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), per_task, 200)


_DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    + [("n_steps", pa.int64()), ("n_early", pa.int64())]
)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", steps: bool = False) -> DataFrame:
    """Encode and decode each whole text in one pass that keeps neither ids nor text: doc_id, n_tokens, ids_sha256
    (decimal ids joined by commas), decoded_sha256 (the decoded text in UTF-8); with steps also n_steps (chunks
    that the transducer read) and n_early (ids that left before the last of them)."""

    def per_task():
        table = MergeTable(tokenizer_path)
        encoder = Encoder(table)
        decimal = [str(i).encode() for i in range(max(table.bytes, default=0) + 1)]

        def each(batch):
            for d, parts in zip(batch.column(0).to_pylist(), encoder.encode_column(batch.column(1)), strict=True):
                decoder, digest, decoded = Decoder(table), hashlib.sha256(), hashlib.sha256()
                n = read = early = 0
                for part in parts:
                    read, early = read + 1, n
                    for at in range(0, len(part), 8192):
                        ids = part[at : at + 8192].tolist()
                        digest.update(b"," * bool(n) + b",".join(map(decimal.__getitem__, ids)))
                        decoded.update(decoder.push(ids).encode())
                        n += len(ids)
                decoded.update(decoder.end().encode())
                yield d, n, digest.hexdigest(), decoded.hexdigest(), read, early

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = map_rows(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_steps long, n_early long", _DIGEST, per_task)
    return found if steps else found.drop("n_steps", "n_early")
