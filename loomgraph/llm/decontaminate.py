"""Benchmark decontamination by pigeonhole edit matching (operator 6).

Texts and items are compared in lower case with runs of white space as one space.  An item of m characters may differ
from a passage by k = floor(error_rate * m) edits.  Cut into k + 1 pieces, one piece at least is untouched, so every
passage within the budget holds an exact piece: an Aho-Corasick automaton finds the pieces of all items in one pass
over a text, and Myers' bit-parallel distance verifies the surroundings of each hit.

Items are few, but their table may grow: they are dealt to blocks of about BLOCK_CHARS characters, which are written to
the shared folder; tasks read them there, so neither the driver nor the plan holds items.  There is one pass over the
documents: a task holds the automaton of one block at a time, and about DOC_BYTES of texts that it shows to each block.

Edge cases: null, empty and blank items match nothing, null and empty texts hold nothing; items shorter than
1 / error_rate need an exact hit; of an item's passages in a document the closest, then the first, is reported;
repeated rows are searched each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, bounded_batches, materialise, shared_dir

ERROR_RATE = 0.05
BLOCK_CHARS, DOC_BYTES = 4_000_000, 64_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """An item for approximate search: Myers' bit vectors over whole words of any length (Python's integers)."""

    def __init__(self, text: str, budget: int):
        self.text, self.m, self.k = text, len(text), budget
        self.eq = self._bits(text)
        self.back = self._bits(text[::-1])

    @staticmethod
    def _bits(text: str) -> dict[str, int]:
        bits: dict[str, int] = {}
        for i, c in enumerate(text):
            bits[c] = bits.get(c, 0) | 1 << i
        return bits

    def _scan(self, eq: dict[str, int], text: str, anchored: bool) -> tuple[int, int]:
        """(least distance, first end) over ends in text; anchored: the match starts at the text's start."""
        m, mask, top = self.m, (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, best, end = mask, 0, self.m, self.m, 0
        for j, c in enumerate(text, 1):
            e = eq.get(c, 0)
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph = (mv | ~(xh | pv)) & mask
            mh = pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph = (ph << 1 | anchored) & mask
            mh = (mh << 1) & mask
            pv = mh | (~(xv | ph) & mask)
            mv = ph & xv
            if score < best:
                best, end = score, j
                if not best:
                    break
        return best, end

    def search(self, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the closest passage within the budget."""
        at = text.find(self.text)
        if at >= 0:
            return 0, at, at + self.m
        best, end = self._scan(self.eq, text, False)
        if best > self.k:
            return None
        _, length = self._scan(self.back, text[max(0, end - self.m - self.k) : end][::-1], True)
        return best, end - length, end


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of nearly equal length."""
    n, m = budget + 1, len(text)
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.patterns: list[tuple[int, Pattern]] = []
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text)
            if text:
                p = Pattern(text, int(error_rate * len(text)))
                for offset, piece in pieces(text, p.k):
                    owners.setdefault(piece, []).append((len(self.patterns), offset + len(piece)))
                self.patterns.append((item_id, p))
        self.automaton = ahocorasick.Automaton()
        for piece, owned in owners.items():
            self.automaton.add_word(piece, owned)
        if owners:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) in the normalised text, for each item within its budget."""
        text = normalise(text)
        if not text or not self.patterns:
            return []
        areas: dict[int, list[list[int]]] = {}
        for end, owned in self.automaton.iter(text):
            for i, upto in owned:
                p = self.patterns[i][1]
                a, b = max(0, end + 1 - upto - p.k), end + 1 - upto + p.m + p.k
                own = areas.setdefault(i, [])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        found = []
        for i, own in areas.items():
            item_id, p = self.patterns[i]
            hits = [(h[0], h[1] + a, h[2] + a) for a, b in own if (h := p.search(text[a:b]))]
            if hits:
                found.append((item_id, *min(hits)))
        return found


def contamination(
    docs: DataFrame,
    items: DataFrame,
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    id_type: str = "long",
) -> DataFrame:
    """doc_id (or id_col), item_id, distance, start_pos, end_pos: the closest passage of each item in each document."""
    bounded_batches(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    folder = shared_dir(docs.sparkSession, "items")
    schema = pa.schema([(id_col, pa.int64() if id_type == "long" else pa.string()), *((c, pa.int64()) for c in ("item_id", "distance", "start_pos", "end_pos"))])
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    dealt.repartition(blocks, "block").write.partitionBy("block").parquet(folder)

    def matcher_of(block: int) -> Matcher:
        fs, path = pafs.FileSystem.from_uri(folder)
        path = f"{path}/block={block}"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return Matcher([], error_rate)
        found = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["item_id", "text"]).to_pydict()
        return Matcher(sorted(zip(found["item_id"], found["text"], strict=True), key=str), error_rate)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, matcher, mine = [], 0, None, -1

        def hits():
            nonlocal matcher, mine
            for block in range(blocks):
                if block != mine:
                    matcher, mine = None, block  # the one before goes first
                    matcher = matcher_of(block)
                rows = [(d, *hit) for b in held for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in matcher.search(t)]
                if rows:
                    yield batches_of(rows, schema)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if blocks == 1 or size >= DOC_BYTES:
                yield from hits()
                held, size = [], 0
        if held:
            yield from hits()

    rows = docs.select(F.col(id_col).cast(id_type).alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, f"{id_col} {id_type}, item_id long, distance long, start_pos long, end_pos long")


def drop_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no item, with all their columns: a text is judged, whatever its identifier.

    Hits are few against the documents, so digests of their texts are written once and taken away by an anti join.
    """
    found = contamination(docs.select(F.md5(F.col("text").cast("binary")).alias("name"), "text"), items, error_rate, id_col="name", id_type="string")
    hits = materialise(found.select("name").distinct(), "hits")
    return docs.join(hits, F.md5(docs["text"].cast("binary")) == hits["name"], "left_anti")
