"""Substring dedup with suffix automata (operator 8).

A window is `least` consecutive words of a document.  A word goes when a window that covers it occurs anywhere else.

The suffix automaton of a set of passages knows, for each stretch of words, whether it occurs twice; streaming a
passage through it gives matching statistics, for each end the length of the longest stretch that does, and words of
stretches of `least` or more go.  An automaton of the whole corpus fits nowhere, so passages are first routed to
shards such that equal windows meet:

1. Anchors.  Each window is named by its least hash of GRAM consecutive words (the first of equal ones), so equal
   windows have equal anchors and each window one anchor; one place in ten or so is an anchor.
2. Anchors that occur once in the corpus can't name a repeated window; the others are joined back to their texts, which
   are written in buckets, equal ones once with their number, so that no later step shuffles texts.
3. Passages.  The windows of one occurrence of an anchor are consecutive, and their words make a passage.  Equal
   passages are counted by digests and go on as one, which takes its words from the text of one occurrence.  A shard
   holds all passages of its anchors, so equal windows meet in one shard; anchors of more than CROWD different passages
   (a line that is in a third of all documents) are judged by counts of ever smaller groups of their windows instead.
4. A task reads its passages in the order of their anchors, SHARD_WORDS at a time (never parting an anchor), builds a
   suffix automaton with counts of occurrences and streams the passages through it.
5. What it found goes back to the occurrences and the documents.

Hashes only route: automata compare words themselves, which a shard numbers in the order of their coming, and passages
and their halved groups are equal by digests (128 bits and more) of their words.

Edge cases: null, empty and blank texts have no words; documents shorter than a window keep all their words; repeated
rows repeat each other's windows and lose them; windows are judged on the input; identifiers may be null or repeat;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD_CLASS, Runs, batches_of, bounded_batches, bucketed, gram_hashes, map_rows, materialise, take_runs

GRAM = 8
SHARD_WORDS = 20_000
CROWD = 300
#: Ends each passage in an automaton: not the number of a word.
SEPARATOR = -1


class SuffixAutomaton:
    """Of several sequences; count[s] is how often the stretches of state s occur, a sequence counting `times` times."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], times: int = 1) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)
            self.count[last] += times

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:  # the stretch is there already
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.count.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.count.append(0)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def finish(self) -> None:
        """Counts of all states, from the longest to the shortest."""
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            if s:
                self.count[self.link[s]] += self.count[s]

    def statistics(self, sequence: list[int], twice: int = 2) -> list[int]:
        """For each end, the length of the longest stretch that occurs `twice` times or more."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        s = n = 0
        out = []
        for c in sequence:
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            t = nxt[s].get(c)
            if t is None:
                s = n = 0
            else:
                s, n = t, n + 1
            while s and count[s] < twice:
                s = link[s]
                n = length[s]
            out.append(n)
        return out


def anchors_of(h: np.ndarray, least: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the anchor of each window of a sequence of word hashes."""
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = gram_hashes(h, gram)
    span = least - gram + 1
    # least of each stretch of `span` hashes and its first place, by doubling
    low, place, width = g, np.arange(len(g)), 1
    while 2 * width <= span:
        a, b = low[:-width], low[width:]
        second = b < a
        low, place = np.where(second, b, a), np.where(second, place[width:], place[:-width])
        width *= 2
    if width < span:
        a, b = low[: len(low) - (span - width)], low[span - width :]
        second = b < a
        low, place = np.where(second, b, a), np.where(second, place[span - width :], place[: len(place) - (span - width)])
    return place, low


class Words:
    """The words of each text of a column: their anchors, and the words joined by one space.  Hashes, anchors and the
    places of all texts are worked out together; a window belongs to a text when it ends inside it."""

    def __init__(self, column: pa.Array, least: int | None = None):
        self.runs = r = Runs(column)
        if least is not None:
            self.least, (self.place, self.low) = least, anchors_of(r.hash, least)
            self.low = self.low.view(np.int64)
        self.clean = np.where(WORD_CLASS.take(r.raw) == SPACE, np.uint8(32), r.raw)
        apart = np.zeros(len(r.start), bool)  # whether more than one byte is before a word
        apart[1:] = r.start[1:] != r.end[:-1] + 1
        apart[r.of[:-1][np.diff(r.of) > 0]] = False
        self.apart = np.append(0, np.cumsum(apart))

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(first word, last word + 1) of each text."""
        return iter(self.runs)

    def anchors(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Place (from the text's first word) and hash of the anchor of each window of a text."""
        n = max(0, b - a - self.least + 1)
        return self.place[a : a + n] - a, self.low[a : a + n]

    def joined(self, a: int, b: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words joined by a space, and where each starts and ends in them."""
        start, end = self.runs.start[a:b], self.runs.end[a:b]
        if a == b:
            return b"", start, end
        if self.apart[a] == self.apart[b]:
            return self.clean[start[0] : end[-1]].tobytes(), start - start[0], end - start[0]
        size = end - start
        at = np.cumsum(size + 1) - size - 1
        return b" ".join([self.clean[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist(), strict=True)]), at, at + size


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, row: a 128-bit name of the text; equal texts share it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("row", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16))


_SCANNED = pa.schema(
    [("doc_id", pa.int64()), ("row", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
)
_ANCHORED = pa.schema([*_SCANNED, ("anchors", pa.list_(pa.int64()))])
_PLACES = pa.schema(
    [("row", pa.binary()), ("copies", pa.int64()), ("anchor", pa.int64()), ("at", pa.int32()), ("anchor_at", pa.int32()), ("n", pa.int32()), ("key", pa.binary())]
)
_PASSAGES = pa.schema(
    [("key", pa.binary()), ("anchor", pa.int64()), ("anchor_at", pa.int32()), ("n", pa.int32()), ("times", pa.int64()), ("words", pa.binary())]
)
_FLAGS = pa.schema([("key", pa.binary()), ("flags", pa.binary())])
_CHANGED = pa.schema([("row", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
_RESULT = "doc_id long, row binary, n_words long, n_removed long, kept_sha256 string, kept string"


def _scanned(rows: DataFrame, least: int, texts: bool) -> DataFrame:
    """The result of each row if nothing is removed, and its anchors, one for each place."""

    def per_task():
        def each(batch):
            ids, row, at = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for some in take_runs(batch.column(1)):
                own = Words(some, least)
                for a, b in own:
                    place, low = own.anchors(a, b)
                    first = np.append(True, place[1:] != place[:-1])[: len(place)]
                    data = own.joined(a, b)[0]
                    yield ids[at], row[at], b - a, 0, hashlib.sha256(data).hexdigest(), data.decode("utf-8") if texts else None, low[first]
                    at += 1

        return each

    return map_rows(rows.select("doc_id", "text", "row"), _RESULT + ", anchors array<long>", _ANCHORED, per_task, 500)


def _passage_rows(touched: DataFrame, least: int) -> DataFrame:
    """row, copies, anchor, at (first word), anchor_at (of the anchor, from there), n (words), key (digest of the words
    joined by a space), for each passage of a repeated anchor; touched: row, text, copies, anchors (the repeated ones)."""

    def per_task():
        def each(batch):
            row, copies, wanted, at = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), 0
            for some in take_runs(batch.column(1)):
                own = Words(some, least)
                for a, b in own:
                    place, low = own.anchors(a, b)
                    data, start, end = own.joined(a, b)
                    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
                    last = np.append(first[1:], len(place))[: len(first)]
                    mine = np.isin(low[first], np.asarray(wanted[at].values))
                    first, last = first[mine], last[mine]
                    n, begin, finish = last - first + least - 1, start[first], end[last + least - 2]
                    for anchor, x, p, k, i, j in zip(low[first].tolist(), first.tolist(), (place[first] - first).tolist(), n.tolist(), begin.tolist(), finish.tolist(), strict=True):
                        yield row[at], copies[at], anchor, x, p, k, hashlib.blake2b(data[i:j], digest_size=16).digest()
                    at += 1

        return each

    schema = "row binary, copies long, anchor long, at int, anchor_at int, n int, key binary"
    return map_rows(touched.select("row", "text", "copies", "anchors"), schema, _PLACES, per_task, 4000)


def _with_words(passages: DataFrame, touched: DataFrame) -> DataFrame:
    """key, anchor, anchor_at, n, times, words (joined by a space); passages: the same without the words, and the place
    (row, at) of one occurrence.  Only places are shuffled: the texts lie in buckets by row."""

    def per_task():
        def each(batch):
            lists, at = batch.column(1), 0
            bound = lists.offsets.to_pylist()
            key, anchor, anchor_at, n, times, first = (lists.values.field(i).to_pylist() for i in range(6))
            for some in take_runs(batch.column(0)):
                own = Words(some)
                for a, b in own:
                    data, start, end = own.joined(a, b)
                    for i in range(bound[at], bound[at + 1]):
                        yield key[i], anchor[i], anchor_at[i], n[i], times[i], data[start[first[i]] : end[first[i] + n[i] - 1]]
                    at += 1

        return each

    asked = passages.groupBy("place.row").agg(F.collect_list(F.struct("key", "anchor", "anchor_at", "n", "times", "place.at")).alias("asked"))
    schema = "key binary, anchor long, anchor_at int, n int, times long, words binary"
    return map_rows(touched.select("row", "text").join(asked, "row").select("text", "asked"), schema, _PASSAGES, per_task, 2000)


def judge(held: list[tuple[bytes, bytes, int]], least: int) -> Iterator[tuple[bytes, bytes]]:
    """(key, flags) of the passages (key, words, times) of some anchors that have a repeated window."""
    numbers: dict[bytes, int] = {}
    automaton, sequences = SuffixAutomaton(), []
    for key, data, times in held:
        sequence = [numbers.setdefault(w, len(numbers)) for w in data.split(b" ")]
        automaton.add([*sequence, SEPARATOR], times)
        sequences.append((key, sequence))
    automaton.finish()
    for key, sequence in sequences:
        flags = np.array(automaton.statistics(sequence)[least - 1 :]) >= least
        if flags.any():
            yield key, flags.astype(np.uint8).tobytes()


def repeated_windows(passages: DataFrame, touched: DataFrame, least: int) -> DataFrame:
    """key, flags: which windows of a passage occur twice; passages: key, anchor, anchor_at, n, times, place (row and at
    of one occurrence); touched: row, text.  Passages without a repeated window are left out.  The only passage of an
    anchor needs no automaton: all of it is repeated when it occurs twice, and nothing of it otherwise."""
    groups = passages.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select("anchor")
    crowd = materialise(groups, "crowded-anchors")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[bytes, bytes, int]] = []
        own: list[tuple[bytes, bytes, int]] = []  # of the anchor that is being read
        size, last, out = 0, None, []

        def settle():
            nonlocal size
            if len(own) == 1:
                key, n, times = own[0][0], own[0][1].count(b" ") + 1, own[0][2]
                if times > 1:
                    out.append((key, b"\1" * (n - least + 1)))
            else:
                shard.extend(own)
                size += sum(x[1].count(b" ") + 1 for x in own)
            own.clear()
            if size >= SHARD_WORDS:
                out.extend(judge(shard, least))
                shard.clear()
                size = 0

        for batch in batches:
            for key, anchor, data, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last:
                    settle()
                own.append((key, data, times))
                last = anchor
                if len(out) >= 1000:
                    yield batches_of(out, _FLAGS)
                    out.clear()
        settle()
        out.extend(judge(shard, least))
        if out:
            yield batches_of(out, _FLAGS)

    calm = _with_words(passages.join(crowd, "anchor", "left_anti"), touched).select("key", "anchor", "words", "times")
    judged = calm.repartition("anchor").sortWithinPartitions("anchor", "key").mapInArrow(shards, "key binary, flags binary")
    crowded = _with_words(passages.join(crowd, "anchor", "left_semi"), touched)
    return judged.unionByName(_descend(_with_ends(crowded), least))


def _with_ends(passages: DataFrame) -> DataFrame:
    """key, anchor_at, n, times, words, off: where each word starts in the words, and where one behind them would."""
    schema = pa.schema([("key", pa.binary()), ("anchor_at", pa.int32()), ("n", pa.int32()), ("times", pa.int64()), ("words", pa.binary()), ("off", pa.list_(pa.int32()))])

    def per_task():
        def each(batch):
            for key, at, n, times, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
                yield key, at, n, times, data, np.concatenate([[0], spaces, [len(data) + 1]]).astype(np.int32)

        return each

    out = "key binary, anchor_at int, n int, times long, words binary, off array<int>"
    return map_rows(passages.select("key", "anchor_at", "n", "times", "words"), out, schema, per_task, 1000)


def _descend(passages: DataFrame, least: int) -> DataFrame:
    """key, flags of the passages of crowded anchors.

    A passage's windows are halved again and again by where the anchor stands in them (places 0-15, 16-31; then groups
    of 4; then single ones), so that equal windows stay in equal groups.  A group whose words occur twice is done: all
    its windows do (one of its kind goes on as a witness for windows that others share with it).  A group whose core (the words that all windows of its place share) occurs once is done too: none
    does.  Only the others, around the ends of what is common, go on.
    """
    passages = materialise(passages, "crowded-passages")
    now = passages.select("key", F.lit(False).alias("witness"), "times", F.lit(0).alias("x"), F.expr(f"n - {least}").alias("y"))
    hits = None
    for w in (16, 4, 1):  # only names, places and digests of groups are shuffled; words stay with their passage
        groups = now.join(passages.select("key", "words", "off", "anchor_at"), "key")
        groups = groups.select("*", F.explode(F.expr(f"sequence((anchor_at - y) div {w}, (anchor_at - x) div {w})")).alias("g"))
        x = F.expr(f"cast(greatest(x, anchor_at - g * {w} - {w - 1}) as int)").alias("x")
        y = F.expr(f"cast(least(y, anchor_at - g * {w}) as int)").alias("y")
        groups = groups.select("key", "witness", "times", "words", "off", x, y, F.expr(f"cast(anchor_at - g * {w} as int)").alias("s"))
        whole = F.expr(f"unhex(sha2(substring(words, off[x] + 1, off[y + {least}] - off[x] - 1), 256))").alias("whole")
        core = F.expr(f"unhex(sha2(substring(words, off[s] + 1, off[s + {least - w + 1}] - off[s] - 1), 256))").alias("core")
        groups = materialise(groups.select("key", "witness", "times", "x", "y", whole, core), "window-groups")
        # counts are written before they are joined, so that a join's large side can be split where a key is common
        whole = materialise(groups.groupBy("whole").agg(F.sum("times").alias("n")).where("n > 1").select("whole", F.lit(True).alias("done")), "whole")
        core = materialise(groups.groupBy("core").agg(F.sum("times").alias("n")).where("n > 1").select("core"), "core")
        judged = groups.join(whole, "whole", "left").join(core, "core", "left_semi")
        judged = materialise(judged.select("key", "witness", "times", "x", "y", "whole", "done"), "judged-groups")
        found = judged.where("done and not witness").select("key", "x", "y")
        hits = found if hits is None else hits.unionByName(found)
        one = judged.where("done").groupBy("whole").agg(F.min(F.struct("key", "x", "y")).alias("r"))
        witness = one.select("r.key", F.lit(True).alias("witness"), F.lit(2).cast("long").alias("times"), "r.x", "r.y")
        now = judged.where("done is null").select("key", "witness", "times", "x", "y").unionByName(witness)
    spans = hits.groupBy("key").agg(F.collect_list(F.struct("x", "y")).alias("spans"))
    bits = F.expr(f"unhex(array_join(transform(sequence(0, n - {least}), i -> if(exists(spans, s -> i between s.x and s.y), '01', '00')), ''))")
    return passages.select("key", "n").join(spans, "key").select("key", bits.alias("flags"))


def _removed(n: int, found: list[dict], least: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for x in found:
        at = x["at"] + np.flatnonzero(np.frombuffer(x["flags"], np.uint8))
        edge[at] += 1
        edge[np.minimum(at + least, n)] -= 1
    return np.cumsum(edge)[:n] > 0


def _without(data: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The words that are not gone, joined by a space."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))
    return b" ".join([data[start[a] : end[b - 1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])


def remove_repeats(docs: DataFrame, least: int = 35, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space); with texts=True also `kept`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _rows(docs, id_col, text_col)
    scanned = materialise(_scanned(rows, least, texts), "scanned")
    anchors = scanned.select("row", F.explode("anchors").alias("anchor"))
    twice = materialise(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    wanted = anchors.join(twice, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    once = rows.groupBy("row").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    touched = bucketed(once.join(wanted, "row"), "touched", "row")
    occurrences = materialise(_passage_rows(touched, least), "passages")
    first = [F.first(c).alias(c) for c in ("anchor", "anchor_at", "n")]
    passages = occurrences.groupBy("key").agg(*first, F.sum("copies").alias("times"), F.first(F.struct("row", "at")).alias("place"))
    flags = materialise(repeated_windows(materialise(passages, "distinct-passages"), touched, least), "flags")
    found = occurrences.select("row", "at", "key").join(flags, "key").groupBy("row").agg(F.collect_set(F.struct("at", "flags")).alias("found"))
    hit = touched.select("row", "text").join(found, "row")

    def per_task():
        def each(batch):
            row, hits, at = batch.column(0).to_pylist(), batch.column(2), 0
            for some in take_runs(batch.column(1)):
                own = Words(some)
                for a, b in own:
                    gone = _removed(b - a, hits[at].as_py(), least)
                    kept = _without(*own.joined(a, b), gone)
                    yield row[at], int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if texts else None
                    at += 1

        return each

    result = "row binary, n_removed long, kept_sha256 string, kept string"
    changed = materialise(map_rows(hit.select("row", "text", "found"), result, _CHANGED, per_task, 500), "changed")
    both = scanned.drop("anchors").alias("s").join(changed.alias("c"), "row", "left")
    new = [F.coalesce(f"c.{c}", f"s.{c}").alias(c) for c in ("n_removed", "kept_sha256", *(["kept"] if texts else []))]
    return both.select("s.doc_id", "s.n_words", *new)
