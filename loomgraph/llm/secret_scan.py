"""Secret scan by patterns and sliding-window entropy (operator 7).

Base spans, leftmost and non-overlapping per kind: assignments to a name of a secret, access keys, long hexadecimal
runs.  The method adds spans of kind `entropy`: in candidate strings (runs of the characters of tokens), the Shannon
entropy of a window slides along by adding one character's count and taking one away; stretches of windows above the
threshold of the string's character class are spans, unless the allow-list knows the string or a placeholder in the window.

Edge cases: null and empty texts have no spans; very long strings cost time in proportion to their length; repeated
rows are scanned each; positions are code points, ends exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
W = 20
#: Bits a character that a window must reach, by class of the string.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Strings that look random and aren't secrets: identifiers in a public form, plain words, rules.
ALLOWED = re.compile(
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
    r"|[A-Za-z]+|[a-z]+(?:[-_/][a-z]+)*|[-_=+/]+|[0-9]+"
)
#: Alphabets and placeholders; only the windows that overlap one are let off.
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|abcdefghij|0123456789|x{6,}")
_CLOGC = [0.0, *(n * log2(n) for n in range(1, W + 1))]


def character_class(text: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    return "alnum" if text.isalnum() else "base64"


def window_entropies(text: str, w: int = W):
    """(start, bits a character) of each window of w characters, by incremental counts."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _CLOGC[n + 1] - _CLOGC[n]
        counts[c] = n + 1
        if i >= w:
            old = text[i - w]
            n = counts[old]
            total += _CLOGC[n - 1] - _CLOGC[n]
            counts[old] = n - 1
        if i >= w - 1:
            yield i - w + 1, log2(w) - total / w
        if i == w - 1:
            continue


def entropy_spans(text: str) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        string = m[0]
        if ALLOWED.fullmatch(string):
            continue
        least = THRESHOLDS[character_class(string)]
        known = bytearray(len(string))
        for p in PLACEHOLDER.finditer(string):
            known[p.start() : p.end()] = b"\1" * (p.end() - p.start())
        for at, bits in window_entropies(string):
            if bits >= least and known.find(1, at, at + W) < 0:
                a, b = m.start() + at, m.start() + at + W
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
    return spans


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start, then kind as listed in KINDS."""
    if not text:
        return []
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += [("entropy", a, b) for a, b in entropy_spans(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64())]
    + [("base_sha256", pa.string()), ("spans", pa.string())]
)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 (of the base spans), spans (kind:start:end, comma-joined)."""

    def per_task():
        def each(batch):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = find_secrets(t)
                shown = [f"{k}:{a}:{b}" for k, a, b in found]
                base = ",".join(s for s, f in zip(shown, found, strict=True) if f[0] != "entropy")
                n = [sum(f[0] == k for f in found) for k in KINDS]
                yield d, *n, hashlib.sha256(base.encode()).hexdigest(), ",".join(shown)

        return each

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string", _FOUND, per_task)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span of the text replaced by the mark; null texts stay null."""
    import pandas as pd

    def cleaned(texts):
        return texts.map(lambda t: t if not isinstance(t, str) else redact(t, find_secrets(t), mark))

    cleaned.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    bounded_batches(docs.sparkSession)
    return docs.withColumn(text_col, F.pandas_udf(cleaned, "string")(F.col(text_col)))
