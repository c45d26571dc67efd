"""The lexical shape of source text: comments, strings, templates and regular expressions told apart from code, and the
tree of its brackets.

`lexed` is the one step that runs in Python: a scanner with a stack, batch by batch inside the tasks, in time in proportion
to the text.  All that is read from its result is expressions on columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_CODE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|[`(\[{)\]}/]|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|\s+|.", re.S)
_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_VISIBLE = re.compile(r"\S")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
#: Words behind which a slash begins a regular expression.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())

_NEST = pa.struct([("parent", pa.int32()), ("mark", pa.string()), ("at", pa.int32()), ("line", pa.int32()), ("end_at", pa.int32()), ("end_line", pa.int32()), ("own", pa.string()), ("last", pa.int32())])
NESTS = "array<struct<parent:int,mark:string,at:int,line:int,end_at:int,end_line:int,own:string,last:int>>"


def scan(text: str) -> tuple[str, str, list[tuple]]:
    """(code, own, nests) of a text.

    code: the text with comments, the insides of strings, templates and regular expressions blanked, at the same places;
    `${` and `}` of a template become round brackets.  nests: the pairs of brackets, the strings and the templates in the
    order they open, as (parent, mark, at, line, end_at, end_line, own, last); places and lines count from 1; last: the number of
    the last nest inside, which are all from the next one on.  own: what stands
    directly inside, each nest in it given by its number between its marks, as in `f(3) {4}`, with a control character (1)
    before the number, which no text keeps; a string's own text is what it says.  The first own text is that of the whole.  A closing bracket that nothing opened is left alone, what is never
    closed ends with the text.
    """
    code: list[str] = []
    nests: list[list] = []
    top: list[str] = []
    stack: list[tuple[int, str, list[str]]] = [(-1, "", top)]  # number, what closes it, own text
    at, line, before = 0, 1, ""

    def opened(mark: str, closes: str) -> None:
        nests.append([stack[-1][0], mark, at + 1, line, len(text), 0, "", 0])
        stack[-1][2].append(f"{mark}\x01{len(nests) - 1}{_CLOSES.get(mark, mark)}")
        stack.append((len(nests) - 1, closes, []))

    def closed() -> None:
        number, _, own = stack.pop()
        nests[number][4:] = [at + 1, line, "".join(own), len(nests) - 1]

    while at < len(text):
        if stack[-1][1] == "`":  # in a template's text
            token = _TEXT.match(text, at)[0]
            code.append(_VISIBLE.sub(" ", token))
            stack[-1][2].append("\n" * token.count("\n"))
            at, line = at + len(token), line + token.count("\n")
            if text.startswith("${", at):
                code.append(" (")
                at += 1
                opened("{", "$}")
                before = "("
            elif at < len(text):
                code.append("`" if text[at] == "`" else " ")
                if text[at] == "`":
                    closed()
                    before = ")"
            at += 1
            continue
        token = _CODE.match(text, at)[0]
        first = token[0]
        shown = token
        if token[:2] in ("//", "/*") and len(token) > 1:
            shown = _VISIBLE.sub(" ", token)
            stack[-1][2].append(shown)
        elif first in "'\"" and len(token) > 1:
            shown = first + _VISIBLE.sub(" ", token[1:-1]) + first
            nests.append([stack[-1][0], first, at + 1, line, at + len(token), line + token.count("\n"), token[1:-1], len(nests)])
            stack[-1][2].append(f"{first}\x01{len(nests) - 1}{first}")
            before = ")"
        elif token == "`":
            opened("`", "`")
        elif token in _CLOSES:
            opened(token, _CLOSES[token])
            before = token
        elif token in ")]}":
            if any(s[1][-1:] == token for s in stack):
                while stack[-1][1][-1:] != token:
                    closed()
                if stack[-1][1] == "$}":
                    shown = ")"
                closed()
            before = ")"
        elif token == "/":
            pattern = _PATTERN.match(text, at) if not before or before in _BEFORE_PATTERN or not (before == ")" or before[-1].isalnum() or before[-1] in "_$") else None
            if pattern:
                token, shown = pattern[0], " " * len(pattern[0])
                before = ")"
            else:
                before = token
            stack[-1][2].append(shown)
        else:
            stack[-1][2].append(token if token != "\x01" else " ")
            if not token.isspace():
                before = token
        code.append(shown)
        at, line = at + len(token), line + token.count("\n")
    at = len(text) - 1
    while len(stack) > 1:
        closed()
    return "".join(code), "".join(top), nests


def lexed(files: DataFrame) -> DataFrame:
    """scan_id, file_path, content with code, own and nests of each text (see `scan`); a null content counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                code, own, nests = zip(*(scan(t or "") for t in some.column("content").to_pylist()), strict=True)
                rows = pa.array([[dict(zip(_NEST.names, n, strict=True)) for n in x] for x in nests], pa.list_(_NEST))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(code, pa.string()), pa.array(own, pa.string()), rows], names=[*some.schema.names, "code", "own", "nests"])

    rows = files.select("scan_id", "file_path", "content")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(each, f"{kinds}, code string, own string, nests {NESTS}")
