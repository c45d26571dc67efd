"""Operator 13 against a trie in dictionaries and its SQL."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import duckdb
import pytest

from loomgraph.llm import conversation_trie as op
from loomgraph.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, p1 long, d string"


def ordered(rows):
    """conv_id -> list of (role, text), ties by the digest the operator takes."""
    out: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out.setdefault(c, []).append(((turn is not None, turn or 0), int(sha[:15], 16), int(sha[15:30], 16), role, text))
    return {c: [r[3:] for r in sorted(turns)] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def plain(convs):
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in own) or 1
        saved[node] = sum(saved[k] for k in own) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    rows = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        rows.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, rows))


def crafted(seed, n, long=()):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8, 12])):
            rows.append((c * rnd.choice([1, 1, 3]) if c else 0, rnd.choice([t, t, None]) if rnd.random() < 0.2 else t, rnd.choice(["user", "bot", None]), rnd.choice(["a", "é", "", None, f"x{rnd.randrange(9)}"])))
    for c, m in long:
        rows += [(c, t, "user", f"{t % 7}") for t in range(m)]
    return [*rows, (None, 1, "user", "lost")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("cells,block", [(1 << 25, 4096), (64, 7), (1 << 16, 3)])
def test_against_dictionaries(spark, monkeypatch, cells, block):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "IDS", 4)
    monkeypatch.setattr(op, "PART", 32 if cells == 64 else 1 << 16)
    rows = crafted(block, 60, long=[(1000, 90), (1003, 90), (1004, 41)])
    df = frame(spark, rows)
    assert got(op.conversation_trie(df, cells)) == plain(ordered(rows))
    assert got(op.prefix_trie(*op.rebuilt(op.numbered_turns(df)), cells)) == plain(rebuilt(ordered(rows)))


def test_copies_and_turnless(spark):
    same = [(c, t, "user", "hello" * t) for c in range(40) for t in range(3)]
    assert got(op.conversation_trie(frame(spark, same))) == plain(ordered(same))
    # 1 % 5 leads to a conversation that isn't there: with h above its length nothing is left
    lone = [(c, 0, "user", "x") for c in range(1, 5)]
    want = plain(rebuilt(ordered(lone)))
    assert got(op.prefix_trie(*op.rebuilt(op.numbered_turns(frame(spark, lone))))) == want
    one = [(3, 0, None, None)]
    assert got(op.conversation_trie(frame(spark, one))) == plain(ordered(one))


def test_empty(spark):
    df = frame(spark, [(None, 1, "a", "b")])
    assert op.conversation_trie(df).count() == 0
    assert op.prefix_trie(*op.rebuilt(op.numbered_turns(df.limit(0)))).columns == COLUMNS


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    sql = con.sql(ORACLE_SQL["op13_conversation_trie"])
    want = sorted(repr(tuple(r)) for r in sql.select(*COLUMNS).fetchall())
    source = con.sql("select conv_id, turn, role, text from conversations").fetchall()
    assert want == plain(rebuilt(ordered(source)))
    assert got(QUERIES["op13_conversation_trie"](spark, sf)) == want
