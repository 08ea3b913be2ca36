"""The conversation trie against one that is built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from twinlens.llm import queries as Q
from twinlens.llm import turns as T

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: [(role, text), ...]}."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        last = len(node[-1][1]) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[k] for k in below)
    out = []
    for node, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(kids[node]), leaves[node], saved[node], digest))
    return sorted(map(repr, out))


def rows_of(df):
    assert set(NAMES) <= set(df.columns)
    assert all(t == "bigint" for c, t in df.dtypes if c in NAMES and c != "ends_sha256")
    return sorted(repr(tuple(r)) for r in df.select(*NAMES).collect())


def test_query(spark, sf):
    convs = rebuilt(duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall())
    assert rows_of(Q.op12_conversation_trie(spark, sf)) == plain_trie(convs)


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(95, 135), 200, 305, 306, 999_999_999_999]:
        path = ["a"] * rng.choice([0, 3, 7, 8]) if rng.random() < 0.6 else []
        path += [rng.choice("abé") for _ in range(rng.randrange(0, 11))]
        for k, text in enumerate(path):
            rows.append((c, k if k else None, rng.choice(["user", "user", None]), text * rng.choice([1, 1, 2]) if rng.random() < 0.9 else None))
    hot = [(5000 + i, k, "user", f"turn {k}") for i in range(120) for k in range(9)]  # equal but for their heads
    long = [(400, k, "user", f"w{k % 3}") for k in range(300)]  # a third of all turns
    rows += hot + long + [(7, 3, "user", "x")] * 3 + [(None, 0, "user", "gone")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_against_plain_trie(spark, block, monkeypatch):
    monkeypatch.setattr(T, "ID_TEXT", 20)
    monkeypatch.setattr("twinlens.operators.hotkeys.LEAST_ROWS", 20)
    rows = made(block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert rows_of(T.trie(*T.grafted(T.ordered(df)), block)) == plain_trie(rebuilt(rows))


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, hi string"
    empty = spark.createDataFrame([], schema)
    assert T.trie(*T.grafted(T.ordered(empty))).count() == 0
    rows = [(1, 0, "u", "t"), (2, 0, "u", "t")]  # each takes its first turn from conversation 0, which isn't there
    found = T.trie(*T.grafted(T.ordered(spark.createDataFrame([(*r, "x") for r in rows], schema))))
    assert rows_of(found) == plain_trie(rebuilt(rows))
    # without rebuilding, and with ids that have no turns
    turns = T.ordered(spark.createDataFrame([(*r, "x") for r in rows], schema))
    ids = spark.createDataFrame([(i,) for i in (1, 2, 9)], "conv_id long")
    got = {r["depth"]: r for r in T.trie(turns, ids).collect()}
    assert len(got) == 2 and got[0]["n_convs"] == 3 and got[1]["n_convs"] == 2 and got[1]["n_leaves"] == 1
    assert got[0]["ends_sha256"] == hashlib.sha256(b"9").hexdigest()
