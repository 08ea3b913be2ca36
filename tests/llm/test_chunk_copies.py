"""Chunks against brute force over all texts, and insertions where there is no white space."""

import random

import duckdb
import pytest

from twinlens.llm import chunks
from twinlens.llm import queries as Q


def parts_of(raw):
    return [(int(a), int(b)) for _, a, b in zip(*chunks.cuts([raw]), strict=True)]


def expected(docs):
    """Texts without later copies: each text cut by itself, chunks compared as bytes."""
    order = sorted((i for i, t in docs.items() if t), key=lambda i: i)
    seen, out = set(), {}
    for i in order:
        raw, copies = docs[i].encode(), []
        for a, b in parts_of(raw):
            if raw[a:b] in seen:
                copies.append({"start": a, "end": b})
            seen.add(raw[a:b])
        out[i] = chunks.without(docs[i], copies, chunks.LEAST_BYTES)
    return out | {i: (t, 0) for i, t in docs.items() if not t}


def test_query_against_all_texts(spark, sf):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = {r["doc_id"]: (r["text"], r["removed_bytes"]) for r in Q.op6_content_chunks(spark, sf).collect()}
    assert got == expected(docs) and sum(n for _, n in got.values()) > 1000


def test_a_chunk_in_a_third_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr("twinlens.operators.hotkeys.LEAST_ROWS", 10)
    monkeypatch.setattr(chunks, "GATHERED", 64)
    monkeypatch.setattr(chunks, "MAP_BITS", 64)  # full: all chunks pass, the result is the same
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    common = prose(80)
    docs = {i: f"{prose(30)} {common} {prose(30)}" if i % 3 == 0 else prose(40) for i in range(150)}
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, digest string").repartition(6)
    got = {r["doc_id"]: (r["text"], r["removed_bytes"]) for r in chunks.deduplicate(rows).collect()}
    assert got == expected(docs)
    assert sum(n > 400 for _, n in got.values()) == 49


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфх", "語文字漢日本"])
def test_insertion_without_white_space(letters):
    r = random.Random(7)
    text = "".join(r.choice(letters) for _ in range(20_000))
    own = lambda t: [t.encode()[a:b] for a, b in parts_of(t.encode())]
    before, after = own(text), set(own(text[:5000] + "x" + letters[0] + "y" + text[5000:]))
    assert sum(c in after for c in before) >= 0.98 * len(before)
    assert b"".join(before).decode() == text and max(map(len, before)) <= 4 * 2 * chunks.STRETCH


@pytest.mark.parametrize("text", ["x" * 50_000, "ab" * 20_000, "\0" * 900, "é" * 5000])
def test_repeating_characters(text):
    parts = parts_of(text.encode())
    assert parts[0][0] == 0 and parts[-1][1] == len(text.encode()) and all(b == c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))
    assert max(b - a for a, b in parts) <= 8 * chunks.STRETCH and len(parts) < len(text) / 8
