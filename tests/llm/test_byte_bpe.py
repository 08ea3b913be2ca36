"""Byte-level BPE against the library, against plain merging, and round trips."""

import base64
import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinlens.llm import bytebpe
from twinlens.llm import queries as Q

import public_tokenizers

FILE = Q.tokenizer_path(Q.BYTE_RANKS)
RANKS = bytebpe.load(FILE)
ENCODER = bytebpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def plain(word, of):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(of[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in of]
        if not found:
            return [of[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_query(spark, sf, library):
    got = Q.op13_byte_bpe(spark, sf).toPandas().set_index("doc_id")
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for i, text in docs:
        want = library.encode_ordinary(text)
        row = got.loc[i]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["round_trip"]


LONG_TEXTS = ["a" * 5000, "ab" * 3000, " " * 4000, "\n\n \t x" * 50, "é" * 2000, "hello" * 700, "x" * 65, "x" * 64, "日本語" * 300, "don't WE'LL 12345 \x1c\x85　z"]


def test_long_words(library):
    for text, got in zip(LONG_TEXTS, ENCODER.encode(LONG_TEXTS), strict=True):
        assert ids(got) == library.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn", "Co")), max_size=60), max_size=6))
def test_any_text(library, texts):
    texts = [t for t in texts if all(ord(c) < 0x500 for c in t)]
    coded = ENCODER.encode(texts)
    assert [ids(c) for c in coded] == [library.encode_ordinary(t) for t in texts]
    assert [b.decode() for b in ENCODER.decode(coded)] == texts


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=30))
def test_both_trees_equal_plain_merging(words):
    """Few tokens, so that equal ranks and overlapping pairs are common."""
    words = [bytes(b % 3 for b in w) for w in words]
    of = {bytes([b]): b for b in range(256)}
    for k, token in enumerate([b"\0\0", b"\0\1", b"\0\0\0\0", b"\1\0\0", b"\2\2", b"\0\1\0\1", b"\2\2\2"]):
        of[token] = 256 + k
    pairs = {of[t[:k]] << 32 | of[t[k:]]: r for t, r in of.items() for k in range(1, len(t)) if t[:k] in of and t[k:] in of}
    text = [t for t, _ in sorted(of.items(), key=lambda x: x[1])]
    keys = np.array(sorted(pairs))
    ranks = bytebpe.Ranks(of, np.arange(256), keys, np.array([pairs[p] for p in keys.tolist()]), text)
    want = [plain(w, of) for w in words]
    assert [ids(x) for x in bytebpe.merge_together(words, 64, ranks)] == want
    assert [ids(bytebpe.merge_alone(w, ranks)) for w in words] == want


def test_edges(spark):
    rows = [(1, None, "k"), (1, "", None), (None, "two\nlines", "x"), (3, "same", "x"), (3, "same", "x"), (4, "y" * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bytebpe.checked(docs, FILE, public_tokenizers.PATTERN, ["doc_id", "n_tokens"])
    assert got.columns == ["doc_id", "n_tokens", "_n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
    assert got.count() == 6 and got.where("round_trip").count() == 6
    assert got.where("_n_tokens = 0").count() == 2
    assert bytebpe.checked(docs.limit(0), FILE, public_tokenizers.PATTERN, ["doc_id"]).count() == 0
    coded = bytebpe.encode(docs, FILE, public_tokenizers.PATTERN, ["doc_id", "text"])
    back = bytebpe.decode(coded, FILE, ["doc_id", "text"])
    assert back.where(F.coalesce("text", F.lit("")) != F.col("bytes").cast("string")).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert {r["k"]: r["bytes"] for r in bytebpe.decode(nulls, FILE, ["k"]).collect()} == {1: None, 2: b""}
