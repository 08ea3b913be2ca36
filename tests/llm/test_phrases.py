"""Collocations against plain counting, and the parse's own promises."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import oracle
from twinlens.llm import phrases as P
from twinlens.llm import queries as Q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(texts):
    out = Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            for size in (1, 2, 3):
                out.update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
    return out


def chunks_of(texts, rate):
    _, (a, b), data = P.parse(texts, rate)
    return [data[x:y].tobytes().decode() for x, y in zip(a, b, strict=True)]


def counted(chunks):
    n = Counter(chunks)
    block = pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values())), pa.array([7] * len(n), pa.int64())], names=["chunk", "n", "seed"])
    g, out = P.Grams(block), Counter()
    for size in (1, 2, 3):
        for at in g.of(size)[0].tolist():
            out[g.data[g.start[at] : g.end[at + size - 1]].tobytes().decode()] += int(g.weight[g.chunk[at]])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abCé  \t.\n!", max_size=60)), max_size=12), st.sampled_from([1, 2, 4, 16]))
def test_every_occurrence_counts_once(texts, rate):
    assert counted(chunks_of(texts, rate)) == plain_counts(texts)


def test_shared_passages_are_cut_alike():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    shared = " ".join(word() for _ in range(400))
    chunks = Counter(chunks_of([" ".join([*(word() for _ in range(k)), shared, word()]) for k in range(20)], 16))
    assert sum(n for c, n in chunks.items() if n == 20) >= 20 * 15  # most of the shared part is in the dictionary once


def brute(rows, least, top):
    by = defaultdict(list)
    for lang, text in rows:
        by["und" if lang is None else lang].append(text)
    out = []
    for lang, texts in by.items():
        f = plain_counts(texts)
        n = sum(c for p, c in f.items() if " " not in p)
        found = {p: c for p, c in f.items() if " " in p and c >= least}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            longer = [c for q, c in found.items() if q != p and f" {p} " in f" {q} "]
            if any(100 * c >= 50 * a for c in longer):
                continue
            score, _, l, r = min((1000000 * a * a // (f[x] * f[y]), k, f[x], f[y]) for k in range(1, len(w)) for x, y in [(" ".join(w[:k]), " ".join(w[k:]))])
            kept.append((-score, -a, p.encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("rate,top", [(2, 2000), (16, 7)])
def test_against_plain_counting(spark, rate, top, monkeypatch):
    monkeypatch.setattr(P, "GATHERED", 50)
    monkeypatch.setattr("twinlens.operators.hotkeys.LEAST_ROWS", 5)
    rng = np.random.default_rng(rate)
    rows = [(rng.choice(["en", "de", ""]), " ".join(rng.choice(["of", "the", "One", "two", "x.", "y,", "é"], 30))) for _ in range(120)]
    rows += [("en", "new york city hall " * 20)] * 40 + [(None, "new york"), (None, None), ("en", None), ("en", ""), ("fr", "alone")]
    df = spark.createDataFrame([(str(a) if a is not None else None, b, "z") for a, b in rows], "lang string, text string, chunk string").repartition(4)
    got = P.collocations(df, top=top, rate=rate).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10, top)


def test_hashes_travel_in_few_bytes():
    rng = np.random.default_rng(5)
    key = np.unique(rng.integers(0, 1 << P.KEY_BITS, 1_000_000, dtype=np.uint64))
    n = rng.integers(1, 30, len(key))
    batch = P._packed(key, n, 1, 10)
    assert batch.nbytes < 5 * len(key)
    back, counts = P._unpacked(batch, 10)
    assert np.array_equal(back, key + np.uint64(1 << P.KEY_BITS)) and np.array_equal(counts, np.minimum(n, 10))


def test_frequent_hashes_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "GATHERED", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # buckets go on in the next batch
    try:
        rng = np.random.default_rng(6)
        texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], 30)) for _ in range(300)]
        chunks = spark.createDataFrame([(t + " \n\n", 1, 7) for t in texts], "chunk string, n long, seed long").repartition(9)
        both = lambda g: [(g.of(size)[1], g.weight[g.chunk[g.of(size)[0]]]) for size in (2, 3)]
        got = sorted(tuple(r) for r in P._frequent(chunks, both, 6).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    g = P.Grams(pa.RecordBatch.from_arrays([pa.array([t + " \n\n" for t in texts]), pa.array([1] * 300), pa.array([7] * 300, pa.int64())], names=["chunk", "n", "seed"]))
    want = [(kind, h & ((1 << P.KEY_BITS) - 1)) for kind, size in enumerate((2, 3)) for h, n in Counter(g.of(size)[1].tolist()).items() if n >= 6]
    assert got == sorted(want) and 0 < len(want) < 1600


def test_large_counts_are_exact(spark):
    row = spark.createDataFrame([(10**13 + 7, 3 * 10**13 + 1, 10**13 + 9)], "a long, l long, r long")
    a, l, r = row.first()
    assert row.select(P.score(row.a, row.l, row.r)).first()[0] == 1000000 * a * a // (l * r)


def test_edges(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(empty).count() == 0
    one = spark.createDataFrame([("en", "a b " * 60_000)], "lang string, text string")
    got = P.collocations(one).collect()
    assert [(r["phrase"], r["a"], r["n"]) for r in got] == [r[2:4] + r[6:7] for r in brute([("en", "a b " * 60_000)], 10, 2000)]


def test_query(spark, sf):
    got = Q.op11_phrase_collocations(spark, sf).toPandas()
    assert oracle.compare(got, oracle.connect(sf).execute(Q.COLLOCATIONS_SQL).df()) == []
