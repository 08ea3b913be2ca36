"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinlens.llm import binary, chunks, langmix, licences, mtree, ordinal, pieces, simhash, tiling, trees
from twinlens.llm import queries as Q

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, severity double, _text string, component string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    passage = prose(99, 70)
    texts = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "12 34 !!"), (5, prose(5, 120)), (6, prose(5, 120)), (6, prose(5, 120)), (None, prose(7, 60)),
        (None, None), (8, prose(8, 30000)), (9, "語" * 3000), (10, prose(10, 60) + "\n" + passage + "\n" + prose(11, 60)),
        (11, prose(12, 60) + "\n" + passage + "\n" + prose(13, 60)), (12, "x" * 50000), (13, "a\u0000b ▁ c"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, "n", None) for i, t in texts], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def test_language_edges(odd, none):
    model = langmix.learn(odd)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langmix.predict(odd, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (5, "en", 1.0)} <= got
    assert langmix.predict(odd, langmix.learn(none)).where("lang_pred <> 'und'").count() == 0
    assert langmix.predict(none, model).count() == 0


def test_language_mixture_of_two(spark):
    docs = duckdb.sql("SELECT lang, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) BETWEEN 1200 AND 4000 ORDER BY doc_id").df()
    model = langmix.learn(spark.createDataFrame(docs, "lang string, text string"))
    de, fr = (docs[docs["lang"] == x]["text"].iloc[0][:1200] for x in ("de", "fr"))
    share, _ = langmix.mixtures([de + "\n" + fr, de], model)
    named = dict(zip(model.languages, share[0], strict=True))
    assert named["de"] == pytest.approx(0.5, abs=0.1) and named["fr"] == pytest.approx(0.5, abs=0.1)
    assert (share[1] > 0).sum() == 1


def test_tiling_edges(spark, odd, none):
    item = prose(20, 40).split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    moved = " ".join(item[20:] + ["other", "words"] + item[:20])
    docs = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit(moved)))
    got = {r["doc_id"]: r for r in tiling.contamination(docs, bench, ["doc_id"]).where("contaminated").collect()}
    assert set(got) == {50} and got[50]["hits"][0]["item"] == 1 and got[50]["coverage"] == 1.0
    assert tiling.clean(docs, bench).count() == docs.count() - 1
    small = tiling.contamination(docs, bench, ["doc_id"], block_words=10).where("contaminated").collect()
    assert [(r["doc_id"], r["coverage"]) for r in small] == [(50, 1.0)]
    assert tiling.clean(none, bench).count() == 0
    assert tiling.contamination(odd, bench.limit(0), ["doc_id"]).where("contaminated").count() == 0


def test_pieces_edges(odd, none):
    path = Q.tokenizer_path(Q.PIECE_MODEL)
    got = pieces.checked(odd, path, ["doc_id"], with_ids=True).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if not r["round_trip"]} == {13}  # holds the space mark itself
    assert all(r["n_ids"] == 0 for r in got if r["doc_id"] in (1, 2))
    coded = pieces.encode(odd, path, ["doc_id"])
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(coded.where("doc_id in (5, 9, 12)"), path, ["doc_id"]).collect()}
    assert back[9] == "語" * 3000 and back[12] == "x" * 50000 and back[5] == prose(5, 120)
    assert pieces.checked(none, path, ["doc_id"]).count() == 0


def test_ordinal_edges(spark, odd, none):
    r = np.random.default_rng(1)
    rows = [(i, prose(100 + i, 30) + (" vile" if g else "") + (" awful" if g == 2 else ""), int(g)) for i, g in enumerate(r.integers(0, 3, 300))]
    labelled = spark.createDataFrame([*rows, (999, None, 1), (998, "x", None)], "doc_id long, text string, grade int")
    model = ordinal.fit(labelled)
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == 2
    got = ordinal.predict(labelled.where("doc_id < 300"), model, ["doc_id", "grade"]).toPandas()
    means = got.groupby("grade")["severity"].mean()
    assert means[0] < 0.35 and 0.6 < means[1] < 1.4 and means[2] > 1.6
    scored = ordinal.predict(odd, model, odd.columns, out="_severity")
    assert scored.count() == odd.count() and scored.where("_severity is null").count() == 0
    empty = ordinal.fit(labelled.limit(0))
    assert ordinal.predict(odd, empty, ["doc_id"]).where("severity > 0.001").count() == 0
    assert ordinal.predict(none, model, ["doc_id"]).count() == 0


def test_trees_edges(spark, odd, none):
    x = np.random.default_rng(2).normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    assert ((trees.score_arrays(trees.fit_arrays(x, y), x) > 0.5) == y).mean() > 0.97
    model = trees.fit(odd.withColumn("quality", (F.length("text") > 200).cast("int")))
    got = trees.predict(odd, model, odd.columns)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert trees.predict(odd, trees.fit(none.withColumn("quality", F.lit(1))), ["doc_id"]).where("score <> 0.5").count() == 0
    assert trees.predict(none, model, ["doc_id"]).count() == 0


def test_chunks_edges(odd, none):
    got = chunks.deduplicate(odd).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[1]["text"] is None and by_id[2]["text"] == "" and by_id[8]["removed_bytes"] == 0
    assert by_id[5]["removed_bytes"] == 0 and by_id[6]["text"] == ""
    assert [r["text"] for r in got if r["doc_id"] == 6] == ["", ""]
    passage = prose(99, 70)
    assert by_id[10]["removed_bytes"] == 0
    left = by_id[11]["text"]
    assert len(passage) * 0.6 < by_id[11]["removed_bytes"] <= len(passage) + 2
    assert left.startswith(prose(12, 60)[:300]) and left.endswith(prose(13, 60)[-300:])
    assert chunks.deduplicate(none).count() == 0


def test_chunks_cover_texts_and_resist_shifts():
    for text in (prose(1, 3000), "語" * 999, "é" * 2000 + prose(3, 50), "", " ", "\u0000" * 700):
        raw = text.encode()
        doc, start, end = chunks.cuts([b"before " * 9, raw, b"after"])
        own = doc == 1
        assert b"".join(raw[a:b] for a, b in zip(start[own], end[own], strict=True)) == raw
        for a in start[own]:
            assert (raw[a] & 0xC0) != 0x80
    plain = prose(1, 3000).encode()
    pieces_of = lambda raw: {raw[a:b] for _, a, b in zip(*chunks.cuts([raw]), strict=True)}
    shifted = plain[:5000] + b"something put in " + plain[5000:]
    assert len(pieces_of(plain) - pieces_of(shifted)) <= 4


def test_token_file_edges(spark, odd, none, tmp_path):
    path = Q.tokenizer_path(Q.WORD_MODEL)
    got = binary.round_trip(odd, path, 1).orderBy("start").collect()
    assert len(got) == odd.count()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2))
    assert binary.round_trip(none, path, 1).count() == 0


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = Q.tokenizer_path(Q.WORD_MODEL)
    own, library = binary.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["It's DON'T, x,'s ...", "a<|endoftext|>b <|STARTOFTEXT|> <|", "Straße É́x y", "H̱ ΣΑΣ İ", "a\x1cb\x85c", "₂x²,3.5%$#!!", "(foo)|bar|", "👍🏽ok."]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.width).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_licence_edges(spark, odd, none):
    mit = licences._MIT.replace("<year> <holder>", "2020 Someone").upper().replace(",", " ;")
    docs = odd.limit(1).withColumns({"doc_id": F.lit(60).cast("long"), "text": F.lit(mit)}).unionByName(odd)
    got = licences.scan(docs).collect()
    assert [(r["doc_id"], r["licence"], r["whole_text"]) for r in got] == [(60, "MIT", True)]
    assert licences.scan(none).count() == 0 and licences.scan(docs, licences.known_licences(spark).limit(0)).count() == 0


def test_simhash_edges(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r["fp"] == 0]
    assert {r["component_id"] for r in zero} == {1} and {r["doc_id"] for r in zero} >= {1, 2, 3}
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("distance", [1, 3, 6])
def test_links_by_brute_force(spark, distance):
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(150)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 8))) for b in base for _ in range(3)]
    values = sorted({int(np.uint64(v).view(np.int64)) for v in base + near})
    got = {(x["u"], x["v"]) for x in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), distance).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for k, b in enumerate(values) for a in values[:k] if ((a ^ b) & mask).bit_count() <= distance}
    assert got == want


def test_top_k_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (20, []), (40, [0.5])]
    index = mtree.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in mtree.search(index, index.rows.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 5, 20480), (0, 2, 6, 20480), (0, 3, 40, 2048)]
    assert got[3:6] == [(20, 1, 0, 0), (20, 2, 5, 0), (20, 3, 6, 0)]
    empty = mtree.build(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert mtree.search(empty, empty.rows).count() == 0


def test_top_k_with_one_common_vector(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SLICE_ROWS", 300)
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (1500, 8)).astype(np.float32)
    x[500:1000] = x[0]
    index = mtree.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    got = mtree.search(index, index.rows.where("vec_id % 100 = 0")).toPandas()
    y = np.floor(64 * x.astype(float))
    for q in range(0, 1500, 100):
        score = y @ y[q]
        want = [i for i in sorted(range(1500), key=lambda i: (-score[i], i)) if i != q][:20]
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == want


def test_stages(spark, odd, sf):
    """Every stage keeps the columns and the clean documents, on odd input and on none."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), sf).count() == 0, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids >= {5, 8, 9, 10, 11, 12} and 6 not in ids and len(ids & {1, 2, 3}) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
