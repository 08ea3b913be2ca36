"""The registered queries against brute force on the small tables."""

import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import oracle
from twinlens.llm import queries as Q


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT * FROM '{sf}/documents.parquet' ORDER BY doc_id").df()


LARGER = "/root/testdata/sf0.01"  # models need more labelled rows than the smallest tables have


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language(spark, sf, docs):
    got = Q.op1_language_mixture(spark, sf).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    assert (got["held_out"] == got["doc_id"].map(lambda i: crc(i) % 4 == 2)).all()
    assert got["score"].between(0, 1).all()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_quality(spark):
    got = Q.op5_quality_trees(spark, LARGER).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: crc(i) % 5 == 0)).all()
    got = got.merge(duckdb.sql(f"SELECT * FROM '{LARGER}/labels.parquet'").df(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.85


def test_token_files(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.tokenizer_path(Q.WORD_MODEL))
    got = Q.op7_token_files(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    at = 0
    for row, text in zip(got.itertuples(), docs["text"], strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), row.doc_id
        at += len(ids)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def by_brute_force(fps):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_components(spark, sf, docs):
    got = Q.op9_simhash_components(spark, sf).toPandas().set_index("doc_id")
    fps = {i: fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert got["fingerprint"].to_dict() == {i: f"{f:016x}" for i, f in fps.items()}
    assert got["component_id"].to_dict() == by_brute_force(fps)


def test_top_k(spark, sf, con):
    got = Q.op10_mtree_top20(spark, sf).toPandas()
    assert oracle.compare(got, con.execute(Q.TOP_SQL).df()) == []


def test_licences(spark, sf, con):
    got = Q.op8_licence_digests(spark, sf).toPandas()
    assert len(got) and oracle.compare(got, con.execute(Q.licences.scan_sql()).df()) == []


def test_toxicity(spark):
    got = Q.op4_toxicity_grades(spark, LARGER).toPandas()
    assert len(got) == 1000 and got["severity"].between(0, 2).all()
    got = got.merge(duckdb.sql(f"SELECT * FROM '{LARGER}/labels.parquet'").df(), on="doc_id", suffixes=("", "_label"))
    assert (got["toxic"] == (got["toxic_label"] == 1)).mean() > 0.97


def words(text):
    return re.findall(r"\w+", text.lower())


def test_tiling(spark, sf, docs):
    got = Q.op2_string_tiling(spark, sf).toPandas().set_index("doc_id")
    items = {i: words(t) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()}
    seeds = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 4):
            seeds[tuple(w[k : k + 5])].add(i)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        w = words(text)
        near = set().union(*[seeds.get(tuple(w[k : k + 5]), ()) for k in range(len(w) - 4)])
        want = {i: c for i in near if (c := coverage(w, items[i])) >= 0.5}
        assert {h["item"]: h["coverage"] for h in got.loc[doc_id, "hits"]} == pytest.approx(want), doc_id


def coverage(doc, item, match=5):
    """Greedy string tiling as it is defined: scan for the longest unmarked match, mark it, again."""
    used_d, used_i, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (match - 1, 0, 0)
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not used_d[a + n] and not used_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < match:
            return covered / len(item)
        covered += n
        for k in range(n):
            used_d[a + k] = used_i[b + k] = True


def test_pieces(spark, sf, docs):
    import sentencepiece

    got = Q.op3_sentencepiece_viterbi(spark, sf).toPandas().set_index("doc_id")
    assert got["round_trip"].all() and len(got) == len(docs)
    sp = unigram(sentencepiece)
    scores = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    bytes_at = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    low = min(s for s, _ in scores.values()) - 10
    for i, t in list(zip(docs["doc_id"], docs["text"], strict=True))[:60]:
        ids = best_ids("▁" + t.replace(" ", "▁"), scores, bytes_at, low)
        assert got.loc[i, "ids_crc32"] == zlib.crc32(np.array(ids, "<i4").tobytes()), i


def best_ids(text, scores, bytes_at, low):
    """Plain Viterbi over a whole text; of equal sums the longer last piece."""
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            s, i = scores.get(text[start:end], (low, None) if end - start == 1 else (-np.inf, None))
            if best[start] + s > best[end]:
                best[end], back[end] = best[start] + s, (start, i)
    out, end = [], len(text)
    while end:
        start, i = back[end]
        out += [i] if i is not None else [bytes_at[b] for b in reversed(text[start:end].encode())]
        end = start
    return out[::-1]


def unigram(sentencepiece):
    """The library told to take the model file as a unigram model: field 2 of the file
    is the trainer's settings, whose field 3 is the kind (1: unigram)."""
    raw = open(Q.tokenizer_path(Q.PIECE_MODEL), "rb").read()
    more = bytes([2 << 3 | 2, 2, 3 << 3, 1])  # messages given twice are merged, the last value counts
    return sentencepiece.SentencePieceProcessor(model_proto=raw + more)


def test_pieces_score_as_high_as_the_library_search(docs):
    import sentencepiece

    from twinlens.llm import pieces

    sp, own = unigram(sentencepiece), pieces.Encoder(pieces.load(Q.tokenizer_path(Q.PIECE_MODEL)))
    for word in sorted({w for t in docs["text"][:20] for w in t.split()})[:400]:
        ids, _ = own.encode([word])
        assert sum(map(sp.get_score, ids.tolist())) == sum(map(sp.get_score, sp.nbest_encode(word, nbest_size=2)[0])), word
