"""Only texts that may hold copies meet their spans in a join."""

import random

from twinlens.llm import chunks


def docs_of(spark, monkeypatch=None):
    r = random.Random(5)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    passage = prose(80)
    rows = [(i, prose(60)) for i in range(300)] + [(1000 + i, f"{prose(20)} {passage} {prose(20)}") for i in range(5)]
    return spark.createDataFrame([*rows, (None, prose(40)), (2000, None), (2001, ""), (None, passage)], "doc_id long, text string"), passage


def test_texts_without_copies_do_not_travel(spark):
    docs, passage = docs_of(spark)
    marked = docs.selectExpr("*", "xxhash64(text) AS mark")
    spans = chunks.copies(docs)
    held = marked.where(chunks._maybe(spans)("mark"))
    assert marked.join(spans, "mark", "left_semi").select(*held.columns).exceptAll(held).count() == 0  # none with copies is left out
    assert spans.count() <= held.count() < 20
    got = {(r["doc_id"], r["text"]): r["removed_bytes"] for r in chunks.deduplicate(docs).collect()}
    assert len(got) == docs.count() == 309
    assert sum(n > 0 for n in got.values()) == 5 and sum(got.values()) > 4 * len(passage) // 2
    assert {t for i, t in got if i in (2000, 2001)} == {None, ""}


def test_a_full_map_changes_nothing(spark, monkeypatch):
    docs, _ = docs_of(spark)
    first = sorted(chunks.deduplicate(docs).collect(), key=str)
    monkeypatch.setattr(chunks, "MAP_BITS", 64)
    assert sorted(chunks.deduplicate(docs).collect(), key=str) == first
