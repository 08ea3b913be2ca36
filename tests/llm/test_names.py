"""Kept columns that are called like new ones."""

import pytest

from twinlens.llm import langmix, ordinal, pieces, tiling
from twinlens.llm import queries as Q


@pytest.fixture(scope="module")
def docs(spark):
    names = "lang_pred string, score int, languages string, shares string, n_ids int, ids_crc32 int, round_trip string, ids string, hits string, contaminated int, coverage int, severity string, _flag int, _hits string"
    values = ("a", 1, "b", "c", 2, 3, "d", "e", "f", 4, 5, "g", 6, "h")
    rows = [(1, "some words of one text here", "en", 1, *values), (2, None, None, 0, *values)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, toxic int, {names}")


def test_outputs_give_way(docs, spark):
    own = docs.columns[4:]
    values = tuple(docs.select(*own).first())
    path = Q.tokenizer_path(Q.PIECE_MODEL)
    item = spark.createDataFrame([(1, "some words of one text here")], "item_id long, text string")
    model = ordinal.fit(docs.select("doc_id", "text", docs.toxic.alias("grade")))
    found = {
        "_lang_pred": langmix.predict(docs, langmix.learn(docs), keep=tuple(own)),
        "_round_trip": pieces.checked(docs, path, ["doc_id", *own], with_ids=True),
        "_contaminated": tiling.contamination(docs, item, ["doc_id", *own]),
        "_severity": ordinal.predict(docs, model, ["doc_id", *own]),
    }
    for new, df in found.items():
        assert new in df.columns and len(set(df.columns)) == len(df.columns)
        assert [tuple(r) for r in df.select(*own).collect()] == [values] * 2
    assert [r["_contaminated"] for r in found["_contaminated"].orderBy("doc_id").collect()] == [True, False]
    graded = ordinal.silver_grades(docs, ordinal.top(ordinal.counted(docs.withColumnRenamed("toxic", "grade"))), keep=("doc_id", "_flag", "_hits"))
    assert graded.count() == 2
