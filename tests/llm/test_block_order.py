"""Statistics of a text do not depend on the texts beside it."""

import itertools

import numpy as np

from twinlens.llm import trees

TEXTS = ["aaa", "aaaa", "a", "", "ab", "bbb", None, "b a", "x" * 9]


def test_statistics_do_not_depend_on_neighbours():
    alone = {t: trees.statistics([t])[0] for t in TEXTS}
    for order in itertools.islice(itertools.permutations(TEXTS), 0, 362880, 3631):
        assert np.array_equal(trees.statistics(list(order)), np.array([alone[t] for t in order]))


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = trees.fit(docs.selectExpr("doc_id", "text", "cast(length(text) > 3 as int) quality").where("text is not null"))
    scored = lambda part: {r["doc_id"]: r["score"] for r in trees.predict(part, model, ["doc_id"]).collect()}
    first = spark.createDataFrame(rows, docs.schema).coalesce(1)
    last = spark.createDataFrame(rows[::-1], docs.schema).coalesce(1)
    assert scored(first) == scored(last)
