"""Texts whose words have one letter each."""

from twinlens.llm import langmix

SHORT = ["A.", "1 a 2", "I", "語", "x y z"]


def test_every_text_with_a_letter_has_a_language(spark):
    rows = [("en", "the house and a garden I saw"), ("de", "das Haus und ein Garten"), ("xx", "")]
    model = langmix.learn(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([*enumerate(SHORT), (10, "1 2."), (11, ""), (12, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langmix.predict(docs, model).collect()}
    assert all(got[k][0] in ("de", "en") and 0 < got[k][1] <= 1 for k in range(len(SHORT)))
    assert got[0] == got[1] == ("en", 1.0)  # only English has "a" as a word
    assert {got[k] for k in (10, 11, 12)} == {("und", 0.0)}


def test_texts_in_one_block_share_no_trigram():
    doc, cell, has = langmix.trigrams(["A.", "", "b", None, "7", "a"])
    assert doc.tolist() == [0, 2, 5] and cell[0] == cell[2] != cell[1]
    assert has.tolist() == [True, False, True, False, False, True]
