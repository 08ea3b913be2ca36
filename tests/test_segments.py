"""Scorecards of all segments at once against each segment judged by itself."""

import re

import pytest
from pyspark.sql import functions as F

from twinlens.operators import bayes, fidelity, hotkeys, segments
from twinlens.operators.pair import Pair
from twinlens.operators.segments import scorecards
from twinlens.plans import scorecard as S
from twinlens.session import setting

SCHEMA = "shop string, is_real boolean, age double, pay double, town string, kind string, row string"
NAMES = ["age", "pay", "town", "kind"]


def rows():
    out = []
    for i in range(600):
        shop = "hot" if i % 3 else "abc"[(i // 3) % 3]
        real = (i * 7) % 5 < 3
        kind = "xyz"[(i // 2 + i // 7) % 3]
        age = float((i * i) % 23 + (0 if real else i % 2) + 5 * "xyz".index(kind))
        out.append((shop, real, age, float(i % 11) / 4, "pqr"[(i * 3 + i // 5) % 3], kind, str(i)))
    return out


def one_by_one(spark, df, shop):
    own = df.where(F.col("shop") == shop)
    pair = Pair(own.select(*NAMES, "is_real"))
    card = S.metric_row(pair).first().asDict()
    card["mmd"] = fidelity.mmd_features(pair, features=16).first()[0]
    keyed = Pair(own.select(*NAMES, "row", "is_real"))
    card.update(bayes.utility(keyed, "kind", "row").first().asDict())
    card["mia_risk_score"] = bayes.attack(keyed, "row").first()["accuracy"]
    return card


@pytest.mark.parametrize("wide", [32, 1])
def test_every_segment_as_if_alone(spark, monkeypatch, wide):
    monkeypatch.setattr(segments, "CLASSES_WIDE", wide)
    monkeypatch.setattr(hotkeys, "LEAST_ROWS", 5)  # hot segments and hot cells
    df = spark.createDataFrame(rows(), SCHEMA)
    tagged = df.select("shop", "is_real", *NAMES, F.struct("row").alias("key"))  # nested: not measured
    found = scorecards(tagged, "shop", "kind", F.col("key.row"), features=16).collect()
    got = {r["shop"]: r.asDict() for r in found}
    assert set(got) == {"hot", "a", "b", "c"}
    for shop in ("hot", "b"):
        want = one_by_one(spark, df, shop)
        for name, value in want.items():
            assert got[shop][name] == pytest.approx(value, abs=1e-9), (shop, name)


def test_nulls_sides_and_empty(spark):
    base = [("m", r, float(i % 4) if i % 5 else None, None, None if i % 3 else "t", "k" if i % 2 else None, str(i)) for i, r in enumerate([True, False] * 15)]
    base += [("one side", True, 1.0, 1.0, "t", "k", "1"), (None, True, 1.0, 1.0, "t", "k", "1"), ("m", None, float("nan"), float("inf"), "", "", "x")]
    df = spark.createDataFrame(base, SCHEMA)
    tagged = df.select("shop", "is_real", *NAMES)
    got = {r["shop"]: r.asDict() for r in scorecards(tagged, "shop", "kind", features=4).collect()}
    assert set(got) == {"m", "one side"}
    assert all(v is None for n, v in got["one side"].items() if n != "shop")
    assert got["m"]["performance_drop"] is None and got["m"]["mia_risk_score"] is not None and got["m"]["wasserstein"] >= 0
    notes = {r["shop"]: r["decision"] for r in S.judge(S.with_compliance(scorecards(tagged, "shop", "kind", features=4))).collect()}
    assert notes["one side"] == "Error" and notes["m"] != "Approve"
    assert scorecards(tagged.limit(0), "shop", "kind", features=4).collect() == []
    texts = scorecards(tagged.select("shop", "is_real", "town"), "shop").where("shop = 'm'").first()
    assert texts["mmd"] == 0.0 and texts["performance_drop"] is None
    with pytest.raises(ValueError):
        scorecards(tagged.select("shop", "is_real"), "shop")


def test_large_segments_apart(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    tagged = df.select("shop", "is_real", *NAMES, F.struct("row").alias("key"))
    card = lambda: {r["shop"]: r.asDict() for r in scorecards(tagged, "shop", "kind", F.col("key.row"), features=4).collect()}
    want = card()
    monkeypatch.setattr(segments, "WHOLE_ROWS", 150)  # "hot" has 200 rows, the others fewer
    got = card()
    assert set(got) == set(want) == {"hot", "a", "b", "c"}
    for shop, values in want.items():
        for name, value in values.items():
            assert got[shop][name] == pytest.approx(value, abs=1e-9), (shop, name)


def test_rows_travel_once(spark):
    """Whatever joins and counts by segment follow, the rows are dealt by segment once."""
    df = spark.createDataFrame(rows(), SCHEMA)
    dealt, numbers, texts = segments._plain(df.select("shop", "is_real", *NAMES), "shop", None, "kind", 5, 1)
    dealt = dealt.repartition(7, "seg")
    bounds = segments._moments(dealt, 2).select("seg", "lo", "hi")
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        cells = segments._cells(dealt.join(bounds, "seg"), NAMES, 2, "kind")
        totals = segments._segment_totals(cells, 5)
        model = segments._model_whole(cells, totals, NAMES, [0, 1, 2], 5)
        scored = segments._scored_whole(cells, model, NAMES, [0, 1, 2], [0, 1, 2, 3], 3)
        found = segments._distances(segments._ranked_whole(segments._value_counts(dealt, numbers, texts)), numbers, texts)
        for made in (scored, found):
            plan = made._jdf.queryExecution().executedPlan().toString()
            keys = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
            assert keys and all(re.fullmatch(r"seg#\d+L?", k) for k in keys), keys
        assert scored.count() == 600
