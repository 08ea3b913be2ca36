"""Count-table utility, attack and importance against plain loops, and the gate that must not approve what was not measured."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import bayes, describe, fidelity
from twinlens.operators.pair import Pair
from twinlens.plans import scorecard as S


def rows_of(seed, n=240):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = float(rng.normal(2 if i % 3 == 0 else 0, 1))
        out.append((f"r{i}", i % 2 == 0, None if i % 17 == 0 else x, str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1])) if i % 5 else "rare", "yes" if x + rng.normal(0, 0.5) > 0.7 else "no"))
    return out


def frame(spark, rows):
    return Pair(spark.createDataFrame(rows, "row string, is_real boolean, x double, s string, y string").repartition(3))


def cells_of(rows, numbers=(2,)):
    low, high = (f(r[2] for r in rows if r[2] is not None) for f in (min, max))
    slot = lambda v: "null" if v is None else f"n{min(math.floor((v - low) / ((high - low) / 32)), 31)}"
    return [(slot(r[2]), "null" if r[3] is None else "v" + r[3]) for r in rows]


def flags(spark, rows):
    df = spark.createDataFrame([(r[0],) for r in rows], "row string")
    from twinlens.functions import hashrand
    from twinlens.operators.sampling import train_flag

    got = df.select("row", train_flag(F.col("row")).alias("t"), F.floor(hashrand.uniform(42, F.col("row"), "fold") * 5.0).alias("f")).collect()
    return {r["row"]: r["t"] for r in got}, {r["row"]: r["f"] for r in got}


def test_utility_by_hand(spark):
    rows = rows_of(1)
    train, _ = flags(spark, rows)
    full = [r for r in rows if r[2] is not None]
    cells = cells_of(full)
    sizes = [len({c[j] for c in cells}) for j in range(2)]

    def model(own):
        prior = Counter(full[i][4] for i in own)
        n = defaultdict(Counter)
        for i in own:
            for j in range(2):
                n[j, full[i][4]][cells[i][j]] += 1
        def predict(i):
            score = {k: math.log((prior[k] + 1) / (len(own) + 2)) + sum(math.log((n[j, k][cells[i][j]] + 1) / (prior[k] + sizes[j])) for j in range(2)) for k in ("no", "yes")}
            return min(score, key=lambda k: (-round(score[k], 9), k))
        return predict

    at = range(len(full))
    real = model([i for i in at if full[i][1] and train[full[i][0]]])
    synth = model([i for i in at if not full[i][1]])
    test = [i for i in at if full[i][1] and not train[full[i][0]]]
    share = lambda f, own: sum(f(i) == full[i][4] for i in own) / len(own)
    want = (share(real, test), share(synth, test), share(real, [i for i in at if not full[i][1]]))
    got = bayes.utility(frame(spark, rows), "y", "row").first()
    assert tuple(got)[:3] == pytest.approx(want) and got["performance_drop"] == pytest.approx(max(0, want[0] - want[1]) * 100)


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_attack_by_hand(spark, shift, monkeypatch):
    monkeypatch.setattr(bayes, "TABLE_NUMBERS", 1 if shift else 10**6)  # tables joined, or sent
    rows = [(k, real, x if x is None or real else x + shift, s, y) for k, real, x, s, y in rows_of(2)]
    _, fold = flags(spark, rows)
    pair = Pair(frame(spark, rows).tagged.drop("y"))
    cells = cells_of(rows)
    sizes = [len({c[j] for c in cells}) for j in range(2)]
    scores = []
    for i, r in enumerate(rows):
        others = [k for k in range(len(rows)) if fold[rows[k][0]] != fold[r[0]]]
        total = 0
        for j in range(2):
            a = sum(cells[k][j] == cells[i][j] for k in others if rows[k][1])
            b = sum(cells[k][j] == cells[i][j] for k in others if not rows[k][1])
            na, nb = (sum(rows[k][1] == side for k in others) for side in (True, False))
            total += math.log((a + 1) / (na + sizes[j])) - math.log((b + 1) / (nb + sizes[j]))
        scores.append((round(total, 9), r[1]))
    real, synth = [s for s, t in scores if t], [s for s, t in scores if not t]
    auc = np.mean([(a > b) + (a == b) / 2 for a in real for b in synth])
    accuracy = (np.mean([(a > 0) + (a == 0) / 2 for a in real]) + np.mean([(b < 0) + (b == 0) / 2 for b in synth])) / 2
    got = bayes.attack(pair, "row").first()
    assert (got["accuracy"], got["auc"]) == pytest.approx((accuracy, auc))
    assert (got["auc"] > 0.7) == bool(shift)


def test_importance_finds_the_feature(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(z), 7.0, "p" if x > 0.3 else "q") for i, (x, z) in enumerate(rng.normal(0, 1, (900, 2)))]
    df = spark.createDataFrame(rows, "i int, x double, z double, one double, y string")
    got = bayes.importance(df, "y", row_id="i").collect()
    assert [r["feature"] for r in got][:1] == ["x"] and got[0]["importance"] > 0.25 and abs(got[-1]["importance"]) < 0.05
    assert [(r["feature"], r["importance"]) for r in got] == [(r["feature"], r["importance"]) for r in bayes.importance(df.repartition(7), "y", row_id="i").collect()]
    assert {r["importance"] for r in got if r["feature"] == "one"} == {0.0}
    assert len(bayes.importance(df, "y", row_id="i", top=1).collect()) == 1
    assert all(r["importance"] is None for r in bayes.importance(df.withColumn("y", F.lit("p")), "y", row_id="i").collect())


@pytest.mark.parametrize("classifier", ["forest", "counts"])
def test_the_gate_approves_nothing_unmeasured(spark, classifier):
    rng = np.random.default_rng(9)
    real = spark.createDataFrame([(float(a), float(b), "g", int(a > 0)) for a, b in rng.normal(0, 1, (60, 2))], "a double, b double, s string, target int")
    nine = real.limit(9).withColumn("a", F.col("a") + 1e-9)
    hollow = real.withColumn("b", F.lit(None).cast("double"))
    cases = {"nine": nine} if classifier == "forest" else {"nine": nine, "none": real.limit(0), "hollow": hollow}
    for name, synth in cases.items():
        row = S.judge(S.evaluate(real, synth, "target", classifier=classifier)).first()
        assert row["decision"] != "Approve" and row["performance_drop"] is None, (name, row)
        if name == "nine":
            assert row["mia_risk_score"] is None and row["decision"] == "Error"
    use, risk = S.measured(Pair.of(real, nine), "target", classifier, parity=True)
    assert (use["performance_drop"], risk) == (0.0, 0.5)


def test_not_measured_is_null(spark):
    rows = rows_of(3, 60)
    pair = frame(spark, rows)
    assert set(bayes.utility(pair, "nope").first()) == {None}
    assert set(bayes.utility(Pair(pair.tagged.withColumn("y", F.lit("one"))), "y", "row").first()) == {None}
    assert set(bayes.utility(Pair(pair.tagged.limit(0)), "y", "row").first()) == {None}
    assert set(bayes.attack(Pair(pair.tagged.where("is_real or row = 'r1'")), "row").first()) == {None}
    assert set(bayes.attack(Pair(pair.tagged.select("row", "is_real")), "row").first()) == {None}


def test_empty_density_and_histogram(spark):
    empty = spark.createDataFrame([], "x double, is_real boolean")
    got = fidelity.kde_overlay(Pair(empty), "x", 5).collect()
    assert len(got) == 5 and all(r["density_real"] is None and r["density_synth"] is None for r in got)
    assert describe.column_histogram(empty, "x").count() == 0
