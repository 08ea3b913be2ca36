import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import mwem, privacy, sampling
from twinlens.operators.generators import finance_rows, generate, healthcare_rows
from twinlens.operators.pair import Pair


def test_noise_rules(spark):
    df = spark.createDataFrame([(i, float(i), i % 2, "a") for i in range(200)], "patient_id int, x double, flag int, s string")
    out = privacy.laplace_noise(df, 0.5, 1, F.col("patient_id")).toPandas().sort_values("patient_id")
    assert (out.patient_id == range(200)).all() and set(out.flag) == {0, 1}
    assert out.x.min() >= -2 and out.x.max() <= 201
    assert 1.0 < np.abs(out.x.to_numpy() - np.arange(200)).mean() < 3.0  # mean |Laplace(2)| is 2
    split = privacy.laplace_noise(df.withColumn("y", F.col("x")), 0.5, 1, F.col("patient_id"), split_budget=True)
    assert split.agg(F.avg(F.abs(F.col("x") - F.col("patient_id")))).first()[0] > 2.5


def test_range_matching_is_the_quantile_round_trip(spark):
    rng = np.random.default_rng(5)
    real, synth = rng.normal(0, 1, 400), rng.normal(0, 2, 300)
    refs = np.linspace(0, 1, 400)
    grid = np.quantile(real, refs)
    forward = 0.5 * (np.interp(synth, grid, refs) - np.interp(-synth, -grid[::-1], -refs[::-1]))
    want = np.interp(forward, refs, grid)

    def frame(v):
        return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, x double")

    got = privacy.quantile_match(frame(synth), frame(real), exclude=("i",)).toPandas().sort_values("i")
    assert np.allclose(got.x, want, atol=1e-9)


def test_sanitise_states(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "i int, x double")
    assert privacy.sanitise(None, None, 1.0, 1, 1, F.col("i"))[2] == "Failed"
    out, proof, status = privacy.sanitise(df, df, 1.0, 4, 1, F.col("i"), exclude=("i",))
    assert status == "Privacy-Cleared" and proof["epsilon"] == 2.0 and proof["delta"] == 1e-5
    low, high = out.agg(F.min("x"), F.max("x")).first()
    assert low >= 0 and high <= 49


def test_linkability(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "n int, s string")
    b = spark.createDataFrame([(1.0, "x"), (2.0, None), (4.0, "z")], "n double, s string")
    assert tuple(privacy.linkability(Pair.of(a, b)).first()) == (1, False)
    assert tuple(privacy.linkability(Pair.of(a, b), digest_text=True).first()) == (1, False)
    assert tuple(privacy.linkability(Pair.of(a, b), exclude=("n",)).first()) == (2, False)
    assert privacy.linkability(Pair.of(a, a)).first()[0] == 2


def test_k_anonymity(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y"), ("b", "y"), (None, "y")], "p string, q string")
    assert privacy.k_anonymity(df, ["p", "q"]).first()[0] == 2
    assert privacy.k_anonymity(df, []).first()[0] == 1
    assert privacy.k_anonymity(df, ["nope"]).first()[0] == 1


def test_histogram_is_close_at_a_large_budget(spark):
    rows = [("a", 1)] * 400 + [("a", 2)] * 50 + [("b", 1)] * 50 + [("b", 3)] * 300
    df = spark.createDataFrame(rows, "c string, d int")
    cells = {"c": F.col("c"), "d": F.col("d")}
    out = mwem.mwem(df, cells, epsilon=200.0, rounds=12).toPandas()
    assert len(out) == 6  # empty combinations belong to the domain
    assert out.weight.sum() == pytest.approx(800) and (out.weight >= 0).all()
    weight = {(r.c, r.d): r.weight for r in out.itertuples()}
    assert weight[("a", 1)] > 1.5 * weight[("b", 1)] and weight[("b", 3)] > 1.5 * weight[("a", 3)]


def test_sample_follows_the_histogram(spark):
    hist = spark.createDataFrame([("a", 1, 75.0), ("b", 2, 25.0)], "c string, d int, weight double")
    got = mwem.sample_histogram(hist, ["c", "d"], spark.range(4000), "id").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got}["a"] == pytest.approx(3000, abs=150)


def test_generators_hold_their_priors(spark):
    h = healthcare_rows(spark.range(4000).repartition(7), "id", 42)
    p = h.toPandas().sort_values("patient_id").reset_index(drop=True)
    assert p.age.between(18, 95).all() and p.systolic_bp.between(85, 200).all() and p.bmi.between(15, 55).all()
    assert p.num_medications.between(0, 15).all() and (p.treatment_cost >= 20).all()
    assert p.smoker.mean() == pytest.approx(0.25, abs=0.03) and p.diagnosis.nunique() == 15
    assert (p.gender == "Male").mean() == pytest.approx(0.48, abs=0.03)
    same = healthcare_rows(spark.range(4000).coalesce(1), "id", 42).toPandas().sort_values("patient_id").reset_index(drop=True)
    assert p.equals(same)
    f = finance_rows(spark.range(4000), "id", 42).toPandas()
    assert f.is_fraud.mean() == pytest.approx(0.05, abs=0.015)
    assert set(f[f.is_fraud == 1].hour_of_day) <= {0, 1, 2, 3, 23}
    assert f[f.is_fraud == 0].amount.max() <= 5000 and f[f.is_fraud == 1].amount.between(500, 8000).all()
    with pytest.raises(ValueError):
        generate(spark, "sports")


def test_folds_are_even_per_label(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") < 700).cast("int"))
    got = sampling.fold_assign(df, "label", F.col("id"), ["id"]).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in got} == {(1, 140), (0, 60)}
