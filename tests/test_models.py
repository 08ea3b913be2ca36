import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import modelling, nearest, synthesizers
from twinlens.operators.generators import healthcare_rows
from twinlens.operators.pair import Pair
from twinlens.plans import loop


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(10, 2, 1500)
    rows = [
        (int(i), float(x), int(round(x * 3 + rng.normal(0, 1))), "hi" if x > 10 else "lo", None if i % 10 == 0 else float(rng.exponential()))
        for i, x in enumerate(a)
    ]
    return spark.createDataFrame(rows, "k long, a double, b int, s string, c double").persist()


@pytest.mark.parametrize("slot", ["marginals", "copula", "latent", "mixture"])
def test_samplers_keep_shape_and_margins(table, slot):
    real = table.drop("k")
    m = synthesizers.fit_marginals(real)
    sample = synthesizers.synthesize(slot, real, m, table.select("k"), "k")
    assert sample.drop("k").schema.simpleString() == real.schema.simpleString()
    assert sample.count() == 1500
    assert synthesizers.pilot_score(real, sample.drop("k")) < 0.1
    nulls = sample.where(F.col("c").isNull()).count() / 1500
    assert nulls == pytest.approx(0.1, abs=0.04)
    if slot != "marginals":
        assert sample.corr("a", "b") > 0.7


@pytest.mark.parametrize("slot", ["marginals", "copula", "latent", "mixture"])
def test_samplers_keep_types_nulls_and_many_categories(spark, slot, monkeypatch):
    monkeypatch.setattr(synthesizers, "SLICE", 700)
    df = spark.range(6000).selectExpr(
        "id as k",
        "cast(id % 97 as double) / 7 as x",
        "cast(id % 50 as decimal(9,2)) + 0.25 as d",
        "timestamp_seconds(1600000000 + id * 60) as t",
        "date_add(date'2020-01-01', cast(id % 365 as int)) as day",
        "id % 4 = 0 as yes",
        "if(id % 3 = 0, 'hot', concat('v', id % 1500)) as many",
        "if(id % 2 = 0, null, concat('h', id % 5)) as half",
        "if(id % 2 = 0, null, concat('key', id)) as token",
        "cast(null as string) as none",
        "cast(null as double) as nan",
        "array(id) as nested",
    )
    real = df.drop("k")
    m = synthesizers.fit_marginals(real)
    assert list(m.large) == ["many"] and m.opaque == ["token"]
    sample = synthesizers.synthesize(slot, real, m, df.select("k"), "k").persist()
    assert sample.drop("k").schema.simpleString() == real.schema.simpleString()
    assert sample.count() == sample.select("k").distinct().count() == 6000
    got = sample.selectExpr(
        "avg(int(half is null))", "avg(int(token is null))", "avg(int(many = 'hot'))", "avg(int(yes))",
        "count(none)", "count(nan)", "count(t)", "min(day) >= date'2020-01-01' and max(day) <= date'2020-12-31'",
    ).first()
    assert list(got)[:4] == pytest.approx([0.5, 0.5, 1 / 3, 0.25], abs=0.04)
    assert list(got)[4:] == [0, 0, 6000, True]
    assert sample.select("many").subtract(real.select("many")).count() == 0
    assert sample.select("many").distinct().count() > 700


def test_look_up_is_the_inverse_of_the_running_shares(spark, monkeypatch):
    monkeypatch.setattr(synthesizers, "SLICE", 10)
    df = spark.range(1000).selectExpr("if(id < 400, 'hot', concat('v', id % 90)) as s")
    values = synthesizers.Values(synthesizers.value_table(df, "s"), 1000)
    runs = [(r["start"], r["n"], r["value"]) for r in values.table.orderBy("start").collect()]
    assert [a for a, _, _ in runs] == [sum(n for _, n, _ in runs[:i]) for i in range(len(runs))]
    want = {i: v for a, n, v in runs for i in range(a, a + n)}
    asked = spark.range(1000).selectExpr("id", "(id + 0.5D) / 1000 as p")
    got = {r["id"]: r["s"] for r in synthesizers.look_up(asked, F.col("p"), values, "s").collect()}
    assert got == want


def test_mixture_keeps_components_of_any_number_of_cells(spark):
    """Two far groups of rows with 20,000 pairs of categories each, which a product of columns
    would mix up; one group has a text of 3,001 values as well."""
    df = spark.range(40000).selectExpr(
        "id as k",
        "if(id % 2 = 0, 0, 1000) + id % 7 as double_x",
        "concat(if(id % 2 = 0, 'a', 'b'), id % 200) as one",
        "concat(if(id % 2 = 0, 'a', 'b'), (id div 200) % 200) as two",
        "if(id % 2 = 0, null, concat('b', id % 3001)) as prediction",
    )
    real = df.drop("k")
    m = synthesizers.fit_marginals(real)
    assert list(m.large) == ["prediction"] and set(m.category) == {"one", "two"}
    sample = synthesizers.sample_mixture(real, m, df.select("k"), "k", components=2).persist()
    assert sample.columns == df.columns and sample.count() == 40000
    assert sample.where("left(one, 1) != left(two, 1) or (left(one, 1) = 'a') != (double_x < 500) or (prediction is null) != (double_x < 500)").count() == 0
    drawn = sample.select("one", "two").distinct()
    assert drawn.count() > 10000 and drawn.subtract(real.select("one", "two")).count() == 0
    assert sample.select("prediction").distinct().count() > 2000


def test_attack_knows_copies_from_shifts(spark):
    rng = np.random.default_rng(7)
    rows = [(float(x), float(y)) for x, y in rng.normal(0, 1, (400, 2))]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("i", F.monotonically_increasing_id())
    halves = Pair.split(df, F.md5(F.col("x").cast("string")) < "8", ["x", "y"])
    assert modelling.attack_accuracy(halves, trees=10) == pytest.approx(0.5, abs=0.12)
    shifted = Pair.of(df.drop("i"), df.select((F.col("x") + 50).alias("x"), "y"))
    assert modelling.attack_accuracy(shifted, rows=100, trees=10) > 0.98
    assert modelling.attack_accuracy(Pair.of(df.drop("i").limit(3), df.drop("i").limit(3))) is None


def test_utility(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 600)
    df = spark.createDataFrame([(float(v), "p" if v > 0 else "q", int(v > 0.2)) for v in x], "x double, s string, y int")
    scores = modelling.utility_scores(Pair.split(df, F.md5(F.col("x").cast("string")) < "8"), "y")
    assert scores["baseline_accuracy"] > 0.9 and scores["tstr_accuracy"] > 0.9 and scores["performance_drop"] < 10
    assert modelling.utility_scores(Pair.of(df, df), "nope") == modelling.NO_UTILITY
    assert modelling.utility_scores(Pair.of(df.limit(4), df.limit(4)), "y") == modelling.NO_UTILITY
    top = modelling.feature_importance(df.withColumn("z", F.rand(1)), "y").orderBy("rank").first()
    assert top["feature"] == "x"


def test_label_codes_with_and_without_window(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in "dbcaabd"], "s string")
    one = sorted(map(tuple, modelling.label_encode(df, ["s"]).collect()))
    monkeypatch.setattr(modelling, "WINDOW_LIMIT", 1)
    assert sorted(map(tuple, modelling.label_encode(df, ["s"]).collect())) == one == [("s", v, i) for i, v in enumerate("abcd")]


def test_nearest_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(9)
    store, asked = rng.normal(0, 1, (200, 4)), rng.normal(0, 1, (7, 4))

    def frame(v, name):
        return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"{name} long, e array<double>")

    want = {(q, r + 1, int(i)) for q in range(7) for r, i in enumerate(np.argsort(((store - asked[q]) ** 2).sum(1))[:3])}
    for limit in (4096, 2):
        monkeypatch.setattr(nearest, "QUERY_LIMIT", limit)
        got = nearest.nearest(frame(asked, "q"), "q", frame(store, "v").repartition(5), "v", "e", 3).collect()
        assert {(r["q"], r["rank"], r["v"]) for r in got} == want


def test_loop_makes_and_judges_a_table(spark):
    request = loop.Request(domain="Healthcare", rows=200, model="vae", attack_trees=5, max_rounds=1)
    out = loop.run(spark, request)
    assert out.cold_start and out.synth.count() == 200 and out.iteration == 1
    assert out.decision in ("Approve", "Reject")
    assert set(out.weights) == {"TVAE", "GaussianCopula"} and sum(out.weights.values()) == pytest.approx(1)
    card = out.scorecard.first()
    assert card["k_anonymity"] >= 1 and 0 <= card["mia_risk_score"] <= 1


def test_loop_falls_back_on_tiny_input(spark):
    tiny = healthcare_rows(spark.range(2), "id")
    out = loop.run(spark, loop.Request(rows=200, max_rounds=1, attack_trees=5), tiny)
    assert out.model_selection == "Fallback" and out.synth.count() == 2


def separable(spark, values, name="s"):
    rng = np.random.default_rng(11)
    rows = [(float(x), f"v{i % values}") for i, x in enumerate(rng.normal(0, 1, 400))]
    df = spark.createDataFrame(rows, f"x double, {name} string")
    return df, df.withColumn("x", F.col("x") + 50)


@pytest.mark.parametrize("values", [40, 400])
def test_attack_sees_through_pairs_with_many_texts(spark, values):
    pair = Pair.of(*separable(spark, values))
    assert modelling.attack_accuracy(pair, trees=10) > 0.98
    assert modelling.utility_or_failed(Pair.of(*separable(spark, values, "fold")), "fold")["performance_drop"] is not None


def test_attack_that_fails_is_no_safe_table(spark, monkeypatch):
    def broken(*args, **options):
        raise ValueError("no fit")

    from twinlens.plans import scorecard

    monkeypatch.setattr(modelling, "attack_accuracy", broken)
    real, synth = separable(spark, 5)
    assert modelling.attack_or_failed(Pair.of(real, synth)) is None
    got = scorecard.judge(scorecard.evaluate(real, synth)).first()
    assert got["mia_risk_score"] is None and got["decision"] == "Error"


@pytest.mark.parametrize("target", ["label", "features", "fold", "is_train", "prediction"])
def test_target_may_be_called_anything(spark, target):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(float(v), int(v > 0)) for v in rng.normal(0, 1, 300)], f"x double, {target} int")
    assert modelling.utility_scores(Pair.split(df, F.md5(F.col("x").cast("string")) < "8"), target)["baseline_accuracy"] > 0.9


def test_empty_parts_and_wide_keys(spark):
    from twinlens.operators import fidelity

    texts = Pair.of(spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([("b",)], "s string"))
    assert fidelity.wasserstein_by_column(texts).count() == 0
    assert modelling.label_encode(texts.tagged, []).count() == 0
    keys = Pair.of(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([((1 << 53) + 1,)], "k long"))
    assert keys.synth.first()["k"] == (1 << 53) + 1


def test_private_histogram_keeps_rows_with_nulls(spark):
    from twinlens.operators.mwem import mwem

    df = spark.range(1000).selectExpr("if(id % 2 = 0, null, concat('v', id % 3)) as s", "id % 4 as b")
    got = mwem(df, {"s": F.col("s"), "b": F.col("b")}, epsilon=10.0, rounds=4)
    assert got.count() == 16
    assert got.agg(F.sum("weight")).first()[0] == pytest.approx(1000)
    assert got.where("s is null").agg(F.sum("weight")).first()[0] > 100


def test_nearest_correlation_is_nearer_than_clipping():
    rng = np.random.default_rng(13)
    for d in (3, 6, 12):
        a = np.clip(rng.uniform(-1, 1, (d, d)), -0.95, 0.95)
        a = (a + a.T) / 2
        np.fill_diagonal(a, 1.0)
        near = synthesizers.nearest_correlation(a)
        values, axes = np.linalg.eigh(a)
        clipped = (axes * np.maximum(values, 0)) @ axes.T
        clipped /= np.sqrt(np.outer(np.diag(clipped), np.diag(clipped)))
        assert np.linalg.eigvalsh(near)[0] > -1e-7 and np.allclose(np.diag(near), 1)
        assert values[0] >= 0 or np.linalg.norm(near - a) < np.linalg.norm(clipped - a)
    assert (synthesizers.nearest_correlation(np.eye(3)) == np.eye(3)).all()
    # The published example of the method's paper.
    known = synthesizers.nearest_correlation(np.array([[1.0, 1, 0], [1, 1, 1], [0, 1, 1]]))
    assert known == pytest.approx(np.array([[1, 0.7607, 0.1573], [0.7607, 1, 0.7607], [0.1573, 0.7607, 1]]), abs=1e-4)


def test_histogram_is_drawn_by_weight(spark):
    from twinlens.operators.mwem import domain_cells, sample_histogram

    counts = spark.createDataFrame([("a", 1, 60.0), (None, 2, 30.0), ("b", 1, 10.0)], "s string, b int, n double")
    domain = domain_cells(counts, ["s", "b"])
    assert {(r["s"], r["b"]): r["n"] for r in domain.collect()} == {("a", 1): 60, ("a", 2): 0, (None, 1): 0, (None, 2): 30, ("b", 1): 10, ("b", 2): 0}
    drawn = sample_histogram(domain.withColumnRenamed("n", "weight"), ["s", "b"], spark.range(5000), "id")
    assert drawn.columns == ["id", "s", "b"] and drawn.select("id").distinct().count() == 5000
    got = {(r["s"], r["b"]): r["count"] / 5000 for r in drawn.groupBy("s", "b").count().collect()}
    assert got == {("a", 1): pytest.approx(0.6, abs=0.03), (None, 2): pytest.approx(0.3, abs=0.03), ("b", 1): pytest.approx(0.1, abs=0.02)}
