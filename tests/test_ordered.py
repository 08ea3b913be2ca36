"""Ordered statistics give the same with one bucket and with many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import fidelity, ordered
from twinlens.operators.pair import Pair
from twinlens.operators.profile import pair_stats
from twinlens.operators.sampling import fold_assign


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    hot = [3.0] * 400  # a value with a third of the rows
    values = hot + list(np.round(rng.lognormal(1, 2, 500), 2)) + [None] * 50 + list(rng.integers(0, 9, 250).astype(float))
    rows = [(i, None if v is None else float(v), int(i % 7)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, v double, w int").repartition(5).persist()


@pytest.mark.parametrize("size", [10**9, 60])
@pytest.mark.parametrize("points", [5, 101, 2001])
def test_quantiles(numbers, size, points):
    probs = [i / (points - 1) for i in range(points)]
    rows = ordered.quantiles(numbers, ["v", "w"], probs, rows_per_bucket=size).collect()
    data = numbers.toPandas()
    assert len(rows) == 2 * points
    for r in rows:
        assert r["q"] == pytest.approx(np.quantile(data[r["column"]].dropna(), r["p"]), abs=1e-9)


@pytest.mark.parametrize("size", [10**9, 60])
def test_wasserstein_brute_force(numbers, size):
    pair = Pair.split(numbers, F.col("id") < 600, ["v", "w"])
    got = fidelity.raw_wasserstein(pair, ["v", "w"], pair_stats(pair, ["v", "w"]), rows_per_bucket=size)
    data = numbers.toPandas()
    for r in got.collect():
        a = np.sort(data[data.id < 600][r["column"]].dropna())
        b = np.sort(data[data.id >= 600][r["column"]].dropna())
        x = np.unique(np.concatenate([a, b]))
        gap = np.abs(np.searchsorted(a, x, "right") / len(a) - np.searchsorted(b, x, "right") / len(b))
        assert r["w1"] == pytest.approx((gap[:-1] * np.diff(x)).sum(), rel=1e-9)


def test_running_total_slices(spark):
    rows = [(u, float(i // 3), i, float(i % 5)) for i in range(900) for u in ((0,) if i % 3 else (0, None))]
    df = spark.createDataFrame(rows, "u int, t double, i int, v double")
    got = {(r["u"], r["i"]): r["s"] for r in ordered.running_total(df, ["u"], ["t", "i"], "v", "s").collect()}
    want, total = {}, {}
    for u, _, i, v in sorted(rows, key=lambda r: r[1:3]):
        want[u, i] = total.get(u, 0.0)
        total[u] = want[u, i] + v
    assert got == want


def test_reserved_names_survive(spark):
    df = spark.createDataFrame([(i % 3, i, "k", "h", "b", "n") for i in range(60)], "g int, _rank int, _key string, _h string, _b string, _n string")
    folded = fold_assign(df, "g", F.col("_rank"), ["_rank"], folds=4)
    assert folded.columns == [*df.columns, "fold"] and folded.where("_key = 'k' and _h = 'h' and _b = 'b' and _n = 'n'").count() == 60
    assert sorted(r["count"] for r in folded.groupBy("g", "fold").count().collect()) == [5] * 12
    numbered = ordered.ordered_row_number(df, ["_rank"], "_key")
    assert [r["_key"] for r in numbered.orderBy("_rank").collect()] == list(range(60))
    assert ordered.hash_head(df, 7, ordered.hash_order(1, F.col("_rank")), ["_rank"]).columns == df.columns


def test_equal_rows_are_dealt_to_all_folds(spark):
    df = spark.createDataFrame([(1, "same")] * 400 + [(1, f"r{i}") for i in range(800)], "g int, s string")
    folded = fold_assign(df, "g", F.col("s"), [])
    assert {r["count"] for r in folded.groupBy("fold").count().collect()} == {240}
    assert max(r["count"] for r in folded.where("s = 'same'").groupBy("fold").count().collect()) == 80


def test_hash_head_large_equals_top_k(spark, monkeypatch):
    df = spark.range(5000)
    order = ordered.hash_order(1, F.col("id"))
    small = {r[0] for r in ordered.hash_head(df, 1234, order, ["id"]).collect()}
    monkeypatch.setattr(ordered, "TOP_K_LIMIT", 10)
    assert {r[0] for r in ordered.hash_head(df, 1234, order, ["id"]).collect()} == small
    assert len(small) == 1234
    assert ordered.hash_head(df, 99999, order, ["id"]).count() == 5000


def test_row_numbers(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2000, 1).when(F.col("id") < 2500, 0))  # and null
    got = ordered.hash_row_number(df, ["g"], ordered.hash_order(1, F.col("id")), ["id"], "n").toPandas()
    assert len(got) == 3000
    for _, part in got.groupby("g", dropna=False):
        assert sorted(part.n) == list(range(1, len(part) + 1))
    dense = ordered.ordered_row_number(df.select((F.col("id") * 7 % 3000).alias("x")), ["x"], "n").toPandas()
    assert (dense.x == dense.n).all()


def test_quantiles_by_selection(spark, monkeypatch):
    """Brackets give numpy's quantiles on skewed, tied, null and signed-zero values, without ranking all of them."""
    rng = np.random.default_rng(3)
    n = 30_000
    data = {
        "wide": np.exp(rng.normal(0, 20, n)),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n)).astype(float),
        "zero": np.where(rng.random(n) < 0.5, -0.0, np.where(rng.random(n) < 0.5, 0.0, rng.normal(0, 1, n))),
        "few": np.where(np.arange(n) < 3, np.arange(n), np.nan),
        "none": np.full(n, np.nan),
    }
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    probs = [i / 40 for i in range(41)]

    def refuse(*_):
        raise AssertionError("all values ranked")

    monkeypatch.setattr(ordered, "_ranked", refuse)
    monkeypatch.setattr(ordered, "SELECT_FROM", 0)
    got = {(r["column"], r["p"]): r["q"] for r in ordered.quantiles(df, list(data), probs).collect()}
    assert len(got) == 4 * len(probs)
    for c in ("wide", "hot", "zero", "few"):
        known = data[c][~np.isnan(data[c])]
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(known, p), rel=1e-12, abs=1e-12), (c, p)


def test_quantiles_fall_back(spark, monkeypatch):
    """A bracket that misses its rank, and infinite values, lead to ranking every value."""
    df = spark.range(1000).selectExpr("cast(id as double) as v", "if(id = 5, double('Infinity'), id) as w")
    monkeypatch.setattr(ordered, "SELECT_FROM", 0)
    monkeypatch.setattr(ordered, "_brackets", lambda d, counts, probs: {c: [(0.0, 1.0, probs)] for c in counts})
    assert ordered.quantiles(df, ["v"], [0.5]).first()["q"] == 499.5
    assert {r["column"] for r in ordered.quantiles(df, ["v", "w"], [0.5]).collect()} == {"v", "w"}
