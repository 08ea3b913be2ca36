"""Running sums and lookups where one key, one order value or one row content is a third of the table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import hotkeys, scan


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(3)
    rows = [(7, 1.0, 5, 0.25, "same")] * 400  # one row content
    rows += [(7, 1.0, int(i), float(i % 3), f"t{i}") for i in range(200)]  # one (key, order)
    rows += [(None, None, int(i), 1.0, None) for i in range(100)]
    rows += [(int(rng.integers(0, 40)), float(rng.integers(0, 20)), int(i), float(rng.random()), f"r{i}") for i in range(600)]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "u int, t double, i int, v double, _part string").repartition(6).persist()


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_against_one_pass(hot, parts):
    got = scan.running(hot, ["u"], ["t", "i"], {"n": ("count", F.lit(1)), "s": ("sum", "v"), "x": ("xor", "i")}, parts)
    assert got.columns == [*hot.columns, "n", "s", "x"]
    seen = got.orderBy("u", "n").collect()
    assert len(seen) == hot.count()
    totals = {}
    before = {}
    for r in seen:
        n, s, x = totals.get(r["u"], (0, 0.0, 0))
        assert r["n"] == n + 1
        assert r["s"] == pytest.approx(s + r["v"], abs=1e-9)
        assert r["x"] == x ^ r["i"]
        totals[r["u"]] = (r["n"], r["s"], r["x"])
        place = (-math.inf if r["t"] is None else r["t"], r["i"])
        assert before.get(r["u"], place) <= place
        before[r["u"]] = place


def test_no_partition_holds_the_hot_key(hot):
    got = scan.running(hot, ["u"], ["t"], {"n": ("count", F.lit(1))}, 12)
    sizes = sorted(r["count"] for r in got.groupBy(F.input_file_name()).count().collect())
    assert len(sizes) == 12 and sizes[-1] < 2 * sizes[6]


def test_huge_values_stay_in_their_key(spark):
    rows = [("a", 0, 1e300), ("a", 1, math.inf), ("b", 0, 0.1), ("b", 1, 0.2), ("c", 0, None), ("c", 1, 2.5)]
    got = scan.running(spark.createDataFrame(rows, "k string, o int, v double"), ["k"], ["o"], {"s": ("sum", "v")}, 2)
    assert {(r["k"], r["o"]): r["s"] for r in got.collect()} == {("a", 0): 1e300, ("a", 1): math.inf, ("b", 0): 0.1, ("b", 1): 0.1 + 0.2, ("c", 0): 0.0, ("c", 1): 2.5}


def test_empty(spark):
    empty = spark.createDataFrame([], "k string, o int, v double")
    got = scan.running(empty, ["k"], ["o"], {"s": ("sum", "v")})
    assert got.count() == 0 and got.columns == ["k", "o", "v", "s"]


@pytest.mark.parametrize("least", [1, 10**9])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_equals_join(hot, spark, least, how):
    table = spark.createDataFrame([(k, f"name{k}") for k in range(0, 40, 2)] + [(7, "seven")], "u int, name string")
    want = hot.join(table, ["u"], how)
    got = hotkeys.lookup(hot, table, ["u"], how, least_rows=least)
    assert got.columns == want.columns
    key = lambda r: repr(r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_hot_keys_are_few(hot):
    assert hotkeys.hot_keys(hot, ["u"], 300) == [(7,)]
