"""Moments of segments: columns without nulls share their deviations."""

import math

from pyspark.sql import functions as F

from twinlens.operators import segments

ROWS = [(f"s{i % 3}", i % 2 == 0, float(i % 7), float((i * i) % 11), None if i % 5 == 0 else float(i % 4)) for i in range(90)]


def test_columns_without_nulls_are_aggregated_once(spark):
    rows = spark.createDataFrame([(s, r, a, b, float(i)) for i, (s, r, a, b, _) in enumerate(ROWS)], "seg string, is_real boolean, x0 double, x1 double, x2 double")
    plan = segments._moments(rows, 3, frozenset())._jdf.queryExecution().executedPlan().toString()
    own = next(line for line in plan.splitlines() if "HashAggregate" in line and "partial_var_pop" in line)
    assert own.count("partial_var_pop") == 3 and own.count("partial_covar_pop") == 3


def test_gaps_change_nothing_but_what_is_shared(spark):
    rows = spark.createDataFrame(ROWS, "seg string, is_real boolean, x0 double, x1 double, x2 double")
    told, all_of = (segments._moments(rows, 3, frozenset(g)).orderBy("seg").collect() for g in ((2,), (0, 1, 2)))
    assert told == all_of
    one = rows.where("seg = 's1' and is_real and x2 is not null")
    want = one.agg(F.corr("x0", "x2")).first()[0]
    assert math.isfinite(want) and told[0]["n_real"] == 15
