"""Sums of counts in segments run without Spark's test for overflow, and the session's rule comes back."""

import pytest

from twinlens.operators import segments as G

RULE = "spark.sql.ansi.enabled"


class Stopped(Exception):
    pass


def test_sums_without_overflow_test(spark, monkeypatch):
    seen, before = [], spark.conf.get(RULE)

    def stop(rows, *rest):
        seen.append(spark.conf.get(RULE))
        raise Stopped

    monkeypatch.setattr(G, "_measured", stop)
    rows = spark.createDataFrame([("a", i % 2 == 0, float(i), "t") for i in range(20)], "seg string, is_real boolean, x double, t string")
    with pytest.raises(Stopped):
        G.scorecards(rows, "seg")
    assert seen == ["false"] and spark.conf.get(RULE) == before
