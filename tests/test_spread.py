"""Partitions and fits stay bounded, however many rows there are."""

from twinlens import session
from twinlens.constants import ATTACK_FOLDS
from twinlens.operators import modelling


def test_partitions_grow_with_rows(spark, monkeypatch):
    df = spark.range(0, 1000, 1, 8)
    assert session.spread(df, 1000).rdd.getNumPartitions() == 8  # enough for few rows
    monkeypatch.setattr(session, "SPREAD_ROWS", 50)
    wide = session.spread(df, 1000)
    assert wide.rdd.getNumPartitions() == 20 and max(wide.rdd.glom().map(len).collect()) <= 100
    assert wide.count() == 1000


def test_folds_at_once():
    assert modelling.folds_at_once(0) == modelling.folds_at_once(1_000_000) == ATTACK_FOLDS
    assert modelling.folds_at_once(4_000_000) == 2 and modelling.folds_at_once(10**9) == 1
