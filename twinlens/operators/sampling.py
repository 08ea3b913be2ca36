"""Sampling, splitting and mixing by hash order: exact sizes, stable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions import hashrand
from twinlens.operators.columns import unused
from twinlens.operators.ordered import hash_head, hash_order, hash_row_number


def sample_n(df: DataFrame, n: int, row_id: Column, tie: list[str], seed: int = C.DEFAULT_SEED) -> DataFrame:
    """``n`` rows without replacement, or all there are."""
    return hash_head(df, n, hash_order(seed, row_id), tie)


def train_flag(row_id: Column, share: float = 1.0 - C.TEST_SHARE, seed: int = C.DEFAULT_SEED) -> Column:
    """True for the training share; no shuffle, no second pass."""
    return hashrand.uniform(seed, row_id, "split") < F.lit(share)


def fold_assign(
    df: DataFrame, label: str, row_id: Column, tie: list[str], folds: int = C.ATTACK_FOLDS, seed: int = C.DEFAULT_SEED, out: str = "fold"
) -> DataFrame:
    """Stratified folds: each label's rows are dealt out in hash order."""
    n = unused([*df.columns, out], "_n")
    numbered = hash_row_number(df, [label], hash_order(seed, row_id, "fold"), tie, n)
    return numbered.withColumn(out, ((F.col(n) - 1) % folds).cast("int")).drop(n)


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def ensemble_mix(
    first: DataFrame,
    second: DataFrame,
    weight: float,
    rows: int,
    row_id: str,
    names: tuple[str, str],
    seed: int = C.DEFAULT_SEED,
) -> DataFrame:
    """``int(rows * weight)`` rows of the better model and the rest of the other,
    each limited to what the model produced; ``source`` names the model."""
    n1 = int(rows * weight)
    n2 = rows - n1
    parts = [
        sample_n(df, n, F.col(row_id), [row_id], seed).withColumn("source", F.lit(name))
        for df, n, name in ((first, n1, names[0]), (second, n2, names[1]))
    ]
    return union_all(*parts)
