"""Noise, sanitising, exact-copy and group-size checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions import hashrand
from twinlens.functions.scalars import clip, total_epsilon
from twinlens.operators.columns import noise_id_name, numeric_columns, string_columns
from twinlens.operators.fidelity import one_row
from twinlens.operators.pair import IS_REAL, Pair
from twinlens.operators.profile import distinct_counts


def _bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns) if row[f"lo{i}"] is not None}


def laplace_noise(
    df: DataFrame,
    epsilon: float,
    seed: int,
    row_id: Column,
    exclude: tuple[str, ...] = (),
    sensitivity: float | dict[str, float] = 1.0,
    bounds: dict[str, tuple[float, float]] | None = None,
    split_budget: bool = False,
) -> DataFrame:
    """Laplace noise of scale sensitivity/epsilon on numeric columns.

    Columns with at most two values and identifiers stay as they are; noisy
    values are held within the column's range widened by the scale. This is
    noise with a stated scale, not a certified mechanism: every column spends
    epsilon unless ``split_budget`` divides it, the default sensitivity is 1
    whatever the column, and the range is read from the data unless public
    ``bounds`` are given. The seed must stay secret.
    """
    names = [c for c in numeric_columns(df) if c not in exclude and not noise_id_name(c)]
    if not names:
        return df
    _, counts = distinct_counts(df, names, small=True)
    noisy = [c for c in names if counts[c][1] > C.NOISE_MIN_DISTINCT]
    if not noisy:
        return df
    limits = {**_bounds(df, [c for c in noisy if c not in (bounds or {})] or noisy), **(bounds or {})}
    share = len(noisy) if split_budget else 1
    cells = []
    for c in df.columns:
        if c not in noisy:
            cells.append(F.col(c))
            continue
        width = sensitivity.get(c, 1.0) if isinstance(sensitivity, dict) else sensitivity
        scale = width * share / epsilon
        low, high = limits[c]
        value = F.col(c).cast("double") + hashrand.laplace(seed, row_id, c, scale)
        cells.append(clip(value, float(low) - scale, float(high) + scale, F.col(c).isNotNull()).alias(c))
    return df.select(*cells)


def quantile_match(synth: DataFrame, real: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Map numeric columns through the real quantiles and back.

    Going forward and backward through the same monotone quantile curve leaves
    every value inside the real range where it was and moves the others to its
    ends, so the operator is a clamp: one aggregate over the real table and a
    projection. Real columns with at most five values and identifiers are left.
    """
    shared = set(numeric_columns(synth))
    names = [c for c in numeric_columns(real) if c in shared and c not in exclude and not noise_id_name(c)]
    if not names:
        return synth
    _, counts = distinct_counts(real, names, small=True)
    matched = [c for c in names if counts[c][1] > C.MATCH_MIN_DISTINCT]
    if not matched:
        return synth
    limits = _bounds(real, matched)
    return synth.select(
        *[
            clip(F.col(c).cast("double"), float(limits[c][0]), float(limits[c][1])).alias(c) if c in limits and c in matched else F.col(c)
            for c in synth.columns
        ]
    )


def sanitise(
    candidate: DataFrame | None,
    real: DataFrame | None,
    epsilon: float,
    iteration: int,
    seed: int,
    row_id: Column,
    exclude: tuple[str, ...] = (),
) -> tuple[DataFrame | None, dict, str]:
    """Noise, then the real range; returns the table, its proof and a status."""
    target = candidate if candidate is not None else real
    if target is None:
        return None, {}, "Failed"
    spent = epsilon * max(iteration, 1) ** 0.5
    out = laplace_noise(target, spent, seed, row_id, exclude)
    if real is not None:
        out = quantile_match(out, real, exclude)
    return out, proof_record(spent), "Privacy-Cleared"


NOISE_NAME = "Laplace"
MECHANISM_NAME = "Laplace noise + range matching"
STATEMENT = "Laplace noise of the stated epsilon per numeric column; no formal guarantee is claimed."


def proof_record(epsilon: float) -> dict:
    return {
        "epsilon": float(epsilon),
        "delta": C.DEFAULT_DELTA,
        "noise_distribution": NOISE_NAME,
        "mechanism": MECHANISM_NAME,
        "compliance_statement": STATEMENT,
    }


def privacy_budget(df: DataFrame, epsilon: str, iteration: str) -> DataFrame:
    """Add total_epsilon and delta to a table of (epsilon, iteration)."""
    base = F.coalesce(F.col(epsilon), F.lit(C.DEFAULT_EPSILON))
    return df.withColumn("total_epsilon", total_epsilon(base, F.col(iteration))).withColumn("delta", F.lit(C.DEFAULT_DELTA))


def proof_columns(epsilon: Column) -> list[Column]:
    return [
        epsilon.alias("epsilon"),
        F.lit(C.DEFAULT_DELTA).alias("delta"),
        F.lit(NOISE_NAME).alias("noise_distribution"),
        F.lit(MECHANISM_NAME).alias("mechanism"),
        F.lit(STATEMENT).alias("compliance_statement"),
    ]


def linkability(pair: Pair, exclude: tuple[str, ...] = (), digest_text: bool = False) -> DataFrame:
    """Distinct rows that occur on both sides: (exact_matches, is_compliant).

    Rows are grouped by all columns with a flag per side, so copies are merged
    before the shuffle. A row with a missing value equals nothing. Long texts
    can be compared by their SHA-256 instead of being shuffled whole.
    """
    names = [c for c in pair.columns if c not in exclude]
    texts = set(string_columns(pair.tagged)) if digest_text else set()
    keys = [F.sha2(F.col(c), 256).alias(c) if c in texts else F.col(c) for c in names]
    rows = pair.tagged.dropna("any", subset=names).select(IS_REAL, *keys)
    both = (
        rows.groupBy(*names)
        .agg(F.bool_or(F.col(IS_REAL)).alias("_in_real"), F.bool_or(~F.col(IS_REAL)).alias("_in_synth"))
        .where(F.col("_in_real") & F.col("_in_synth"))
    )
    return both.agg(F.count(F.lit(1)).alias("exact_matches")).select(
        "exact_matches", (F.col("exact_matches") == 0).alias("is_compliant")
    )


def k_anonymity(df: DataFrame, quasi: list[str]) -> DataFrame:
    """Smallest group over the quasi-identifiers; 1 without any."""
    if not quasi or any(c not in df.columns for c in quasi):
        return one_row(df, k=1).select(F.col("k").cast("bigint").alias("k"))
    groups = df.dropna("any", subset=quasi).groupBy(*quasi).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.min("n"), F.lit(1)).cast("bigint").alias("k"))
