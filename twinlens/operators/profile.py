"""One-pass column profiles and the decisions that rest on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.operators.columns import (
    judge_id_name,
    metric_id_name,
    numeric_columns,
    string_columns,
)
from twinlens.operators.pair import IS_REAL, Pair, nan_to_null

# Sketch size (log2) with a standard error of about 0.33 %, and the margin (over
# five of them) inside which a decision is taken from an exact count instead.
SKETCH_LOG = 16
SKETCH_MARGIN = 0.02
EXACT_BELOW = 1000


@dataclass(frozen=True)
class SideStats:
    count: int
    low: float | None
    high: float | None

    @property
    def span(self) -> float:
        return 0.0 if self.low is None or self.high is None else self.high - self.low


@dataclass(frozen=True)
class PairStats:
    """Bounded driver-side numbers: a few per column."""

    rows: dict[bool, int]
    sides: dict[tuple[str, bool], SideStats]
    sketched: dict[str, tuple[int, int]]  # real side: non-null count, estimated distinct count

    def side(self, column: str, real: bool) -> SideStats:
        return self.sides.get((column, real), SideStats(0, None, None))

    @property
    def total(self) -> int:
        return sum(self.rows.values())


def _sketch(c: str) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c))), SKETCH_LOG))


def pair_stats(pair: Pair, columns: list[str], sketch: bool = False) -> PairStats:
    """Counts, bounds and (asked for) distinct estimates of both sides: one
    aggregate over one scan, two rows back."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        if sketch:
            aggs.append(_sketch(c).alias(f"d{i}"))
    rows, sides, sketched = {True: 0, False: 0}, {}, {}
    for r in pair.tagged.groupBy(IS_REAL).agg(*aggs).collect():
        rows[r[IS_REAL]] = r["rows"]
        for i, c in enumerate(columns):
            sides[(c, r[IS_REAL])] = SideStats(r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"])
            if sketch and r[IS_REAL]:
                sketched[c] = (r[f"n{i}"], min(r[f"d{i}"] or 0, r[f"n{i}"]))
    return PairStats(rows, sides, sketched)


def settle_distinct(
    df: DataFrame, rows: int, estimates: dict[str, tuple[int, int]], ratios: tuple[float, ...] = (), small: bool = False
) -> dict[str, tuple[int, int]]:
    """Replace estimates that a decision could hang on by exact counts: those
    with a distinct share near one of ``ratios`` and, with ``small``, those of
    few values."""
    unsure = [
        c
        for c, (n, d) in estimates.items()
        if (small and d <= EXACT_BELOW)
        or any(abs(d - t * base) <= SKETCH_MARGIN * max(base, 1) + 2 for t in ratios for base in (n, rows))
    ]
    if not unsure:
        return estimates
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(f"x{i}") for i, c in enumerate(unsure)]).first()
    return {**estimates, **{c: (estimates[c][0], exact[f"x{i}"]) for i, c in enumerate(unsure)}}


def distinct_counts(
    df: DataFrame, columns: list[str], ratios: tuple[float, ...] = (), small: bool = False
) -> tuple[int, dict[str, tuple[int, int]]]:
    """Row count and, per column, (non-null count, distinct count).

    A sketch settles every column that is far from all thresholds, the rest is
    counted exactly: a unique column of a huge table costs no shuffle.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.count(F.col(c)).alias(f"n{i}"), _sketch(c).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    estimates = {c: (row[f"n{i}"], min(row[f"d{i}"] or 0, row[f"n{i}"])) for i, c in enumerate(columns)}
    return row["rows"], settle_distinct(df, row["rows"], estimates, ratios, small)


def _judge_rule(name: str, rows: int, counts: dict[str, tuple[int, int]]) -> bool:
    return judge_id_name(name) or (name in counts and counts[name][1] > C.JUDGE_UNIQUE_RATIO * rows)


def _metric_rule(name: str, counts: dict[str, tuple[int, int]]) -> bool:
    n, d = counts.get(name, (0, 0))
    return metric_id_name(name) or (n > C.METRIC_UNIQUE_MIN_ROWS and d / n > C.METRIC_UNIQUE_RATIO)


def judge_ids(df: DataFrame, columns: list[str] | None = None) -> dict[str, bool]:
    """Judge's rule: a key-like name, or a numeric column over 90 % distinct."""
    columns = columns or df.columns
    numeric = [c for c in numeric_columns(df) if c in columns and not judge_id_name(c)]
    rows, counts = distinct_counts(df, numeric, (C.JUDGE_UNIQUE_RATIO,))
    return {c: _judge_rule(c, rows, counts) for c in columns}


def metric_ids(df: DataFrame, columns: list[str] | None = None) -> dict[str, bool]:
    """Metric rule: a key-like name, or over 95 % distinct among more than 20 values."""
    columns = columns or df.columns
    _, counts = distinct_counts(df, [c for c in columns if not metric_id_name(c)], (C.METRIC_UNIQUE_RATIO,))
    return {c: _metric_rule(c, counts) for c in columns}


def pair_judge_ids(pair: Pair, stats: PairStats) -> dict[str, bool]:
    """``judge_ids`` of the real side from statistics already taken."""
    open_ones = {c: v for c, v in stats.sketched.items() if not judge_id_name(c)}
    counts = settle_distinct(pair.real, stats.rows[True], open_ones, (C.JUDGE_UNIQUE_RATIO,))
    return {c: _judge_rule(c, stats.rows[True], counts) for c in pair.numeric}


def pair_metric_ids(pair: Pair, stats: PairStats, columns: list[str]) -> dict[str, bool]:
    """``metric_ids`` of the real side from statistics already taken."""
    open_ones = {c: stats.sketched[c] for c in columns if c in stats.sketched and not metric_id_name(c)}
    counts = settle_distinct(pair.real, stats.rows[True], open_ones, (C.METRIC_UNIQUE_RATIO,))
    return {c: _metric_rule(c, counts) for c in columns}


def pick_target(df: DataFrame) -> str | None:
    """Outcome column: a known name, else the first two-valued number, else the
    first number with 3-10 values, else the first string with fewer than 10."""
    for name in C.TARGET_NAMES:
        if name in df.columns:
            return name
    numbers, strings = numeric_columns(df), string_columns(df)
    _, counts = distinct_counts(df, numbers + strings, small=True)
    for c in numbers:
        if counts[c][1] == 2:
            return c
    for c in numbers:
        if 3 <= counts[c][1] <= 10:
            return c
    for c in strings:
        if counts[c][1] < 10:
            return c
    return None


def long_values(df: DataFrame, columns: list[str], keep: tuple[str, ...] = (), cast: str = "double") -> DataFrame:
    """(keep..., column, value): one row per cell, nulls left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells)).where(F.col("value").isNotNull())


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n, nulls, exact distinct count, min and max of numeric columns.

    Values are counted per (column, value) before anything is grouped by
    column, so a hot value or a long column never lands in one task.
    """
    columns = columns or numeric_columns(df)
    df = nan_to_null(df.select(*columns))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    per_value = long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per_column = per_value.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return per_column.select("column", "n", (rows.scalar() - F.col("n")).alias("nulls"), "distinct", "min", "max")


def literal_lookup(key: Column, values: dict[str, float | int]) -> Column:
    """A small driver-side table as an expression."""
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(key == F.lit(name), F.lit(value)).otherwise(out)
    return out
