"""Column reports: summary, histogram, quantile grid, median split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.operators.columns import numeric_columns
from twinlens.operators.ordered import quantiles
from twinlens.operators.profile import long_values


def column_describe(df: DataFrame, columns: list[str] | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated) and max."""
    columns = columns or numeric_columns(df)
    moments = (
        long_values(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    q = quantiles(df, columns, [0.25, 0.5, 0.75], rows_per_bucket)
    wide = q.groupBy("column").agg(
        *[F.max(F.when(F.col("p") == F.lit(p), F.col("q"))).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    )
    return moments.join(wide, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def column_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max; the maximum belongs to the last bin. A column without a value has no bin."""
    v = F.col(column).cast("double")
    bounds = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    low, high = bounds["lo"], bounds["hi"]
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (high - low) / bins or 1.0
    slot = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (
        df.where(v.isNotNull())
        .groupBy(slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("lo"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
            "n",
        )
    )


def quantile_grid(df: DataFrame, column: str, points: int = C.QUANTILE_POINTS, rows_per_bucket: int | None = None) -> DataFrame:
    """(p, q) on an even grid of probabilities, exact."""
    probs = [i / (points - 1) for i in range(points)]
    return quantiles(df, [column], probs, rows_per_bucket).select("p", "q")


def binarise_target(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """1 above the exact median, else 0."""
    median = quantiles(df, [column], [0.5]).select("q")
    return df.withColumn(out, (F.col(column) > median.scalar()).cast("int"))
