"""Row cleaning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators.columns import numeric_columns, string_columns


def drop_null_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN anywhere."""
    return df.dropna("any", subset=columns)


def fill_nulls(df: DataFrame) -> DataFrame:
    """Numbers become 0 and strings "0"."""
    return df.fillna(0, subset=numeric_columns(df)).fillna("0", subset=string_columns(df))


def keep_finite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Keep rows whose numeric columns are all present and finite."""
    keep = F.lit(True)
    for c in columns or numeric_columns(df):
        v = F.col(c).cast("double")
        keep = keep & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    return df.where(keep)
