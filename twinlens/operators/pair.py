"""The (real, synthetic) pair: one tagged table, so each metric scans it once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens.operators.columns import is_numeric, numeric_columns, shared_columns, string_columns

IS_REAL = "is_real"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing here, as null does."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _common_type(a: T.DataType, b: T.DataType) -> str | None:
    """What two types meet in; whole numbers stay whole, as keys above 2^53 must."""
    if a == b:
        return None
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return "bigint"
    return "double" if is_numeric(a) and is_numeric(b) else "string"


@dataclass(frozen=True)
class Pair:
    """``tagged`` holds the shared columns of both sides and ``is_real``."""

    tagged: DataFrame

    @classmethod
    def of(cls, real: DataFrame, synth: DataFrame) -> "Pair":
        names = shared_columns(real, synth)
        if not names:
            raise ValueError("the two tables share no column")
        casts = {c: _common_type(real.schema[c].dataType, synth.schema[c].dataType) for c in names}

        def side(df: DataFrame, flag: bool) -> DataFrame:
            cols = [F.col(c).cast(casts[c]).alias(c) if casts[c] else F.col(c) for c in names]
            return nan_to_null(df.select(*cols)).withColumn(IS_REAL, F.lit(flag))

        return cls(side(real, True).unionByName(side(synth, False)))

    @classmethod
    def split(cls, df: DataFrame, real: Column, columns: list[str] | None = None) -> "Pair":
        """Both sides from one table: rows where ``real`` holds, and all others."""
        names = columns or df.columns
        flagged = df.select(*names, F.coalesce(real, F.lit(False)).alias(IS_REAL))
        return cls(nan_to_null(flagged))

    def select(self, *names: str) -> "Pair":
        return Pair(self.tagged.select(*names, IS_REAL))

    @property
    def real(self) -> DataFrame:
        return self.tagged.where(F.col(IS_REAL)).drop(IS_REAL)

    @property
    def synth(self) -> DataFrame:
        return self.tagged.where(~F.col(IS_REAL)).drop(IS_REAL)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.tagged.columns if c != IS_REAL]

    @property
    def numeric(self) -> list[str]:
        return [c for c in numeric_columns(self.tagged) if c != IS_REAL]

    @property
    def strings(self) -> list[str]:
        return string_columns(self.tagged)
