"""Small column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlens import constants as C


def clip(col: Column, low, high, present: Column | bool | None = None) -> Column:
    """Bound a value on both sides.

    ``greatest``/``least`` skip nulls, so the null has to be kept by hand.
    ``present`` tells more cheaply than ``col`` itself where there is a value;
    True means everywhere.
    """
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    bounded = F.greatest(low, F.least(high, col))
    if present is True:
        return bounded
    return F.when(col.isNotNull() if present is None else present, bounded)


def market_regime(returns: Column) -> Column:
    """Bull above +1 %, Bear below -1 %, Volatile between, NaN included."""
    known = returns.isNotNull() & ~F.isnan(returns)
    return (
        F.when(known & (returns > F.lit(0.01)), F.lit("Bull"))
        .when(known & (returns < F.lit(-0.01)), F.lit("Bear"))
        .otherwise(F.lit("Volatile"))
    )


def risk_epsilon(level: Column) -> Column:
    """Epsilon of a risk level; an unknown level counts as medium."""
    out = F.lit(C.RISK_EPSILON["medium"])
    name = F.lower(level)
    for risk, epsilon in C.RISK_EPSILON.items():
        if epsilon != C.RISK_EPSILON["medium"]:
            out = F.when(name == F.lit(risk), F.lit(epsilon)).otherwise(out)
    return out


def total_epsilon(epsilon: Column, iteration: Column) -> Column:
    """Budget of a round: it grows with the root of the round number."""
    return epsilon * F.sqrt(F.greatest(iteration, F.lit(1)).cast("double"))


def fixed(col: Column, places: int) -> Column:
    """Decimal text that does not depend on how a double prints."""
    return col.cast(f"decimal(20,{places})").cast("string")


def missing_fields(present: Column, required) -> Column:
    """Required names that are not in the array ``present``, in their own order."""
    return F.array_except(F.array(*[F.lit(f) for f in required]), present)


def found_fields(present: Column, wanted) -> Column:
    return F.array_intersect(F.array(*[F.lit(f) for f in wanted]), present)
