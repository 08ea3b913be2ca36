"""Column classes, shared columns and the identifier rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinlens import constants as C


def is_numeric(data_type: T.DataType) -> bool:
    """Numbers only; booleans, dates and nested types take no part in metrics."""
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def unused(taken, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def quasi_identifiers(df: DataFrame, count: int = 2) -> list[str]:
    return string_columns(df)[:count]


def shared_columns(real: DataFrame, synth: DataFrame) -> list[str]:
    there = set(synth.columns)
    return [c for c in real.columns if c in there]


def judge_id_name(name: str) -> bool:
    low = name.lower()
    return low in C.JUDGE_ID_NAMES or low.endswith("_id") or low.startswith("id_")


def metric_id_name(name: str) -> bool:
    low = name.lower()
    return low == "id" or any(low.startswith(k) or low.endswith(k) for k in C.METRIC_ID_KEYWORDS)


def attack_id_name(name: str) -> bool:
    low = name.lower()
    return low.endswith("_id") or low in C.ATTACK_ID_NAMES


def noise_id_name(name: str) -> bool:
    low = name.lower()
    return low.endswith("_id") or low in C.NOISE_ID_NAMES
