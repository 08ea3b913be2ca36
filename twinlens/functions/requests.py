"""Keyword reading of free-text generation requests, over a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C


def _has_any(text: Column, *words: str) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def request_config(df: DataFrame, text: str) -> DataFrame:
    """Add domain, rows, epsilon, model and goal read from the column ``text``.

    The row count needs its noun right after the number; any other wording
    means the default.
    """
    low = F.lower(F.col(text))
    digits = F.regexp_extract(low, r"([0-9]+)\s*(rows|records|samples)", 1)
    rows = F.coalesce(F.expr("try_cast(_digits AS BIGINT)"), F.lit(C.DEFAULT_ROWS).cast("bigint"))
    return (
        df.withColumn("_digits", digits)
        .withColumn(
            "domain",
            F.when(_has_any(low, "finance", "transaction", "fraud"), F.lit("Finance")).otherwise(F.lit("Healthcare")),
        )
        .withColumn("rows", rows)
        .withColumn(
            "epsilon",
            F.when(_has_any(low, "high privacy", "strict"), F.lit(0.5))
            .when(_has_any(low, "high fidelity", "accurate"), F.lit(5.0))
            .otherwise(F.lit(1.0)),
        )
        .withColumn(
            "model",
            F.when(low.contains("timegan"), F.lit("timegan"))
            .when(low.contains("vae"), F.lit("vae"))
            .when(low.contains("diffusion"), F.lit("diffusion"))
            .otherwise(F.lit("auto")),
        )
        .withColumn("goal", F.substring(F.col(text), 1, C.GOAL_LENGTH))
        .drop("_digits")
    )


def normal_domain(domain: Column) -> Column:
    """Known domains capitalised, anything else Healthcare."""
    return F.when(F.lower(domain).isin("healthcare", "finance"), F.initcap(domain)).otherwise(F.lit("Healthcare"))
