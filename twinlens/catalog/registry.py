"""Named queries over the supplied tables, each beside the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.operators.pair import Pair


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def first_half(key: str) -> Column:
    """Even split of a table by the digest of a key: both parts are used whole."""
    return F.md5(F.col(key).cast("string")) < F.lit("8")


def halves(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> Pair:
    """One half of a table as the real side, the other as the synthetic side."""
    names = list(columns) or table(spark, sf_dir, name).columns
    df = table(spark, sf_dir, name)
    return Pair.split(df, first_half(key), names)


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- SQL fragments -----------------------------------------------------------


def sql_uniform(seed: int, row_id: str, stream: str, slot: int = 0) -> str:
    hexed = f"substr(md5(concat_ws('|', '{seed}', CAST({row_id} AS VARCHAR), '{stream}')), {1 + 8 * slot}, 8)"
    return f"((CAST('0x' || {hexed} AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_normal(seed: int, row_id: str, stream: str) -> str:
    return (
        f"(sqrt(-2.0::DOUBLE * ln({sql_uniform(seed, row_id, stream, 0)})) "
        f"* cos(2.0::DOUBLE * pi() * {sql_uniform(seed, row_id, stream, 1)}))"
    )


def sql_laplace(seed: int, row_id: str, stream: str, scale: str) -> str:
    u = f"({sql_uniform(seed, row_id, stream)} - 0.5::DOUBLE)"
    return f"(-({scale}) * sign({u}) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({u})))"


def sql_first_half(key: str) -> str:
    return f"(md5(CAST({key} AS VARCHAR)) < '8')"


def sql_sides(name: str, key: str) -> str:
    return f"(SELECT *, {sql_first_half(key)} AS is_real FROM {name})"


def sql_long(source: str, columns, cast: str, keep: str = "is_real") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS {cast}) AS v{', ' + keep if keep else ''} FROM {source} WHERE {c} IS NOT NULL" for c in columns
    )
