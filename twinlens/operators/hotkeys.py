"""Joins on keys of which one may hold any share of the rows.

A hash join deals all rows of a key to one task. Keys with more than one in ``SHARE``
of the rows are told apart first: there are fewer than ``SHARE`` of them, so their part
of the lookup table is broadcast whatever the size of the data. All other
keys are small and go through an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from more than one in so many rows ...
SHARE = 1000
#: ... and from so many rows on; fewer are no burden for a task.
LEAST_ROWS = 1000


def hot_keys(rows: DataFrame, keys: list[str], least_rows: int | None = None) -> list[tuple]:
    """The keys that hold more than one in ``SHARE`` of the rows: fewer than ``SHARE``."""
    counts = rows.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bound = rows.agg(F.greatest(F.count(F.lit(1)) / SHARE, F.lit(LEAST_ROWS if least_rows is None else least_rows)).alias("_least"))
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("_n") > bound.scalar()).collect()]


def hot_of(counts: DataFrame, keys: list[str], count: str, total: int) -> list[tuple]:
    """As ``hot_keys``, for a caller who has the rows of each key, and of all keys, already."""
    least = max(total / SHARE, LEAST_ROWS)
    return [tuple(r[k] for k in keys) for r in counts.where(F.col(count) > least).select(*keys).collect()]


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", least_rows: int | None = None, found: list[tuple] | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which holds each key once; ``how`` is inner, left,
    left_semi or left_anti. ``rows`` is read three times, so it should be a stored
    table. A null key meets nothing; with left and left_anti its row stays. With
    ``found``, the hot keys of ``hot_of``, rows without hot keys are read once."""
    found = hot_keys(rows, keys, least_rows) if found is None else found
    if not found:
        return rows.join(table, keys, how)
    schema = table.select(*keys).schema
    hot = rows.sparkSession.createDataFrame(found, schema)
    own = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    cold = rows.join(F.broadcast(hot), keys, "left_anti")
    warm = rows.join(F.broadcast(hot), keys, "left_semi")
    return cold.join(table, keys, how).unionByName(warm.join(own, keys, how))
