"""Private histograms by multiplicative weights (Hardt, Ligett, McSherry 2012).

The table is reduced to cells once, by one aggregate. The rounds then work on
the cell table only: one- and two-column value counts are answered by one
aggregate, the exponential mechanism picks a badly answered one, it is measured
with Laplace noise, and the weights of its cells are updated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions.hashrand import laplace, uniform
from twinlens.operators.columns import unused
from twinlens.operators.synthesizers import counted_cells, draw_cells
from twinlens.session import settle

CELL_LIMIT = 1_000_000
SHARES = 1 << 32


def cell_counts(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """Rows per combination of the cell columns, as ``n``; null is a value like any other."""
    named = [col.alias(name) for name, col in cells.items()]
    return df.select(*named).groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))


def domain_cells(counts: DataFrame, names: list[str]) -> DataFrame:
    """All combinations of the values each column takes, with their counts.

    Empty cells belong to the domain: leaving them out would tell which
    combinations occur. The number of combinations is checked first.
    """
    tables = [settle(counts.select(F.col(f"`{c}`").alias("value")).distinct().limit(CELL_LIMIT + 1)) for c in names]
    sizes = [t.count() for t in tables]
    size = math.prod(sizes)
    if size > CELL_LIMIT:
        raise ValueError(f"the cell columns span {size} combinations; use coarser buckets")
    # Cell number id in mixed radix: no column is ever paired with another.
    domain = counts.sparkSession.range(size)
    step, radix = size, []
    for values, length in zip(tables, sizes):
        step //= length or 1
        radix.append((values.select((F.row_number().over(Window.orderBy("value")) - 1).alias("at"), "value"), step, length))  # CELL_LIMIT rows at most
    for i, (values, step, length) in enumerate(radix):
        at = F.floor(F.col("id") / F.lit(step)) % F.lit(length)
        domain = domain.withColumn("at", at).join(values, "at").drop("at").withColumnRenamed("value", f"c{i}")
    domain = domain.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
    same = reduce(and_, [domain[c].eqNullSafe(counts[c]) for c in names])
    return domain.join(counts, same, "left").select(*[domain[c] for c in names], F.coalesce("n", F.lit(0)).cast("double").alias("n"))


@dataclass(frozen=True)
class Step:
    """One multiplicative update: every cell of the query gets ``delta``."""

    query: str
    delta: float


def _query_names(names: list[str]) -> list[Column]:
    """The counting queries a cell belongs to: its value in each column, and its
    value pair in each two columns."""

    def part(c: str) -> Column:
        return F.coalesce(F.concat(F.lit(f"{c}="), F.col(c).cast("string")), F.lit(f"{c} is null"))

    one = [part(c) for c in names]
    two = [F.concat_ws("&", part(a), part(b)) for i, a in enumerate(names) for b in names[i + 1 :]]
    return [*one, *two]


def _weight(steps: list[Step]) -> Column:
    """Cell weight after the given updates: one flat sum, so rounds add a term
    to an expression and nothing to the lineage."""
    total = F.lit(0.0)
    for s in steps:
        total = total + F.when(F.array_contains("_queries", s.query), F.lit(s.delta)).otherwise(F.lit(0.0))
    return F.exp(total)


def _log_odds(answer: float, total: float) -> float:
    """Log odds of a query's share, at least half a row away from none and all."""
    share = min(max(answer, 0.5), total - 0.5) / total
    return math.log(share / (1.0 - share))


def mwem(
    df: DataFrame, cells: dict[str, Column], epsilon: float = C.DEFAULT_EPSILON, rounds: int = 10, seed: int = C.DEFAULT_SEED
) -> DataFrame:
    """(cell columns, weight): a synthetic histogram whose total is the table's.

    Half of each round's share of epsilon picks the query, half measures it. The
    weights of the query's cells are then moved until the histogram gives the
    measured answer; repeating the small steps of the paper ends there, so the
    end is taken at once. The seed stands for the mechanism's randomness and
    must stay secret. The row count itself is taken as public.
    """
    names = list(cells)
    counts = settle(cell_counts(df, cells))  # the only look at the rows
    table = settle(domain_cells(counts, names).withColumn("_queries", F.array(*_query_names(names))))
    total = float(table.agg(F.sum("n")).first()[0] or 0.0)
    if total < 2:
        return table.select(*names, F.col("n").alias("weight"))
    share = epsilon / (2.0 * rounds)
    steps: list[Step] = []
    for r in range(rounds):
        weight = _weight(steps)
        norm = table.agg(F.sum(weight)).first()[0]
        estimate = F.col("w") * F.lit(total / norm)
        gumbel = -F.ln(-F.ln(uniform(seed, F.col("query"), f"pick{r}")))
        noise = laplace(seed, F.col("query"), f"measure{r}", 1.0 / share)
        picked = (
            table.select("n", weight.alias("w"), F.explode("_queries").alias("query"))
            .groupBy("query")
            .agg(F.sum("n").alias("true"), F.sum("w").alias("w"))
            .select(
                "query",
                (F.col("true") + noise).alias("measured"),
                estimate.alias("estimate"),
                (F.lit(share / 2.0) * F.abs(F.col("true") - estimate) + gumbel).alias("score"),
            )
            .orderBy(F.desc("score"), "query")
            .first()
        )
        steps.append(Step(picked["query"], _log_odds(picked["measured"], total) - _log_odds(picked["estimate"], total)))
    weight = _weight(steps)
    norm = table.agg(F.sum(weight)).first()[0]
    return table.select(*names, (weight * F.lit(total / norm)).alias("weight"))


def sample_histogram(histogram: DataFrame, names: list[str], ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """One cell per row id, drawn by cumulative weight.

    Weights become whole shares of 2^32, as fine as the draws; every cell of any
    weight keeps at least one. Row ids and cells meet by a join, whatever their number.
    """
    total = histogram.agg(F.sum("weight").alias("total"))
    share = F.ceil(F.col("weight") / total.scalar() * F.lit(float(SHARES))).cast("bigint")
    keys = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    tally = histogram.where(F.col("weight") > 0).select(F.lit(0).alias("component"), *keys, share.alias("n"))
    cells = counted_cells(tally, names)
    place = unused([row_id, *names], "_place")
    at = cells.place(F.lit(0), uniform(seed, F.col(row_id), "cell"))
    return draw_cells(ids.select(F.col(row_id).cast("bigint").alias(row_id), at.alias(place)), place, cells)
