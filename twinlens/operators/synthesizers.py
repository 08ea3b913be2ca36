"""Table samplers fitted by Spark jobs.

All of them learn bounded summaries (quantile grids, category shares, a small
matrix) from the whole table and then draw each row from its row id alone. Columns
with many categories are drawn from a settled table of their values, never on the
driver. Dates and times are drawn as numbers, booleans as categories; every column
of the table comes back, in its place and type. The mixture and latent samplers
fill the slots of neural generators without being any; they are named for what
they are.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlens import constants as C
from twinlens.functions import hashrand as H
from twinlens.operators import fidelity
from twinlens.operators.columns import numeric_columns, string_columns, unused
from twinlens.operators.ordered import quantiles
from twinlens.operators.pair import Pair, nan_to_null
from twinlens.operators.profile import distinct_counts, long_values
from twinlens.session import settle, stored

GRID = 1001
CATEGORY_LIMIT = 1000  # more categories than that are drawn by a join
SLICE = 250_000  # rows of the table that one slice of a category join stands for
NORMAL = NormalDist()
Z_POINTS = 4001
P_GRID = [(i + 0.5) / Z_POINTS for i in range(Z_POINTS)]
Z_GRID = [NORMAL.inv_cdf(p) for p in P_GRID]


@dataclass(frozen=True)
class Values:
    """All values of a column: (value, start, n), where start counts the rows of values before."""

    table: DataFrame
    rows: int


@dataclass(frozen=True)
class Marginals:
    """Per-column summaries of a table; bounded but for ``large``, which stays in Spark."""

    schema: T.StructType
    numeric: dict[str, np.ndarray]  # quantile grid
    category: dict[str, tuple[list[str], np.ndarray]]  # values and shares
    opaque: list[str]  # strings that are nearly all different: replaced by fresh tokens
    null_share: dict[str, float] = field(default_factory=dict)
    large: dict[str, Values] = field(default_factory=dict)  # strings of many values

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def modelled(self) -> list[str]:
        return [c for c in self.columns if c in self.numeric or c in self.category or c in self.large]

    def ddl(self, row_id: str, columns: list[str]) -> str:
        """Types that draws have before ``_restored``; many-valued columns are drawn as a share."""
        kinds = {c: "string" if c in self.category else "bigint" if self.whole(c) else "double" for c in columns}
        return ", ".join([f"`{row_id}` bigint"] + [f"`{c}` {kind}" for c, kind in kinds.items()])

    def whole(self, column: str) -> bool:
        return isinstance(self.schema[column].dataType, T.IntegralType)


def plain(df: DataFrame) -> DataFrame:
    """Dates as days, times as seconds, booleans as texts; NaN is null."""
    kinds = {
        T.DateType: lambda c: F.unix_date(c).cast("double"),
        T.TimestampType: lambda c: c.cast("double"),
        T.TimestampNTZType: lambda c: c.cast("timestamp").cast("double"),
        T.BooleanType: lambda c: c.cast("string"),
    }
    return nan_to_null(df.select(*[kinds.get(type(f.dataType), lambda c: c)(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema]))


def _restored(cell: Column, data_type: T.DataType) -> Column:
    """A drawn number or text in the column's own type."""
    if isinstance(data_type, T.DateType):
        return F.date_from_unix_date(F.bround(cell, 0).cast("int"))
    if isinstance(data_type, T.TimestampNTZType):
        return cell.cast("timestamp").cast("timestamp_ntz")
    if isinstance(data_type, T.IntegralType):
        cell = F.bround(cell, 0)
    return cell.cast(data_type)


def value_table(df: DataFrame, column: str) -> DataFrame:
    """(value, start, n) of the column's values, in order of their digests. Even
    buckets of digests are summed up on their own, so no task holds the column."""
    tally = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return settle(_runs(tally, [], ["value"], F.md5("value")))


def _runs(tally: DataFrame, first: list[str], names: list[str], digest: Column) -> DataFrame:
    """(first..., names..., start, n): the rows of each entry and those of all entries
    before it, by ``first``, digest bucket and ``names``. ``first`` takes few values."""
    tally = tally.withColumn("bucket", F.substring(digest, 1, 3))
    chain = Window.orderBy(*first, "bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows at most for each ``first``
    before = tally.groupBy(*first, "bucket").agg(F.sum("n").alias("all")).select(*first, "bucket", F.coalesce(F.sum("all").over(chain), F.lit(0)).alias("before"))
    local = Window.partitionBy(*first, "bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(local), F.lit(0))
    return tally.join(before, [*first, "bucket"]).select(*first, *names, start.alias("start"), "n")


@dataclass(frozen=True)
class Cells:
    """Combinations of values by component: (component, c0, c1, ..., start, n). The
    rows of a component are one run of row numbers, ``spans[component]`` = (first, rows)."""

    table: DataFrame
    names: list[str]
    spans: dict[int, tuple[int, int]]

    def place(self, component: Column, share: Column) -> Column:
        """Row number at ``share`` of the component's rows; of all rows, if it has none."""
        whole = (0, sum(n for _, n in self.spans.values()))

        def within(span: tuple[int, int]) -> Column:
            first, n = span
            return F.lit(first) + F.least(F.floor(share * F.lit(float(n))).cast("bigint"), F.lit(n - 1))

        out = within(whole)
        for k, span in self.spans.items():
            out = F.when(component == F.lit(k), within(span)).otherwise(out)
        return out


def cell_table(df: DataFrame, component: Column, names: list[str]) -> Cells:
    """How often each combination of the text columns ``names`` occurs within each of a
    few components; null is a value. Combinations are counted before anything is
    ordered and stay in Spark, however many there are."""
    keys = [f"c{i}" for i in range(len(names))]
    rows = df.select(component.cast("int").alias("component"), *[F.col(f"`{c}`").alias(k) for c, k in zip(names, keys)])
    return counted_cells(rows.groupBy("component", *keys).agg(F.count(F.lit(1)).alias("n")), names)


def counted_cells(tally: DataFrame, names: list[str]) -> Cells:
    """As ``cell_table``, of (component, c0, c1, ..., n) with each combination once."""
    keys = [f"c{i}" for i in range(len(names))]
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.col(k).cast("string")), F.lit("null")) for k in keys]))
    table = stored(_runs(tally, ["component"], keys, digest), "cells")
    spans = table.groupBy("component").agg(F.min("start").alias("first"), F.sum("n").alias("n")).orderBy("component").collect()
    return Cells(table, names, {r["component"]: (r["first"], r["n"]) for r in spans})


def draw_cells(drawn: DataFrame, place: str, cells: Cells) -> DataFrame:
    """``drawn`` with the combination that holds row number ``place`` instead of that column."""
    keys = [f"c{i}" for i in range(len(cells.names))]
    cell = unused([*drawn.columns, *cells.names], "_cell")
    entries = cells.table.select(F.struct(*keys).alias("value"), "start", "n")
    found = _at_rows(drawn, F.col(place), entries, cell)
    kept = [c for c in drawn.columns if c != place]
    return found.select(*[F.col(f"`{c}`") for c in kept], *[F.col(cell)[k].alias(c) for k, c in zip(keys, cells.names)])


def look_up(drawn: DataFrame, share: Column, values: Values, out: str) -> DataFrame:
    """Add ``out``: the value whose run of rows holds the row number ``share * rows``."""
    position = F.least(F.floor(share * F.lit(float(values.rows))).cast("bigint"), F.lit(values.rows - 1))
    return _at_rows(drawn, position, values.table, out)


def _at_rows(drawn: DataFrame, position: Column, entries: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the ``value`` of the entry whose run of rows holds ``position``.

    Values and draws of one slice of row numbers are sorted together and the last
    value carried on, so the work is linear; a value of many rows has an entry in
    each of its slices, and uniform draws are even over the slices."""
    size = F.lit(SLICE)
    spans = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size))
    entries = entries.select("value", "start", F.explode(spans).alias("slice"))
    entries = entries.select("slice", F.greatest(F.col("start"), F.col("slice") * size).alias("at"), F.lit(0).alias("kind"), "value")
    asked = drawn.select(position.alias("at"), F.struct("*").alias("row"))
    asked = asked.select(F.floor(F.col("at") / size).alias("slice"), "at", F.lit(1).alias("kind"), "row")
    run = Window.partitionBy("slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = entries.unionByName(asked, allowMissingColumns=True).withColumn("value", F.last("value", ignorenulls=True).over(run))
    return both.where("kind = 1").select(*[F.col("row").getField(c).alias(c) for c in drawn.columns if c != out], F.col("value").alias(out))


def fit_marginals(df: DataFrame, exclude: tuple[str, ...] = (), grid: int = GRID) -> Marginals:
    """Exact quantile grids of numbers and exact shares of categories. A text column
    counts as an identifier by the metric rule: nearly all values differ."""
    schema = df.drop(*exclude).schema
    df = plain(df.drop(*exclude))
    numbers, strings = numeric_columns(df), string_columns(df)
    rows, counts = distinct_counts(df, numbers + strings, (C.METRIC_UNIQUE_RATIO,), small=True)
    numbers = [c for c in numbers if counts[c][0]]
    strings = [c for c in strings if counts[c][0]]
    opaque = [c for c in strings if counts[c][0] > C.METRIC_UNIQUE_MIN_ROWS and counts[c][1] / counts[c][0] > C.METRIC_UNIQUE_RATIO]
    few = [c for c in strings if c not in opaque and counts[c][1] <= CATEGORY_LIMIT]
    grids: dict[str, np.ndarray] = {}
    if numbers:
        found = quantiles(df, numbers, [i / (grid - 1) for i in range(grid)]).collect()  # columns x grid
        for c in numbers:
            grids[c] = np.array([q for _, q in sorted((r["p"], r["q"]) for r in found if r["column"] == c)])
    shares: dict[str, tuple[list[str], np.ndarray]] = {}
    if few:
        tally = long_values(df, few, cast="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        found = tally.collect()  # columns x CATEGORY_LIMIT
        for c in few:
            pairs = sorted((r["value"], r["n"]) for r in found if r["column"] == c)
            n = np.array([x for _, x in pairs], dtype=float)
            shares[c] = ([v for v, _ in pairs], n / n.sum())
    large = {c: Values(value_table(df, c), counts[c][0]) for c in strings if c not in opaque and c not in few}
    nulls = {c: 1.0 - counts[c][0] / rows for c in numbers + strings if counts[c][0] < rows}
    return Marginals(schema, grids, shares, opaque, nulls, large)


def literal_array(values) -> Column:
    """A constant array as one literal."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _token(column: str, row_id: Column, seed: int) -> Column:
    return F.concat(F.lit("id-"), F.substring(H.digest(seed, row_id, column), 1, 12))


def sample_marginals(m: Marginals, ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """Each column on its own, by inverse distribution function at a row uniform."""
    rid = F.col(row_id)
    cells = []
    for c in m.columns:
        u = H.uniform(seed, rid, c)
        if c in m.numeric:
            grid = literal_array(m.numeric[c])
            at = u * F.lit(float(len(m.numeric[c]) - 1))
            low = F.element_at(grid, F.floor(at).cast("int") + 1)
            high = F.element_at(grid, F.floor(at).cast("int") + 2)
            cells.append((low + (high - low) * (at - F.floor(at))).alias(c))
        elif c in m.category:
            values, shares = m.category[c]
            cells.append(H.pick(H.step_index(u, list(np.cumsum(shares)[:-1])), values).alias(c))
    return _complete(ids.select(rid.cast("bigint").alias(row_id), *cells), m, row_id, seed)


# --------------------------------------------------------------------------
# Normal scores: the shared coordinate system of the copula and latent samplers


def _score_tables(m: Marginals):
    tables = {}
    for c in m.modelled:
        if c in m.large:
            continue
        if c in m.numeric:
            g = m.numeric[c]
            steps = 2 * len(g) + 1
            tables[c] = np.array([NORMAL.inv_cdf(min(max(i / (steps - 1), 0.5 / steps), 1 - 0.5 / steps)) for i in range(steps)])
        else:
            _, shares = m.category[c]
            mid = np.cumsum(shares) - shares / 2
            tables[c] = np.array([NORMAL.inv_cdf(min(max(p, 1e-6), 1 - 1e-6)) for p in mid])
    return tables


def score_correlation(df: DataFrame, m: Marginals) -> np.ndarray:
    """Correlation of normal scores, each over the rows that hold both columns. Tasks
    send d x d partial sums only."""
    cols, tables = m.modelled, _score_tables(m)
    d = len(cols)
    grids, large = dict(m.numeric), set(m.large)
    index = {c: {v: i for i, v in enumerate(values)} for c, (values, _) in m.category.items()}
    z_grid, p_grid = np.array(Z_GRID), np.array(P_GRID)
    rows = plain(df.select(*cols))
    for c, values in m.large.items():  # in place of each value the middle of its share
        middle = (F.col("start") + F.col("n") / 2) / F.lit(float(values.rows))
        rows = rows.join(values.table.select(F.col("value").alias(c), middle.alias("_middle")), c, "left").drop(c).withColumnRenamed("_middle", c)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((4, d, d))
        for batch in batches:
            z, here = np.zeros((len(batch), d)), np.zeros((len(batch), d))
            for j, c in enumerate(cols):
                if c in index:
                    code = batch[c].map(index[c]).to_numpy(dtype=float)
                    known = ~np.isnan(code)
                    z[known, j] = tables[c][code[known].astype(int)]
                else:
                    x = pd.to_numeric(batch[c]).to_numpy(dtype=float)
                    known = ~np.isnan(x)
                    if c in large:
                        z[known, j] = np.interp(x[known], p_grid, z_grid)
                    else:
                        at = np.searchsorted(grids[c], x[known], "left") + np.searchsorted(grids[c], x[known], "right")
                        z[known, j] = tables[c][at]
                here[:, j] = known
            sums += np.stack([z.T @ z, z.T @ here, (z * z).T @ here, here.T @ here])
        i, j = np.divmod(np.arange(d * d), max(d, 1))
        g, s, q, n = sums.reshape(4, -1)
        yield pd.DataFrame({"i": i, "j": j, "g": g, "s": s, "q": q, "n": n})

    parts = rows.select(*cols).mapInPandas(partial, "i int, j int, g double, s double, q double, n double")
    g, s, q, n = np.zeros((4, d, d))
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "gsqn"]).collect():  # d x d
        at = (r["i"], r["j"])
        g[at], s[at], q[at], n[at] = r["g"], r["s"], r["q"], r["n"]
    n = np.maximum(n, 1.0)
    cov = g / n - (s / n) * (s.T / n)
    spread = np.sqrt(np.maximum(q / n - (s / n) ** 2, 1e-12))
    corr = np.clip(cov / (spread * spread.T), -1.0, 1.0)
    np.fill_diagonal(corr, 1.0)
    return nearest_correlation(corr)


def nearest_correlation(matrix: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """The correlation matrix nearest to a symmetric one, in the Frobenius norm (Higham
    2002): alternating projections on matrices without negative axes and on those with a unit
    diagonal, the first with Dykstra's correction. Pairwise sums over different rows
    need not give such a matrix; one that is such a matrix comes back as it is."""
    if not len(matrix) or np.linalg.eigvalsh(matrix)[0] >= 0:
        return matrix
    unit, shift = matrix, np.zeros_like(matrix)
    for _ in range(rounds):
        moved = unit - shift
        values, axes = np.linalg.eigh(moved)
        flat = (axes * np.maximum(values, 0.0)) @ axes.T
        shift = flat - moved
        unit = flat.copy()
        np.fill_diagonal(unit, 1.0)
        if np.linalg.norm(unit - flat) <= tolerance * np.linalg.norm(unit):
            break
    return unit


def _sample_scores(m: Marginals, ids: DataFrame, row_id: str, seed: int, draws: int, mix: np.ndarray) -> DataFrame:
    """Rows whose normal scores are ``mix @ z`` for ``draws`` row normals."""
    cols = m.modelled
    rid = F.col(row_id)
    base = ids.select(rid.cast("bigint").alias(row_id), *[H.normal(seed, rid, f"z{i}").alias(f"z{i}") for i in range(draws)])
    grids, category, large = dict(m.numeric), dict(m.category), set(m.large)
    whole = {c: m.whole(c) for c in cols}
    z_grid, p_grid = np.array(Z_GRID), np.array(P_GRID)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = batch[[f"z{i}" for i in range(draws)]].to_numpy() @ mix.T
            p = np.interp(y, z_grid, p_grid)
            out = {row_id: batch[row_id]}
            for j, c in enumerate(cols):
                if c in large:
                    out[c] = p[:, j]
                elif c in grids:
                    x = np.interp(p[:, j] * (len(grids[c]) - 1), np.arange(len(grids[c])), grids[c])
                    out[c] = np.rint(x).astype("int64") if whole[c] else x
                else:
                    values, shares = category[c]
                    code = np.searchsorted(np.cumsum(shares)[:-1], p[:, j], "right")
                    out[c] = np.array(values, dtype=object)[code]
            yield pd.DataFrame(out)

    return _complete(base.mapInPandas(draw, m.ddl(row_id, cols)), m, row_id, seed)


def _complete(drawn: DataFrame, m: Marginals, row_id: str, seed: int, with_nulls: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the table in order and type. Many-valued columns are looked up
    by the drawn share, or by a row uniform where none was drawn; nulls are put in at
    random, but for columns drawn ``with_nulls``, which are complete. Columns without a value, and
    those of nested or binary type, are null."""
    rid = F.col(row_id)
    there = set(drawn.columns)
    for c, values in m.large.items():
        if c in with_nulls:
            continue
        drawn = look_up(drawn, F.col(c) if c in there else H.uniform(seed, rid, c), values, c)
    cells = []
    for c in m.columns:
        kind = m.schema[c].dataType
        cell = _token(c, rid, seed) if c in m.opaque else _restored(F.col(c), kind) if c in m.modelled else F.lit(None).cast(kind)
        if m.null_share.get(c) and c not in with_nulls:
            cell = F.when(H.uniform(seed, rid, f"{c}:null") >= F.lit(m.null_share[c]), cell)
        cells.append(cell.alias(c))
    return drawn.select(row_id, *cells)


def sample_copula(df: DataFrame, m: Marginals, ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """Gaussian copula: the table's marginals under its normal-score correlation."""
    corr = score_correlation(df, m)
    values, vectors = np.linalg.eigh(corr)
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 0.0))) @ vectors.T
    if len(root):  # pairwise sums need not give a matrix without negative axes
        root /= np.sqrt((root**2).sum(axis=1, keepdims=True))
    return _sample_scores(m, ids, row_id, seed, len(corr), root)


def sample_latent(df: DataFrame, m: Marginals, ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED, rank: int | None = None) -> DataFrame:
    """Linear latent factors: leading principal axes plus independent residuals."""
    corr = score_correlation(df, m)
    d = len(corr)
    r = rank or max(1, math.ceil(d / 2))
    values, vectors = np.linalg.eigh(corr)
    top = np.argsort(values)[::-1][:r]
    load = vectors[:, top] * np.sqrt(np.maximum(values[top], 0.0))
    load /= np.maximum(np.sqrt((load**2).sum(axis=1, keepdims=True)), 1.0)
    rest = np.sqrt(np.maximum(1.0 - (load**2).sum(axis=1), 0.0))
    return _sample_scores(m, ids, row_id, seed, r + d, np.hstack([load, np.diag(rest)]))


def sample_mixture(df: DataFrame, m: Marginals, ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED, components: int = 3) -> DataFrame:
    """Gaussian mixture over the numbers, with category shares per component.

    Category combinations, null being one more category, are counted within each
    component and drawn as whole cells, however many there are; a many-valued
    column is a cell of its own, drawn within the component too. A missing number
    stands at its mean in the fit.
    """
    numbers = [c for c in m.modelled if c in m.numeric]
    strings = [c for c in m.modelled if c in m.category]
    if not numbers:
        return sample_marginals(m, ids, row_id, seed)
    mean = {c: float(m.numeric[c].mean()) for c in numbers}
    sd = {c: float(m.numeric[c].std()) or 1.0 for c in numbers}
    texts = [*strings, *m.large]
    keys, scores = [f"s{i}" for i in range(len(texts))], [f"x{i}" for i in range(len(numbers))]
    scaled = plain(df.select(*m.modelled)).select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(texts, keys)],
        *[F.coalesce((F.col(f"`{c}`").cast("double") - F.lit(mean[c])) / F.lit(sd[c]), F.lit(0.0)).alias(x) for c, x in zip(numbers, scores)],
    )
    vectors = VectorAssembler(inputCols=scores, outputCol="features").transform(scaled)
    fitted = GaussianMixture(k=components, seed=seed, maxIter=20).fit(vectors)
    weights = np.array(fitted.weights)
    centres = [np.array(g.mean.toArray()) for g in fitted.gaussians]
    roots = []
    for g in fitted.gaussians:
        values, axes = np.linalg.eigh(g.cov.toArray())
        roots.append(axes @ np.diag(np.sqrt(np.maximum(values, 0.0))))
    told = fitted.transform(vectors).select(F.col("prediction").alias("component"), *[F.col(k).alias(c) for c, k in zip(texts, keys)])
    groups = [cell_table(told, F.col("component"), names) for names in ([strings] if strings else []) + [[c] for c in m.large]]

    rid = F.col(row_id)
    taken = [row_id, *m.columns]
    part, places = unused(taken, "_part"), [unused(taken, f"_place{i}") for i in range(len(groups))]
    normals = [unused(taken, f"_z{i}") for i in range(len(numbers))]
    component = H.step_index(H.uniform(seed, rid, "component", 0), [float(w) for w in np.cumsum(weights)[:-1]])
    base = ids.select(
        rid.cast("bigint").alias(row_id),
        component.alias(part),
        *[H.uniform(seed, rid, f"cell{i}").alias(at) for i, at in enumerate(places)],
        *[H.normal(seed, rid, f"z{i}").alias(z) for i, z in enumerate(normals)],
    )
    base = base.withColumns({at: cells.place(F.col(part), F.col(at)) for cells, at in zip(groups, places)})
    ranges = {c: (float(m.numeric[c][0]), float(m.numeric[c][-1])) for c in numbers}
    whole = {c: m.whole(c) for c in numbers}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            comp = batch[part].to_numpy()
            z = batch[normals].to_numpy()
            x = np.zeros_like(z)
            for k in range(len(weights)):
                x[comp == k] = centres[k] + z[comp == k] @ roots[k].T
            out = {row_id: batch[row_id], **{at: batch[at] for at in places}}
            for j, c in enumerate(numbers):
                v = np.clip(x[:, j] * sd[c] + mean[c], *ranges[c])
                out[c] = np.rint(v).astype("int64") if whole[c] else v
            yield pd.DataFrame(out)[[row_id, *numbers, *places]]

    kinds = m.ddl(row_id, numbers) + "".join(f", `{at}` bigint" for at in places)
    drawn = base.mapInPandas(draw, kinds)
    for cells, at in zip(groups, places):
        drawn = draw_cells(drawn, at, cells)
    return _complete(drawn, m, row_id, seed, tuple(texts))


# --------------------------------------------------------------------------
# Pilot

SLOTS = {"CTGAN": "mixture", "TVAE": "latent", "GaussianCopula": "copula"}


def synthesize(slot: str, df: DataFrame, m: Marginals, ids: DataFrame, row_id: str, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """Rows of the sampler that fills a model slot."""
    if slot == "marginals":
        return sample_marginals(m, ids, row_id, seed)
    sampler = {"mixture": sample_mixture, "latent": sample_latent, "copula": sample_copula}[SLOTS.get(slot, slot)]
    return sampler(df, m, ids, row_id, seed)


def candidates(model_choice: str = "auto") -> tuple[str, ...]:
    return C.MODEL_FAMILIES.get(model_choice, C.MODEL_FAMILIES["auto"])


def pilot_score(df: DataFrame, sample: DataFrame) -> float:
    return fidelity.wasserstein_pilot(Pair.of(df, sample)).first()[0]


def pilot(df: DataFrame, ids: DataFrame, row_id: str, models: tuple[str, ...], seed: int = C.DEFAULT_SEED, exclude: tuple[str, ...] = ()):
    """[(model, score, sample)], best first. A table that is too small for a model
    leaves it out; a model that can't be fitted or drawn scores infinity and has no sample (None)."""
    kept = df.drop(*exclude)
    m = fit_marginals(kept)
    rows = df.count()
    found = []
    for model in models:
        if rows < C.MODEL_MIN_ROWS.get(model, 10):
            continue
        try:
            sample = settle(synthesize(model, kept, m, ids, row_id, seed))
            found.append((model, pilot_score(kept, sample.drop(row_id)), sample))
        except (PySparkException, Py4JJavaError, ValueError, ArithmeticError):
            logging.getLogger(__name__).warning("%s failed", model, exc_info=True)
            found.append((model, math.inf, None))
    return sorted(found, key=lambda x: (x[1], x[0]))


def ensemble_weights(scores: DataFrame) -> DataFrame:
    """(model, weight): inverse scores of the two best, scaled to one; a single
    model weighs 1. Needs (model, wasserstein)."""
    best = scores.orderBy("wasserstein", "model").limit(2)
    inverse = best.select("model", (F.lit(1.0) / (F.col("wasserstein") + F.lit(C.WEIGHT_FLOOR))).alias("w"))
    total = inverse.agg(F.sum("w").alias("t"))
    return inverse.select("model", (F.col("w") / total.scalar()).alias("weight"))


def leaderboard(scores: DataFrame) -> DataFrame:
    """(rank, model, wasserstein); a handful of models, one row each."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy("wasserstein", "model")).cast("int")
    return scores.select(rank.alias("rank"), "model", "wasserstein")
