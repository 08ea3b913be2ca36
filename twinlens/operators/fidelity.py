"""How close the synthetic table is to the real one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.polynomial.hermite_e import herme2poly
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions.hashrand import TWO_POW_32
from twinlens.operators.columns import metric_id_name
from twinlens.operators.ordered import (
    ROWS_PER_BUCKET,
    bucket_count,
    bucket_splits,
    bucketed_values,
    running_counts,
)
from twinlens.operators.pair import IS_REAL, Pair
from twinlens.operators.profile import (
    PairStats,
    literal_lookup,
    long_values,
    pair_judge_ids,
    pair_metric_ids,
    pair_stats,
)

def _real() -> Column:
    return F.col(IS_REAL)


def one_row(df_like: DataFrame, **values) -> DataFrame:
    """A single row of literals in the session of ``df_like``."""
    return df_like.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# --------------------------------------------------------------------------
# Wasserstein


def raw_wasserstein(pair: Pair, columns: list[str], stats: PairStats, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(column, w1): area between the two empirical distribution functions.

    One shuffle of distinct values, one of the same rows by bucket; all columns
    together. Every variant below is this number over its own range.
    """
    splits = bucket_splits(pair.tagged, columns, bucket_count(stats.total, rows_per_bucket))
    freq = (
        bucketed_values(pair.tagged, columns, splits, keep=(IS_REAL,))
        .groupBy("column", "bucket", "value")
        .agg(F.count_if(_real()).alias("n_real"), F.count_if(~_real()).alias("n_synth"))
    )
    ranked = running_counts(freq, ["n_real", "n_synth"], bool(splits))
    total_real = literal_lookup(F.col("column"), {c: float(stats.side(c, True).count) for c in columns})
    total_synth = literal_lookup(F.col("column"), {c: float(stats.side(c, False).count) for c in columns})
    gap = F.abs(
        (F.col("before_n_real") + F.col("n_real")) / total_real
        - (F.col("before_n_synth") + F.col("n_synth")) / total_synth
    )
    step = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return ranked.groupBy("column").agg(F.sum(gap * step).alias("w1"))


def _scaled_columns(pair: Pair, scales: dict[str, float], stats: PairStats, rows_per_bucket: int) -> DataFrame:
    raw = raw_wasserstein(pair.select(*scales), list(scales), stats, rows_per_bucket)
    return raw.select("column", (F.col("w1") / literal_lookup(F.col("column"), scales)).alias("wasserstein"))


def _mean_or(pair: Pair, scales: dict[str, float], stats: PairStats, empty: float, rows_per_bucket: int) -> DataFrame:
    if not scales:
        return one_row(pair.tagged, wasserstein=empty)
    return _scaled_columns(pair, scales, stats, rows_per_bucket).agg(
        F.coalesce(F.avg("wasserstein"), F.lit(empty)).alias("wasserstein")
    )


def judge_scales(pair: Pair, stats: PairStats) -> dict[str, float]:
    ids = pair_judge_ids(pair, stats)
    out = {}
    for c in pair.numeric:
        r, s = stats.side(c, True), stats.side(c, False)
        if not ids[c] and r.count and s.count:
            out[c] = max(max(r.high, s.high) - min(r.low, s.low), C.RANGE_FLOOR)
    return out


def wasserstein_judge(pair: Pair, stats: PairStats | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mean over non-identifier numeric columns, each scaled by the range of both sides."""
    stats = stats or pair_stats(pair, pair.numeric, sketch=True)
    return _mean_or(pair, judge_scales(pair, stats), stats, 0.0, rows_per_bucket)


def _real_range_scales(pair: Pair, stats: PairStats, floor: bool) -> dict[str, float]:
    candidates = []
    for c in pair.numeric:
        r, s = stats.side(c, True), stats.side(c, False)
        if r.count < 2 or s.count < 2 or metric_id_name(c):
            continue
        if floor or r.span >= C.RANGE_FLOOR:
            candidates.append(c)
    ids = pair_metric_ids(pair, stats, candidates)
    return {c: max(stats.side(c, True).span, C.RANGE_FLOOR) for c in candidates if not ids[c]}


def wasserstein_metrics(pair: Pair, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Mean scaled by the real range; flat columns are left out."""
    stats = pair_stats(pair, pair.numeric, sketch=True)
    return _mean_or(pair, _real_range_scales(pair, stats, floor=False), stats, 0.0, rows_per_bucket)


def wasserstein_pilot(pair: Pair, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """As ``wasserstein_metrics``, but flat columns stay in and no column at all is infinite."""
    stats = pair_stats(pair, pair.numeric, sketch=True)
    return _mean_or(pair, _real_range_scales(pair, stats, floor=True), stats, math.inf, rows_per_bucket)


def wasserstein_by_column(pair: Pair, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every numeric column, scaled by its real range, with a colour band."""
    stats = pair_stats(pair, pair.numeric)
    scales, short = {}, []
    for c in pair.numeric:
        r, s = stats.side(c, True), stats.side(c, False)
        if r.count > 1 and s.count > 1:
            scales[c] = r.span if r.span > 0 else 1.0
        else:
            short.append(c)
    parts = []
    if scales:
        parts.append(_scaled_columns(pair, scales, stats, rows_per_bucket))
    parts += [one_row(pair.tagged, column=c, wasserstein=0.0) for c in short]
    if not parts:
        return pair.tagged.sparkSession.createDataFrame([], "column string, wasserstein double, band string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    w = F.col("wasserstein")
    band = F.when(w < F.lit(C.BAND_PASS), "pass").when(w < F.lit(C.BAND_AMBER), "amber").otherwise("fail")
    return out.withColumn("band", band)


# --------------------------------------------------------------------------
# Category frequencies


def value_counts(pair: Pair, columns: list[str], cast: str) -> DataFrame:
    """(column, value, n_real, n_synth); hot values are combined before the shuffle."""
    return (
        long_values(pair.tagged, columns, keep=(IS_REAL,), cast=cast)
        .groupBy("column", "value")
        .agg(F.count_if(_real()).alias("n_real"), F.count_if(~_real()).alias("n_synth"))
    )


def with_shares(counts: DataFrame) -> DataFrame:
    """Add p_real and p_synth.

    The totals come from the same shuffled counts, which Spark reuses. They are
    one row per table column, whatever the data, so they are broadcast: a join
    shuffled on the column name would put all values of a column in one task.
    """
    totals = counts.groupBy("column").agg(F.sum("n_real").alias("t_real"), F.sum("n_synth").alias("t_synth"))

    def share(n: str, t: str) -> Column:
        return F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(t).cast("double")), F.lit(0.0))

    return counts.join(F.broadcast(totals), "column").select(
        "column",
        "value",
        "n_real",
        "n_synth",
        share("n_real", "t_real").alias("p_real"),
        share("n_synth", "t_synth").alias("p_synth"),
    )


def value_freq(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, freq): shares among the non-null values."""
    counts = long_values(df, columns, cast="string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", (F.col("n").cast("double") / F.col("t").cast("double")).alias("freq")
    )


def freq_align(pair: Pair, columns: list[str] | None = None) -> DataFrame:
    """Shares of both sides on the union of their categories."""
    shares = with_shares(value_counts(pair, columns or pair.strings, "string"))
    return shares.select("column", "value", "p_real", "p_synth")


def _half_kl(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.ln(p / m)).otherwise(F.lit(0.0))


def js_by_column(pair: Pair, columns: list[str] | None = None) -> DataFrame:
    shares = with_shares(value_counts(pair, columns or pair.strings, "string"))
    p, q = F.col("p_real"), F.col("p_synth")
    m = (p + q) / F.lit(2.0)
    term = (_half_kl(p, m) + _half_kl(q, m)) / F.lit(2.0)
    return shares.groupBy("column").agg(F.sum(term).alias("js"))


def js_divergence(pair: Pair, columns: list[str] | None = None) -> DataFrame:
    """Mean Jensen-Shannon divergence (nats) over string columns; 0 without any."""
    if not (columns or pair.strings):
        return one_row(pair.tagged, js_divergence=0.0)
    return js_by_column(pair, columns).agg(F.coalesce(F.avg("js"), F.lit(0.0)).alias("js_divergence"))


def _kl_terms(counts: DataFrame) -> DataFrame:
    """KL with absent mass filled in and both sides scaled to one again.

    With S = sum of p, T = sum of q after the fill, the sum over scaled shares is
    (sum p ln(p/q)) / S - ln(S/T): one pass, no second look at the rows.
    """
    shares = with_shares(counts)
    fill = F.lit(C.KL_FILL)
    p = F.when(F.col("n_real") > 0, F.col("p_real")).otherwise(fill)
    q = F.when(F.col("n_synth") > 0, F.col("p_synth")).otherwise(fill)
    sums = shares.groupBy("column").agg(
        F.sum(p * F.ln(p / q)).alias("x"), F.sum(p).alias("s"), F.sum(q).alias("t")
    )
    return sums.select("column", (F.col("x") / F.col("s") - F.ln(F.col("s") / F.col("t"))).alias("kl"))


def _bin(value: Column, low: float, span: float, bins: int) -> Column:
    """Number of the step; the greatest real value is in the last one, as in a histogram."""
    step = F.floor((value - F.lit(low)) * F.lit(bins / span))
    return F.when(value == F.lit(low + span), F.lit(bins - 1)).otherwise(step)


def kl_by_column(pair: Pair, columns: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """KL(real || synthetic) of each column.

    ``bins`` groups numbers into that many equal steps of the real range; the
    default compares single values, as published, which makes continuous
    columns and identifiers look far apart.
    """
    names = columns or pair.columns
    strings = [c for c in names if c in pair.strings]
    numbers = [c for c in names if c in pair.numeric]
    parts = []
    if strings:
        parts.append(_kl_terms(value_counts(pair, strings, "string")))
    if numbers and bins:
        stats = pair_stats(pair, numbers)
        binned = pair.tagged.select(
            IS_REAL,
            *[
                _bin(F.col(c), stats.side(c, True).low or 0.0, stats.side(c, True).span or 1.0, bins).alias(c)
                for c in numbers
            ],
        )
        parts.append(_kl_terms(value_counts(Pair(binned), numbers, "double")))
    elif numbers:
        parts.append(_kl_terms(value_counts(pair, numbers, "double")))
    if not parts:
        return pair.tagged.sparkSession.createDataFrame([], "column string, kl double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def kl_divergence(pair: Pair, columns: list[str] | None = None, bins: int | None = None) -> DataFrame:
    if not (columns or pair.strings or pair.numeric):
        return one_row(pair.tagged, kl_divergence=0.0)
    return kl_by_column(pair, columns, bins).agg(F.coalesce(F.avg("kl"), F.lit(0.0)).alias("kl_divergence"))


# --------------------------------------------------------------------------
# Correlation


WIDE = 12


def corr_matrix(pair: Pair, columns: list[str] | None = None, stats: PairStats | None = None) -> DataFrame:
    """(is_real, col_a, col_b, corr): the full matrix of both sides.

    Pairs with a null are dropped pairwise and an undefined value is 0. Values
    are shifted by the middle of their range first, so plain sums keep their
    digits; all sums come from one aggregate over one scan, and only partial
    sums are shuffled.
    """
    cols = columns or pair.numeric
    stats = stats or pair_stats(pair, cols)
    middle = {}
    for c in cols:
        known = [stats.side(c, side) for side in (True, False) if stats.side(c, side).count]
        middle[c] = (min(k.low for k in known) + max(k.high for k in known)) / 2.0 if known else 0.0
    sums = (_corr_sums if len(cols) <= WIDE else _corr_sums_wide)(pair, cols, middle, stats)

    def spread(total: str, square: str) -> Column:
        return F.greatest(F.col(square) - F.try_divide(F.col(total) * F.col(total), F.col("n")), F.lit(0.0))

    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    vx, vy = spread("sx", "sxx"), spread("sy", "syy")
    # A spread that is rounding dust of its own sum of squares is a constant.
    flat = (vx <= F.lit(1e-14) * F.col("sxx")) | (vy <= F.lit(1e-14) * F.col("syy"))
    value = F.when(flat, F.lit(0.0)).when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    names = F.array(*[F.lit(c) for c in cols])
    upper = sums.select(IS_REAL, "i", "j", F.coalesce(value, F.lit(0.0)).alias("corr"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    full = upper.select(IS_REAL, "corr", F.inline(both))
    return full.select(
        IS_REAL, F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b"), "corr"
    )


def _corr_sums(pair: Pair, cols: list[str], middle: dict[str, float], stats: PairStats) -> DataFrame:
    """(is_real, i, j, n, sx, sy, sxx, syy, sxy) for i <= j as JVM sums. Columns
    without nulls share their own sums among all their pairs."""
    x = [F.col(c).cast("double") - F.lit(middle[c]) for c in cols]
    full = [all(stats.side(c, side).count == stats.rows[side] for side in (True, False)) for c in cols]
    aggs: dict[str, Column] = {"n": F.count(F.lit(1)).cast("double")}
    cells = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            if full[i] and full[j]:
                tag, keep = "", None
            else:
                tag, keep = f"_{i}_{j}", x[i].isNotNull() & x[j].isNotNull()

            def only(v: Column, keep=keep) -> Column:
                return v if keep is None else F.when(keep, v)

            names = {"n": f"n{tag}", "sx": f"s{i}{tag}", "sy": f"s{j}{tag}", "sxx": f"q{i}{tag}", "syy": f"q{j}{tag}", "sxy": f"p{i}_{j}"}
            aggs.setdefault(names["n"], F.count(only(F.lit(1))).cast("double"))
            aggs.setdefault(names["sx"], F.sum(only(x[i])))
            aggs.setdefault(names["sy"], F.sum(only(x[j])))
            aggs.setdefault(names["sxx"], F.sum(only(x[i] * x[i])))
            aggs.setdefault(names["syy"], F.sum(only(x[j] * x[j])))
            aggs.setdefault(names["sxy"], F.sum(only(x[i] * x[j])))
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.col(v).alias(k) for k, v in names.items()]))
    summed = pair.tagged.groupBy(IS_REAL).agg(*[v.alias(k) for k, v in aggs.items()])
    return summed.select(IS_REAL, F.inline(F.array(*cells)))


def _corr_sums_wide(pair: Pair, cols: list[str], middle: dict[str, float], stats: PairStats) -> DataFrame:
    """The same sums for many columns: matrix products per Arrow batch."""
    d = len(cols)
    shift = np.array([middle[c] for c in cols])
    i, j = np.triu_indices(d)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {side: np.zeros((6, d, d)) for side in (True, False)}
        for batch in batches:
            flag = batch[IS_REAL].to_numpy(dtype=bool)
            values = batch[cols].to_numpy(dtype=float) - shift
            for side in (True, False):
                part = values[flag == side]
                known = (~np.isnan(part)).astype(float)
                part = np.nan_to_num(part)
                square = part * part
                sums[side] += np.stack(
                    [known.T @ known, part.T @ known, known.T @ part, square.T @ known, known.T @ square, part.T @ part]
                )
        for side, s in sums.items():
            yield pd.DataFrame({IS_REAL: side, "i": i, "j": j, **{k: s[n][i, j] for n, k in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}})

    numbers = pair.tagged.select(IS_REAL, *[F.col(c).cast("double").alias(c) for c in cols])
    kinds = f"{IS_REAL} boolean, i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = numbers.mapInPandas(partial, kinds)
    return parts.groupBy(IS_REAL, "i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def corr_frobenius(pair: Pair, columns: list[str] | None = None, stats: PairStats | None = None) -> DataFrame:
    """Frobenius norm of the difference of the two matrices."""
    matrix = corr_matrix(pair, columns, stats)
    signed = F.when(_real(), F.col("corr")).otherwise(-F.col("corr"))
    diff = matrix.groupBy("col_a", "col_b").agg(F.sum(signed).alias("d"))
    return diff.agg(F.sqrt(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0))).alias("frobenius"))


def corr_similarity(pair: Pair, columns: list[str] | None = None, stats: PairStats | None = None) -> DataFrame:
    """1 / (1 + Frobenius distance); 1 with fewer than two numeric columns."""
    if len(columns or pair.numeric) < 2:
        return one_row(pair.tagged, similarity=1.0)
    return corr_frobenius(pair, columns, stats).select((F.lit(1.0) / (F.lit(1.0) + F.col("frobenius"))).alias("similarity"))


# --------------------------------------------------------------------------
# Maximum mean discrepancy


def pooled_moments(pair: Pair, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations over complete, finite rows of both sides."""
    row = (
        finite_rows(pair, columns)
        .agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)])
        .first()
    )
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    sd = np.array([row[f"s{i}"] or 1.0 for i in range(len(columns))])
    return mean, np.where(sd > 0, sd, 1.0)


def finite_rows(pair: Pair, columns: list[str]) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in columns]
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(math.inf))
    return pair.tagged.select(IS_REAL, *cols).where(keep)


def hash_normals(seed: int, stream: str, count: int) -> np.ndarray:
    """The same draws as ``hashrand.normal`` for row ids 0..count-1."""
    import hashlib

    out = np.empty(count)
    for i in range(count):
        hexed = hashlib.md5(f"{seed}|{i}|{stream}".encode()).hexdigest()
        u1 = (int(hexed[:8], 16) + 0.5) / TWO_POW_32
        u2 = (int(hexed[8:16], 16) + 0.5) / TWO_POW_32
        out[i] = math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)
    return out


def mmd_features(pair: Pair, columns: list[str] | None = None, features: int = 256, seed: int = C.DEFAULT_SEED, scale: bool = True) -> DataFrame:
    """MMD of an RBF kernel with gamma = 1/d over all rows of both sides.

    The kernel is written as an inner product of ``features`` random cosine and
    sine features, so the statistic is the distance of two mean vectors: linear
    in the rows, no row is ever paired with another. Each task sends one vector
    of partial sums per side.
    """
    cols = columns or pair.numeric
    if not cols:
        return one_row(pair.tagged, mmd=0.0)
    d = len(cols)
    mean, sd = pooled_moments(pair, cols) if scale else (np.zeros(d), np.ones(d))
    omega = np.column_stack([hash_normals(seed, f"w{i}", features) for i in range(d)]) * math.sqrt(2.0 / d)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {True: np.zeros((2, features)), False: np.zeros((2, features))}
        rows = {True: 0, False: 0}
        for batch in batches:
            x = (batch[cols].to_numpy(dtype=float) - mean) / sd
            flag = batch[IS_REAL].to_numpy(dtype=bool)
            for side in (True, False):
                part = x[flag == side]
                for at in range(0, len(part), 4096):
                    angle = part[at : at + 4096] @ omega.T
                    sums[side] += np.vstack([np.cos(angle).sum(axis=0), np.sin(angle).sum(axis=0)])
                rows[side] += len(part)
        for side in (True, False):
            if rows[side]:
                yield pd.DataFrame(
                    {
                        IS_REAL: side,
                        "feature": np.arange(2 * features),
                        "total": sums[side].reshape(-1),
                        "rows": rows[side],
                    }
                )

    parts = finite_rows(pair, cols).mapInPandas(partial, f"{IS_REAL} boolean, feature int, total double, rows long")
    means = parts.groupBy("feature").agg(
        F.try_divide(F.sum(F.when(_real(), F.col("total"))), F.sum(F.when(_real(), F.col("rows")))).alias("a"),
        F.try_divide(F.sum(F.when(~_real(), F.col("total"))), F.sum(F.when(~_real(), F.col("rows")))).alias("b"),
    )
    gap = F.col("a") - F.col("b")
    return means.agg(F.coalesce(F.sqrt(F.sum(gap * gap) / F.lit(float(features))), F.lit(0.0)).alias("mmd"))


# --------------------------------------------------------------------------
# Densities


KDE_TERMS = 10
KDE_CELLS = 4  # a bandwidth
KDE_REACH = 9.0  # bandwidths; the kernel is below 3e-18 there


def _kernel_sums(values: DataFrame, h: float, low: float, start: float, step: float, points: int) -> DataFrame:
    """(i, total): sums of kernels of bandwidth ``h`` around ``v`` at ``start + i * step``."""
    side = h / KDE_CELLS
    cell = F.floor((F.col("v") - F.lit(low)) / F.lit(side))
    centre = F.lit(low) + (F.col("cell") + F.lit(0.5)) * F.lit(side)
    offset = values.select(cell.alias("cell"), "v").select("cell", ((F.col("v") - centre) / F.lit(h)).alias("s"))
    powers = [F.sum(F.pow("s", F.lit(float(k)))).alias(f"m{k}") for k in range(KDE_TERMS)]
    cells = offset.groupBy("cell").agg(*powers).withColumn("centre", centre)
    first = F.greatest(F.ceil((F.col("centre") - F.lit(KDE_REACH * h + start)) / F.lit(step)), F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("centre") + F.lit(KDE_REACH * h - start)) / F.lit(step)), F.lit(points - 1)).cast("int")
    # The k-th derivative of the kernel is a Hermite polynomial times the kernel: one polynomial a cell.
    factors = np.zeros((KDE_TERMS, KDE_TERMS))
    for k in range(KDE_TERMS):
        factors[k, : k + 1] = herme2poly([0] * k + [1]) / math.factorial(k)
    weights = [sum((F.col(f"m{k}") * F.lit(float(factors[k, j])) for k in range(KDE_TERMS) if factors[k, j]), F.lit(0.0)) for j in range(KDE_TERMS)]
    near = cells.select("centre", F.array(*weights).alias("a"), first.alias("first"), last.alias("last")).where("first <= last")
    near = near.select("centre", "a", F.explode(F.sequence("first", "last")).alias("i"))
    near = near.select("i", "a", ((F.lit(start) + F.lit(step) * F.col("i") - F.col("centre")) / F.lit(h)).alias("t"))
    series = F.lit(0.0)
    for j in reversed(range(KDE_TERMS)):
        series = series * F.col("t") + F.col("a")[j]
    return near.groupBy("i").agg(F.sum(series * F.exp(F.lit(-0.5) * F.col("t") * F.col("t"))).alias("total"))


def kde_overlay(pair: Pair, column: str, points: int = C.KDE_POINTS) -> DataFrame:
    """Gaussian density of both sides (Scott's bandwidth) on one grid.

    Rows are summed into cells of a quarter bandwidth: ``KDE_TERMS`` power sums of the
    offset from the cell's centre, which make the kernel's Taylor series there. Only
    cells meet the grid, at most ``KDE_REACH`` bandwidths away. Offsets are at most
    d = 1/8 of a bandwidth, so a row's kernel is wrong by less than
    1.1 * d**10 / sqrt(10!) < 6e-13 of its peak. A side without a spread, or with an
    infinite value, has a null density, and if neither has a value the grid is null as well.
    """
    stats = pair.tagged.select(IS_REAL, F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    facts = {
        r[IS_REAL]: r
        for r in stats.groupBy(IS_REAL)
        .agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()  # two rows
    }
    if not facts:
        return stats.sparkSession.range(points).select(F.col("id").cast("int").alias("i"), *[F.lit(None).cast("double").alias(c) for c in ("x", "density_real", "density_synth")])
    low = min(r["lo"] for r in facts.values())
    high = max(r["hi"] for r in facts.values())
    margin = C.KDE_MARGIN * (high - low)
    start, step = low - margin, (high - low + 2 * margin) / (points - 1)
    width = {k: float(r["sd"] or 0.0) * r["n"] ** -0.2 for k, r in facts.items()}
    width = {k: h for k, h in width.items() if h > 0 and math.isfinite(h)}
    norm = {k: facts[k]["n"] * h * math.sqrt(2.0 * math.pi) for k, h in width.items()}
    parts = stats.sparkSession.range(points).select(F.lit(None).cast("boolean").alias(IS_REAL), F.col("id").cast("int").alias("i"), F.lit(0.0).alias("total"))
    for side, h in width.items():
        parts = parts.unionByName(_kernel_sums(stats.where(_real() == F.lit(side)), h, low, start, step, points).withColumn(IS_REAL, F.lit(side)))

    def density(real: bool) -> Column:
        if real not in norm:
            return F.lit(None).cast("double")
        return F.coalesce(F.sum(F.when(_real() == F.lit(real), F.col("total"))), F.lit(0.0)) / F.lit(norm[real])

    return (
        parts.groupBy("i")
        .agg(density(True).alias("density_real"), density(False).alias("density_synth"))
        .select("i", (F.lit(start) + F.lit(step) * F.col("i")).alias("x"), "density_real", "density_synth")
    )
