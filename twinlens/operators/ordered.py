"""Ordered statistics that no single task has to hold.

A window over one column, key or label puts that whole group into one task.
Here the value axis is cut into buckets first: each bucket is ranked on its
own, a table of bucket totals (bounded by the number of buckets) gives the
offsets, and the two together are the exact running count. Buckets follow
approximate quantiles, so they are even; repeated values are merged before,
so a hot value is one row.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.hashrand import digest
from twinlens.operators.columns import unused
from twinlens.operators.scan import running
from twinlens.session import stored

ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 4096
TOP_K_LIMIT = 10_000
#: Sketches tell ranks to one in so many; up to so many rows ranking them all is as quick.
SKETCH = 10_000
SELECT_FROM = 20_000


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket)))


def bucket_splits(df: DataFrame, columns: list[str], buckets: int) -> dict[str, list[float]]:
    """Inner cut points per column; at most ``buckets - 1`` numbers each."""
    if buckets <= 1 or not columns:
        return {}
    probs = [i / buckets for i in range(1, buckets)]
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    cuts = numbers.approxQuantile(columns, probs, 1.0 / (4 * buckets))
    return {c: sorted(set(found)) for c, found in zip(columns, cuts) if found}


def bucketed_values(df: DataFrame, columns: list[str], splits: dict[str, list[float]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., column, bucket, value) without nulls."""
    df = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    cut = [c for c in columns if splits.get(c)]
    if cut:
        df = Bucketizer(
            inputCols=cut,
            outputCols=[f"_bucket_{c}" for c in cut],
            splitsArray=[[-math.inf, *splits[c], math.inf] for c in cut],
            handleInvalid="keep",
        ).transform(df)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                (F.col(f"_bucket_{c}").cast("int") if c in cut else F.lit(0)).alias("bucket"),
                F.col(c).alias("value"),
            )
            for c in columns
        ]
    )
    return df.select(*keep, F.inline(cells)).where(F.col("value").isNotNull())


def running_counts(freq: DataFrame, counts: list[str], bucketed: bool) -> DataFrame:
    """Add ``before_<count>`` (rows with a smaller value) and ``next_value``.

    ``freq`` has one row per (column, bucket, value).
    """
    local = Window.partitionBy("column", "bucket").orderBy("value")
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)
    out = freq.select(
        "*",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in counts],
        F.lead("value").over(local).alias("next_value"),
    )
    if not bucketed:
        return out
    totals = freq.groupBy("column", "bucket").agg(*[F.sum(c).alias(c) for c in counts], F.min("value").alias("first"))
    chain = Window.partitionBy("column").orderBy("bucket")  # at most MAX_BUCKETS rows a column
    offsets = totals.select(
        "column",
        "bucket",
        *[F.coalesce(F.sum(c).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"offset_{c}") for c in counts],
        F.lead("first").over(chain).alias("next_first"),
    )
    joined = out.join(offsets, ["column", "bucket"])
    return joined.select(
        *freq.columns,
        *[(F.col(f"before_{c}") + F.col(f"offset_{c}")).alias(f"before_{c}") for c in counts],
        F.coalesce("next_value", "next_first").alias("next_value"),
    )


def quantiles(df: DataFrame, columns: list[str], probs: list[float], rows_per_bucket: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: (column, p, q).

    Nothing is sorted as a whole: a sketch brackets each wanted rank, one count tells how many rows lie
    below and within each bracket, and only values within brackets are ranked. The counts prove that each
    rank lies in its bracket; if one does not, if values are NaN or infinite, or if ``rows_per_bucket``
    is given, all values are ranked bucket by bucket. A column without values has no row."""
    x = {c: F.col(c).cast("double") for c in columns}
    odd = lambda c: F.count_if(F.isnan(x[c]) | (F.abs(x[c]) == F.lit(math.inf)))
    sizes = df.agg(*[f.alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count(c)), ("odd", odd(c)))]).first()
    counts = {c: sizes[f"n{i}"] for i, c in enumerate(columns)}
    plain = not any(sizes[f"odd{i}"] for i in range(len(columns)))
    if rows_per_bucket is None and plain and max(counts.values()) > SELECT_FROM:
        found = _selected(df, counts, probs)
        if found is not None:
            return found
    return _ranked(df, counts, probs, rows_per_bucket or ROWS_PER_BUCKET)


def _brackets(df: DataFrame, counts: dict[str, int], probs: list[float]) -> dict[str, list[tuple[float, float, list[float]]]]:
    """Per column the disjoint value ranges, in order, and the probabilities whose ranks each should hold."""
    slack = 2.0 / SKETCH
    aggs, ends = [], {}
    for c, n in counts.items():
        at = [p * (n - 1) for p in probs]
        ends[c] = [min(1.0, max(0.0, e)) for a in at for e in ((math.floor(a) + 0.5) / n - slack, (math.ceil(a) + 1.0) / n + slack)]
        aggs.append(F.percentile_approx(F.col(c).cast("double") + F.lit(0.0), ends[c], SKETCH).alias(f"e{len(aggs)}"))
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(counts):
        found: list[tuple[float, float, list[float]]] = []
        for j, p in sorted(enumerate(probs), key=lambda x: x[1]):
            low, high = row[f"e{i}"][2 * j] + 0.0, row[f"e{i}"][2 * j + 1] + 0.0
            if found and low <= math.nextafter(found[-1][1], math.inf):
                found[-1] = (min(found[-1][0], low), max(found[-1][1], high), [*found[-1][2], p])
            else:
                found.append((low, high, [p]))
        out[c] = found
    return out


def _selected(df: DataFrame, counts: dict[str, int], probs: list[float]) -> DataFrame | None:
    """Quantiles from bracketed ranks; None if a rank is not in its bracket."""
    spark = df.sparkSession
    counts = {c: n for c, n in counts.items() if n}
    brackets = _brackets(df, counts, probs)
    cuts = {c: [e for low, high, _ in found for e in (low, math.nextafter(high, math.inf) + 0.0)] for c, found in brackets.items()}
    rows = df.select(*[(F.col(c).cast("double") + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(counts)])
    names = [f"x{i}" for i in range(len(counts))]
    # Odd buckets are brackets, even ones lie between them.
    rows = Bucketizer(
        inputCols=names, outputCols=[f"b{i}" for i in range(len(counts))], splitsArray=[[-math.inf, *cuts[c], math.inf] for c in counts], handleInvalid="keep"
    ).transform(rows)
    cells = [F.struct(F.lit(c).alias("column"), F.when(F.col(n).isNotNull(), F.col(f"b{i}").cast("int")).alias("bucket"), F.when(F.col(f"b{i}") % 2 == 1, F.col(n)).alias("value")) for i, (c, n) in enumerate(zip(counts, names))]
    freq = rows.select(F.inline(F.array(*cells))).where("bucket is not null").groupBy("column", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    freq = stored(freq, "selection")
    held = {(r["column"], r["bucket"]): r["n"] for r in freq.groupBy("column", "bucket").agg(F.sum("n").alias("n")).collect()}  # two rows a probability
    wanted = []
    for c, n in counts.items():
        below = 0
        for j, (_, _, here) in enumerate(brackets[c]):
            below += held.get((c, 2 * j), 0)
            inside = held.get((c, 2 * j + 1), 0)
            if any(math.floor(p * (n - 1)) < below or math.ceil(p * (n - 1)) >= below + inside for p in here):
                return None
            wanted.append((c, 2 * j + 1, below, float(n - 1), here))
            below += inside
    table = spark.createDataFrame(wanted, "column string, bucket int, below bigint, top double, wanted array<double>")
    local = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = freq.where(F.col("bucket") % 2 == 1).join(F.broadcast(table), ["column", "bucket"])
    ranked = ranked.withColumn("before_n", F.coalesce(F.sum("n").over(local), F.lit(0)) + F.col("below"))
    return _interpolated(ranked, F.col("wanted"))


def _ranked(df: DataFrame, counts: dict[str, int], probs: list[float], rows_per_bucket: int) -> DataFrame:
    """Quantiles by ranking every distinct value within its bucket."""
    columns = list(counts)
    splits = bucket_splits(df, columns, bucket_count(max(counts.values()), rows_per_bucket))
    freq = (
        bucketed_values(df, columns, splits)
        .groupBy("column", "bucket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.lit(0)
    for c, n in counts.items():
        total = F.when(F.col("column") == F.lit(c), F.lit(n)).otherwise(total)
    ranked = running_counts(freq, ["n"], bool(splits)).withColumn("top", total.cast("double") - F.lit(1.0))

    wanted = F.array(*[F.lit(float(p)) for p in probs])
    m = len(probs)
    if m > 16 and all(abs(p - i / (m - 1)) < 1e-12 for i, p in enumerate(probs)):
        # An even grid: only the points between the rank before this value and
        # the rank after it can match.
        per_rank = F.lit(float(m - 1)) / F.greatest(F.col("top"), F.lit(1.0))
        start = F.greatest(F.floor((F.col("before_n") - 1) * per_rank).cast("int"), F.lit(1))
        length = F.ceil((F.col("n") + 1) * per_rank).cast("int") + F.lit(5)
        wanted = F.slice(wanted, start, length)
    return _interpolated(ranked, wanted)


def _interpolated(ranked: DataFrame, wanted: Column) -> DataFrame:
    """(column, p, q) from values with ``before_n``, ``n`` and ``top`` (the last rank)."""

    def covers(rank: Column) -> Column:
        return (rank >= F.col("before_n")) & (rank < F.col("before_n") + F.col("n"))

    hits = ranked.select(
        "column",
        "value",
        "before_n",
        "n",
        "top",
        F.explode(
            F.filter(wanted, lambda p: covers(F.floor(p * F.col("top"))) | covers(F.ceil(p * F.col("top"))))
        ).alias("p"),
    )
    at = F.col("p") * F.col("top")
    ends = hits.groupBy("column", "p").agg(
        F.max(F.when(covers(F.floor(at)), F.col("value"))).alias("low"),
        F.max(F.when(covers(F.ceil(at)), F.col("value"))).alias("high"),
        F.max(at - F.floor(at)).alias("part"),
    )
    return ends.select("column", "p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("q"))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key, by ``order``.

    Rows are dealt by ranges of (key, order), so neither a key nor one order value
    that holds a third of the table is a task of its own."""
    upto = unused([*df.columns, out], "_upto")
    summed = running(df, keys, order, {upto: ("sum", value)})
    return summed.select(*[c for c in df.columns if c != out], (F.col(upto) - F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias(out))


def hash_order(seed: int, row_id: Column, stream: str = "order") -> Column:
    """A fixed random order of rows: the digest of seed and row id."""
    return digest(seed, row_id, stream)


def hash_row_number(df: DataFrame, groups: list[str], order: Column, tie: list[str], out: str) -> DataFrame:
    """1-based position in the hash order within each group. A group, or one row
    content, may hold most of the rows: they are numbered over ranges."""
    place = unused([*df.columns, out], "_h")
    numbered = running(df.withColumn(place, order), groups, [place, *tie], {unused([*df.columns, place], out): ("count", F.lit(1))})
    return numbered.drop(place)


def hash_head(df: DataFrame, n: int, order: Column, tie: list[str]) -> DataFrame:
    """Exactly the first ``n`` rows in hash order.

    A few rows come from a top-k. For many, bucket counts tell which whole
    buckets are in; only the one the cut falls into is ranked.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    h, b = unused(df.columns, "_h"), unused(df.columns, "_b")
    hashed = df.withColumn(h, order)
    if n <= TOP_K_LIMIT:
        return hashed.orderBy(h, *tie).limit(max(n, 0)).select(*keep)
    hashed = hashed.withColumn(b, F.substring(h, 1, 4))
    sizes = sorted((r[b], r["count"]) for r in hashed.groupBy(b).count().collect())  # 65,536 rows at most
    taken, cut = 0, None
    for name, size in sizes:
        if taken + size > n:
            cut = name
            break
        taken += size
    if cut is None:
        return df
    inside = hashed.where(F.col(b) < F.lit(cut))
    at = unused([*df.columns, h, b], "_rank")
    edge = running(hashed.where(F.col(b) == F.lit(cut)), [], [h, *tie], {at: ("count", F.lit(1))}).where(F.col(at) <= F.lit(n - taken))
    return inside.select(*keep).unionByName(edge.select(*keep))


def ordered_row_number(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """0-based dense position in the global order, without a one-task window."""
    at = unused([*df.columns, out], "_at")
    numbered = running(df, [], order, {at: ("count", F.lit(1))})
    return numbered.select(*[c for c in df.columns if c != out], (F.col(at) - 1).alias(out))
