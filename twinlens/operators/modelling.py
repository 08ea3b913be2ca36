"""Classifier-based metrics: utility, membership attack, importance."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.operators.cleaning import fill_nulls
from twinlens.operators.columns import attack_id_name, numeric_columns, string_columns
from twinlens.operators.ordered import ordered_row_number
from twinlens.operators.pair import IS_REAL, Pair
from twinlens.operators.profile import distinct_counts, long_values
from twinlens.operators.sampling import fold_assign, sample_n, train_flag
from twinlens.session import spread

#: What was not measured is null, and the judge then has no data to approve on.
NO_UTILITY = {"baseline_accuracy": None, "tstr_accuracy": None, "trts_accuracy": None, "performance_drop": None}
LOG = logging.getLogger(__name__)
WINDOW_LIMIT = 1_000_000
#: A classifier needs a tree's leaf for each class; a target with more values is none.
CLASS_LIMIT = 1000
HASH_CODES = 1 << 20
#: Folds fitted at the same time have about so many rows together.
FOLD_ROWS = 10_000_000
#: What a fit raises on tables it can't learn from; other errors are faults and pass through.
FAILURES = (Py4JJavaError, PySparkException, ValueError)


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): codes 0.. in sorted order of the distinct values.

    Distinct values come first. Up to a million are ranked in a window per
    column; beyond, each column is ranked over range partitions.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, code long")
    _, counts = distinct_counts(df, columns)
    values = long_values(df, columns, cast="string").distinct()
    small = [c for c in columns if counts[c][1] <= WINDOW_LIMIT]
    parts = []
    if small:
        rank = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
        parts.append(values.where(F.col("column").isin(small)).withColumn("code", rank.cast("bigint")))
    for c in columns:
        if c not in small:
            ranked = ordered_row_number(values.where(F.col("column") == c), ["value"], "code")
            parts.append(ranked.select("column", "value", F.col("code").cast("bigint").alias("code")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _plain(df: DataFrame, names: list[str], **keep) -> tuple[DataFrame, list[str]]:
    """Feature columns under names of their own (x0, x1, ...), beside the ``keep``
    columns, so a user's column may be called anything. A string is two numbers, its
    digests under two seeds: one encoding whatever the number of values, with no
    dictionary. Forests cut each of the two into 32 bins, so a rare value among thousands is never
    alone; the counts in ``bayes`` keep every value apart."""
    numbers = [c for c in numeric_columns(df) if c in names]
    strings = [c for c in string_columns(df) if c in names]
    inputs = [F.col(c).cast("double") for c in numbers]
    inputs += [F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(HASH_CODES)).cast("double") for c in strings for seed in (1, 2)]
    if not inputs:
        raise ValueError("no feature column")
    x = [f"x{i}" for i in range(len(inputs))]
    return df.select(*[col.alias(name) for name, col in keep.items()], *[col.alias(name) for name, col in zip(x, inputs, strict=True)]), x


def _finite(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.abs(F.col(c)) < F.lit(float("inf")))
    return df


def label_codes(df: DataFrame, target: str) -> tuple[Column, int]:
    """The sorted code of the target's value over both sides, and the number of classes."""
    classes = [r[0] for r in df.select(F.col(target).cast("string")).distinct().limit(CLASS_LIMIT + 1).collect()]
    if len(classes) > CLASS_LIMIT:
        raise ValueError(f"{target} has more than {CLASS_LIMIT} classes: no target of a classifier")
    numeric = target in numeric_columns(df)
    ordered = sorted((c for c in classes if c is not None), key=(float if numeric else str))
    codes = F.array(*[F.lit(c) for c in ordered]) if ordered else F.array().cast("array<string>")
    position = F.array_position(codes, F.col(target).cast("string"))
    return F.when(position > 0, (position - 1).cast("double")), len(ordered)


def _classifier(classes: int, model: str, seed: int):
    if model == "gbt" and classes == 2:
        return GBTClassifier(maxIter=20, maxDepth=5, seed=seed)
    return RandomForestClassifier(numTrees=30, maxDepth=6, seed=seed)


def _accuracy(model, df: DataFrame) -> float:
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return model.transform(df).agg(F.coalesce(F.avg(hit), F.lit(0.0))).first()[0]


def utility_scores(pair: Pair, target: str, model: str = "forest", seed: int = C.DEFAULT_SEED) -> dict[str, float | None]:
    """Accuracy real-to-real, synthetic-to-real and real-to-synthetic, and the
    drop in points. The real side is split 70/30 by row digest.

    All are null where a side has fewer than ``UTILITY_MIN_ROWS`` complete rows or the
    target is no column. Codes are fitted on the union of both sides, so the same text means the
    same number on both. ``model`` is "forest" or "gbt" (two classes only).
    """
    if target not in pair.columns:
        return dict(NO_UTILITY)
    whole = pair.tagged.dropna("any")
    label, classes = label_codes(whole, target)
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in whole.columns if c != IS_REAL])
    shaped, x = _plain(whole, [c for c in pair.columns if c != target], is_real=F.col(IS_REAL), label=label, is_train=train_flag(row, seed=seed))
    assembled = VectorAssembler(inputCols=x, outputCol="features", handleInvalid="skip").transform(_finite(shaped, x))
    ready = spread(assembled.select("is_real", "is_train", "label", "features"), whole.count()).persist()
    try:
        sizes = {r["is_real"]: r["n"] for r in ready.groupBy("is_real").agg(F.count(F.lit(1)).alias("n")).collect()}
        if min(sizes.get(True, 0), sizes.get(False, 0)) < C.UTILITY_MIN_ROWS:
            return dict(NO_UTILITY)
        real, synth = ready.where(F.col("is_real")), ready.where(~F.col("is_real"))
        test = real.where(~F.col("is_train"))
        on_real = _classifier(classes, model, seed).fit(real.where(F.col("is_train")))
        on_synth = _classifier(classes, model, seed).fit(synth)
        base, tstr, trts = _accuracy(on_real, test), _accuracy(on_synth, test), _accuracy(on_real, synth)
        return {
            "baseline_accuracy": base,
            "tstr_accuracy": tstr,
            "trts_accuracy": trts,
            "performance_drop": max(0.0, base - tstr) * 100.0,
        }
    finally:
        ready.unpersist()


def utility_or_failed(pair: Pair, target: str, **options) -> dict[str, float | None]:
    """As ``utility_scores``; a model that cannot be fitted counts as a full drop."""
    try:
        return utility_scores(pair, target, **options)
    except FAILURES:
        LOG.warning("utility failed", exc_info=True)
        return {**NO_UTILITY, "performance_drop": C.UTILITY_FAILED_DROP}


def folds_at_once(rows: int) -> int:
    return max(1, min(C.ATTACK_FOLDS, FOLD_ROWS // max(rows, 1)))


def attack_accuracy(
    pair: Pair, rows: int | None = None, trees: int = C.ATTACK_TREES, depth: int = C.ATTACK_DEPTH, seed: int = C.DEFAULT_SEED
) -> float | None:
    """Cross-validated accuracy of a forest that tells real rows from synthetic.

    All rows of the smaller side and as many of the other take part; ``rows``
    sets a smaller number per side. Identifiers are dropped, nulls become 0. Null where
    there are fewer than ``ATTACK_MIN_ROWS`` rows to tell apart: nothing was measured.
    """
    names = [c for c in pair.columns if not attack_id_name(c)]
    filled = fill_nulls(pair.tagged.select(IS_REAL, *names))
    sizes = {r[IS_REAL]: r["count"] for r in filled.groupBy(IS_REAL).count().collect()}
    n = min(sizes.get(True, 0), sizes.get(False, 0), *([rows] if rows else []))
    if 2 * n < C.ATTACK_MIN_ROWS:
        return None
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in names])

    def side(real: bool) -> DataFrame:
        part = filled.where(F.col(IS_REAL) == F.lit(real))
        return part if sizes[real] <= n else sample_n(part, n, row, names, seed)

    shaped, x = _plain(side(True).unionByName(side(False)), names, label=F.col(IS_REAL).cast("double"))
    shaped = _finite(shaped, x)
    row_id = F.concat_ws("|", *[F.col(c).cast("string") for c in shaped.columns])
    folded = fold_assign(shaped, "label", row_id, [], seed=seed)
    ready = spread(VectorAssembler(inputCols=x, outputCol="features", handleInvalid="skip").transform(folded).select("label", "features", "fold"), 2 * n).persist()
    try:
        def one(fold: int) -> float:
            attacker = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
            return _accuracy(attacker.fit(ready.where(F.col("fold") != fold)), ready.where(F.col("fold") == fold))

        ready.count()
        # The folds are independent jobs; Spark runs them side by side, of many rows fewer at once: each keeps a number a row and tree.
        with ThreadPoolExecutor(folds_at_once(2 * n)) as pool:
            tasks = [pool.submit(inheritable_thread_target(ready.sparkSession)(one), fold) for fold in range(C.ATTACK_FOLDS)]
            scores = [t.result() for t in tasks]
        return sum(scores) / len(scores)
    finally:
        ready.unpersist()


def attack_or_failed(pair: Pair, **options) -> float | None:
    """As ``attack_accuracy``; an attack that cannot be run is null, which the judge
    takes as missing data. It never counts as a safe table."""
    try:
        return attack_accuracy(pair, **options)
    except FAILURES:
        LOG.warning("membership attack failed", exc_info=True)
        return None


def feature_importance(df: DataFrame, target: str, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """(feature, importance, rank) of numeric features in a forest for the target.

    A continuous target, or one with more than ten values, is cut at its median.
    """
    from twinlens.operators.describe import binarise_target

    numbers = [c for c in numeric_columns(df) if c != target]
    clean = df.select(*numbers, target).dropna("any")
    if not numbers:
        raise ValueError("no numeric feature")
    if target in numeric_columns(clean):
        whole = clean.schema[target].dataType.typeName() not in ("double", "float")
        if not whole or distinct_counts(clean, [target], small=True)[1][target][1] > 10:
            clean = binarise_target(clean, target, target)
    label, classes = label_codes(clean, target)
    if classes < 2:
        raise ValueError(f"{target} has one class only")
    shaped, x = _plain(clean, numbers, label=label)
    ready = spread(VectorAssembler(inputCols=x, outputCol="features").transform(shaped).select("label", "features"), clean.count())
    model = RandomForestClassifier(numTrees=30, maxDepth=6, seed=seed).fit(ready)
    weights = [float(w) for w in model.featureImportances.toArray()]
    ranked = sorted(zip(numbers, weights), key=lambda x: (-x[1], x[0]))
    rows = [(name, weight, i + 1) for i, (name, weight) in enumerate(ranked)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, rank int")
