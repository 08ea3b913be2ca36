"""Utility, membership attack and feature importance from one table of counts.

A naive Bayes model needs nothing but how often each cell of a feature goes with each
label, so all models of a pair are one aggregate: both sides, the training share and every fold
of a cross-validation are columns of the same counts. A fold's model is the total less the
fold's own counts; nothing is fitted twice and every number can be repeated in SQL. A number is
cut into ``CELLS`` equal cells between its least and greatest value, a text is its own cell,
and so is null.

Scores are sums of logarithms, rounded to ``PLACES`` so that equal counts tie on any engine.
What was not measured, because rows or classes are missing, is null and never a good score.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions import hashrand
from twinlens.operators.columns import attack_id_name
from twinlens.operators.hotkeys import lookup
from twinlens.operators.modelling import label_codes
from twinlens.operators.pair import IS_REAL, Pair
from twinlens.operators.sampling import train_flag
from twinlens.operators.scan import running
from twinlens.session import stored

CELLS = 32
PLACES = 9
#: A feature's table of so many numbers goes to every task; a larger one is joined.
TABLE_NUMBERS = 1_000_000
UTILITY = ("baseline_accuracy", "tstr_accuracy", "trts_accuracy", "performance_drop")


def _cells(df: DataFrame, features: list[str], numbers: set[str], **keep: Column) -> tuple[DataFrame, list[int]]:
    """(the ``keep`` columns and the cells c0, c1, ... of each row as a stored table, distinct cells of each feature)."""
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double"))
    ends = [f(finite(c)).alias(f"{n}{i}") for i, c in enumerate(features) if c in numbers for f, n in ((F.min, "lo"), (F.max, "hi"))]
    bounds = df.agg(*ends).first() if ends else {}
    cells = []
    for i, c in enumerate(features):
        if c not in numbers:
            cells.append(F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("null")))
            continue
        low, high, v = bounds[f"lo{i}"], bounds[f"hi{i}"], F.col(c).cast("double")
        width = None if low is None else (high - low) / CELLS
        slot = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1)).cast("int") if width else F.lit(0)
        inside = F.concat(F.lit("n"), slot.cast("string"))
        cells.append(F.when(v.isNull() | F.isnan(v), F.lit("null")).when(F.abs(v) < F.lit(float("inf")), inside).otherwise(F.concat(F.lit("x"), v.cast("string"))))
    rows = stored(df.select(*[col.alias(n) for n, col in keep.items()], *[c.alias(f"c{i}") for i, c in enumerate(cells)]), "cells")
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"c{i}").alias("cell")) for i in range(len(features))]))).distinct()
    sizes = {r["feature"]: r["count"] for r in long.groupBy("feature").count().collect()}  # a row per feature
    return rows, [sizes.get(i, 0) for i in range(len(features))]


def _counts(rows: DataFrame, features: int, by: str, sums: dict[str, Column]) -> DataFrame:
    """(feature, cell, ``by``, sums): rows of each cell and ``by`` value for which each flag holds."""
    entry = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"c{i}").alias("cell")) for i in range(features)])
    long = rows.select(by, *[flag.cast("long").alias(n) for n, flag in sums.items()], F.inline(entry))
    return long.groupBy("feature", "cell", by).agg(*[F.sum(n).alias(n) for n in sums])


def _by_value(counts: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """(feature, cell, found): a map from the few ``by`` values to their sums."""
    return counts.groupBy("feature", "cell").agg(F.map_from_entries(F.collect_list(F.struct(by, F.struct(*sums)))).alias("found"))


def _numbers(values: list) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _at(found: Column, key: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(found, key)[name], F.lit(0)).cast("double")


def _joined(rows: DataFrame, model: DataFrame, sizes: list[int], width: int, values: list[str]) -> DataFrame:
    """Each row with ``values`` of its cell of every feature, as <value><feature>. Small tables travel; a feature
    with very many cells is joined on them, hot cells apart."""
    model = stored(model, "model")
    for wide in (True, False):
        for i, n in enumerate(sizes):
            if (n * width > TABLE_NUMBERS) == wide:
                own = model.where(F.col("feature") == i).select(F.col("cell").alias(f"c{i}"), *[F.col(v).alias(f"{v}{i}") for v in values])
                rows = stored(lookup(rows, own, [f"c{i}"]), "joined") if wide else rows.join(F.broadcast(own), f"c{i}")
    return rows


def _total(prior: Column, terms: list[str]) -> Column:
    for t in terms:
        prior = F.zip_with(prior, F.col(t), lambda a, b: a + b)
    return prior


def _best(scores: Column) -> Column:
    """The class of the greatest score; ties go to the smallest code."""
    near = F.transform(scores, lambda s: F.round(s, PLACES))
    return (F.array_position(near, F.array_max(near)) - 1).cast("int")


def _prior(sizes: list[int]) -> Column:
    total = sum(sizes) + len(sizes)
    return F.transform(_numbers(sizes), lambda n: F.ln((n + 1.0) / F.lit(float(total))))


def _likelihood(name: str, classes: list[int], cells: list[int]) -> Column:
    """Logarithms, by class, of a cell's smoothed share of the class."""
    size = F.element_at(_numbers(cells), F.col("feature") + 1)
    codes = F.array(*[F.lit(k) for k in range(len(classes))])
    return F.zip_with(codes, _numbers(classes), lambda k, n: F.ln((_at(F.col("found"), k, name) + 1.0) / (n + size)))


def _row_key(df: DataFrame, row_id: str | None) -> Column:
    return F.col(row_id) if row_id else F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])


def _clean(df: DataFrame, columns: list[str], numbers: set[str]) -> DataFrame:
    df = df.dropna("any", subset=columns)
    for c in columns:
        if c in numbers:
            df = df.where(F.abs(F.col(c).cast("double")) < F.lit(float("inf")))
    return df


def utility(pair: Pair, target: str, row_id: str | None = None, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """One row: accuracy of a model of the real training share on the real rest (baseline), of one of the synthetic
    side on the real rest (tstr), of the first on the synthetic side (trts), and the drop from baseline to tstr in points.

    ``row_id`` names a column that tells rows apart; it decides the split and is no feature. Without
    one the row's own values decide. Rows with a null or infinite value take no part. All four are null
    where a side has fewer than ``UTILITY_MIN_ROWS`` rows, the target one class, or no feature is left."""
    spark = pair.tagged.sparkSession
    none = spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in UTILITY])
    numbers = set(pair.numeric)
    features = [c for c in pair.columns if c in numbers.union(pair.strings) and c not in (target, row_id)]
    if target not in pair.columns or not features:
        return none
    whole = _clean(pair.tagged, [*features, target], numbers)
    label, k = label_codes(whole, target)
    rows, sizes = _cells(
        whole, features, numbers, is_real=F.col(IS_REAL), is_train=train_flag(_row_key(whole.drop(IS_REAL), row_id), seed=seed), label=label.cast("int")
    )
    found = {(r["is_real"], r["is_train"], r["label"]): r["count"] for r in rows.groupBy("is_real", "is_train", "label").count().collect()}
    size = lambda real, train: [sum(n for (a, b, c), n in found.items() if a == real and (train is None or b == train) and c == code) for code in range(k)]
    train, test, synth = size(True, True), size(True, False), size(False, None)
    if k < 2 or min(sum(train) + sum(test), sum(synth)) < C.UTILITY_MIN_ROWS or not sum(train) or not sum(test):
        return none
    counts = _counts(rows, len(features), "label", {"r": F.col("is_real") & F.col("is_train"), "s": ~F.col("is_real")})
    model = _by_value(counts, "label", ["r", "s"]).select("feature", "cell", _likelihood("r", train, sizes).alias("r"), _likelihood("s", synth, sizes).alias("s"))
    scored = _joined(rows.where(~(F.col("is_real") & F.col("is_train"))), model, sizes, 2 * k, ["r", "s"])
    hit = lambda prior, v: (_best(_total(prior, [f"{v}{i}" for i in range(len(features))])) == F.col("label")).cast("double")
    by_real, by_synth = hit(_prior(train), "r"), hit(_prior(synth), "s")
    real = F.col("is_real")
    out = scored.agg(F.avg(F.when(real, by_real)).alias("baseline_accuracy"), F.avg(F.when(real, by_synth)).alias("tstr_accuracy"), F.avg(F.when(~real, by_real)).alias("trts_accuracy"))
    return out.withColumn("performance_drop", F.greatest(F.lit(0.0), F.col("baseline_accuracy") - F.col("tstr_accuracy")) * F.lit(100.0))


def attack(pair: Pair, row_id: str | None = None, folds: int = C.ATTACK_FOLDS, seed: int = C.DEFAULT_SEED) -> DataFrame:
    """One row: accuracy (mean over both sides) and auc of telling real rows from synthetic ones, each row
    judged by a model without its fold. All rows take part; a score of 0 is half a hit.

    Identifiers and ``row_id`` are no features. ``row_id``, or the row's values, deals out the folds.
    Both are null where a side has fewer than half of ``ATTACK_MIN_ROWS`` rows or no feature is left."""
    numbers = set(pair.numeric)
    features = [c for c in pair.columns if c in numbers.union(pair.strings) and c != row_id and not attack_id_name(c)]
    spark = pair.tagged.sparkSession
    none = spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("accuracy", "auc")])
    if not features:
        return none
    fold = F.floor(hashrand.uniform(seed, _row_key(pair.tagged.drop(IS_REAL), row_id), "fold") * F.lit(float(folds))).cast("int")
    rows, sizes = _cells(pair.tagged, features, numbers, is_real=F.col(IS_REAL), fold=fold)
    found = {(r["is_real"], r["fold"]): r["count"] for r in rows.groupBy("is_real", "fold").count().collect()}
    real, synth = ([found.get((side, f), 0) for f in range(folds)] for side in (True, False))
    if 2 * min(sum(real), sum(synth)) < C.ATTACK_MIN_ROWS:
        return none
    counts = _by_value(_counts(rows, len(features), "fold", {"r": F.col("is_real"), "s": ~F.col("is_real")}), "fold", ["r", "s"])
    size = F.element_at(_numbers(sizes), F.col("feature") + 1)
    total = lambda n: F.aggregate(F.map_values("found"), F.lit(0).cast("long"), lambda a, x: a + x[n]).alias(n)
    counts = counts.select("feature", "cell", "found", total("r"), total("s"))
    per_fold = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(float(sum(real) - real[f])).alias("nr"), F.lit(float(sum(synth) - synth[f])).alias("ns")) for f in range(folds)])

    def odds(x: Column) -> Column:
        r = F.col("r") - _at(F.col("found"), x["f"], "r")
        s = F.col("s") - _at(F.col("found"), x["f"], "s")
        return F.ln((r + 1.0) / (x["nr"] + size)) - F.ln((s + 1.0) / (x["ns"] + size))

    scored = _joined(rows, counts.select("feature", "cell", F.transform(per_fold, odds).alias("w")), sizes, folds, ["w"])
    score = F.lit(0.0)
    for i in range(len(features)):
        score = score + F.element_at(f"w{i}", F.col("fold") + 1)
    freq = scored.select("is_real", (F.round(score, PLACES) + F.lit(0.0)).alias("score")).groupBy("score").agg(
        F.count(F.when(F.col("is_real"), 1)).alias("r"), F.count(F.when(~F.col("is_real"), 1)).alias("s")
    )
    ranked = running(freq, [], ["score"], {"upto": ("count", "s")})
    n_real, n_synth = F.lit(float(sum(real))), F.lit(float(sum(synth)))
    above, level = F.col("score") > 0, F.col("score") == 0
    right = lambda n, side: F.sum(F.when(side, F.col(n)).when(level, F.col(n) / 2).otherwise(0.0))
    return ranked.agg(
        ((right("r", above) / n_real + right("s", ~above & ~level) / n_synth) / 2).alias("accuracy"),
        (F.sum(F.col("r") * (F.col("upto") - F.col("s") / 2)) / n_real / n_synth).alias("auc"),
    )


def _shift(seed: int, name: str) -> float:
    """Uniform draw for a feature, as ``hashrand.uniform`` makes it."""
    return (int(hashlib.md5(f"{seed}|{name}|shuffle".encode()).hexdigest()[:8], 16) + 0.5) / hashrand.TWO_POW_32


def importance(df: DataFrame, target: str, features: list[str] | None = None, row_id: str | None = None, seed: int = C.DEFAULT_SEED, top: int | None = None) -> DataFrame:
    """(feature, importance, rank): how much accuracy on the test share is lost when a feature's values are
    dealt to other rows. ``top`` keeps the first few.

    Rows are numbered by their digest, and a feature moves on by a number of places that its name
    decides: a permutation by one join on row numbers, without a sort, and the same on every run. Rows with a
    null or infinite value take no part. Importance and rank are null if the target has one class or the split leaves a share empty."""
    pair = Pair(df.withColumn(IS_REAL, F.lit(True)))
    numbers = set(pair.numeric)
    features = features or [c for c in pair.columns if c in numbers and c not in (target, row_id)]
    spark = df.sparkSession
    if not features:
        raise ValueError("no feature")
    whole = _clean(pair.tagged, [*features, target], numbers)
    label, k = label_codes(whole, target)
    key = _row_key(df, row_id)
    rows, sizes = _cells(whole, features, numbers, is_train=train_flag(key, seed=seed), label=label.cast("int"), place=hashrand.digest(seed, key, "place"))
    found = {(r["is_train"], r["label"]): r["count"] for r in rows.groupBy("is_train", "label").count().collect()}
    train = [found.get((True, code), 0) for code in range(k)]
    n = sum(c for (is_train, _), c in found.items() if not is_train)
    if k < 2 or not sum(train) or not n:
        return spark.createDataFrame([(f, None, None) for f in sorted(features)], "feature string, importance double, rank int")
    model = _by_value(_counts(rows.where("is_train"), len(features), "label", {"r": F.lit(True)}), "label", ["r"])
    every = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"c{i}").alias("cell")) for i in range(len(features))]))).distinct()
    model = every.join(model, ["feature", "cell"], "left").select("feature", "cell", _likelihood("r", train, sizes).alias("r"))
    terms = [f"r{i}" for i in range(len(features))]
    scored = _joined(rows.where("not is_train"), model, sizes, k, ["r"]).select("label", "place", _total(_prior(train), terms).alias("total"), *terms)
    test = running(scored, [], ["place"], {"at": ("count", F.lit(1))}).drop("place")
    parts = []
    for i, name in enumerate(features):
        step = 1 + int(_shift(seed, name) * (n - 1))
        other = test.select(((F.col("at") - 1 + step) % n + 1).alias("at"), F.col(f"r{i}").alias("other"))
        moved = F.zip_with(F.zip_with("total", f"r{i}", lambda a, b: a - b), "other", lambda a, b: a + b)
        hits = test.join(other, "at").select((_best(moved) == F.col("label")).cast("double").alias("moved"), (_best(F.col("total")) == F.col("label")).cast("double").alias("own"))
        parts.append(hits.agg((F.avg("own") - F.avg("moved")).alias("importance")).select(F.lit(name).alias("feature"), "importance"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lost = out.collect()  # a row per feature
    ranked = sorted(((r["feature"], round(r["importance"], PLACES)) for r in lost), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(ranked[:top])], "feature string, importance double, rank int")
