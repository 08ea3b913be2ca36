"""Full scorecards of very many pairs at once: one row per segment of a tagged table.

A pair's scorecard asks for a dozen jobs; a thousand pairs would ask for a thousand times as many.
Here the segment is one more key of the same counts: every distinct value of every column is counted
once, and distances, divergences and identifier rules come out of that one table; the same is done
with cells for the classifiers of ``bayes``. No segment is handled by itself, so the number of jobs
does not depend on the number of segments.

Segments of up to ``WHOLE_ROWS`` rows (or one in a thousand of all) are dealt to partitions once; every
count, running count and lookup then stays within the partition, so what travels is the rows,
once, however many segments there are. Rows of larger segments, fewer than a thousand, are spread: counts are combined
before they travel, running counts go by ranges of rows, and lookups tell hot keys apart.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens import constants as C
from twinlens.functions import hashrand
from twinlens.operators.bayes import CELLS, PLACES, UTILITY
from twinlens.operators.columns import attack_id_name, is_numeric, judge_id_name, quasi_identifiers
from twinlens.operators.fidelity import hash_normals
from twinlens.operators.hotkeys import SHARE, hot_of, lookup
from twinlens.operators.pair import IS_REAL
from twinlens.operators.sampling import train_flag
from twinlens.operators.scan import running
from twinlens.session import setting, stored

FLAT = 1e-14
#: A segment with so many rows, or one in ``SHARE`` of all, stays in one partition; partitions have about ``PART_ROWS``.
WHOLE_ROWS = 250_000
PART_ROWS = 100_000
#: Up to so many classes of a segment are added up side by side, more as arrays.
CLASSES_WIDE = 32
#: A column with up to so many cells in every segment is looked up in an array of its segment, others are joined.
CELLS_WIDE = 64
#: Pairs of columns whose moments one aggregate takes.
PAIRS_AT_ONCE = 8
#: Columns whose own moments one aggregate takes.
COLUMNS_AT_ONCE = 3
#: Longer code of a step is not compiled by the JVM.
METHOD_BYTES = 8000
#: Counts of the two sides travel as one number, as fewer than 2^31 rows lie in a segment that stays whole.
UPPER = 1 << 32


def _sum_if(test: Column, value: Column | None = None) -> Column:
    return F.coalesce(F.sum(F.when(test, F.lit(1) if value is None else value)), F.lit(0))


def _plain(tagged: DataFrame, segment: str, row_id: Column | None, target: str | None, folds: int, seed: int):
    """(rows as seg, is_real, x0.. (numbers), t0.. (texts), label, fold, is_train; names of numbers; names of texts)."""
    skip = {segment, IS_REAL}
    numbers = [f.name for f in tagged.schema if is_numeric(f.dataType) and f.name not in skip]
    texts = [f.name for f in tagged.schema if f.dataType.typeName() == "string" and f.name not in skip]
    x = [F.col(f"`{c}`").cast("double") for c in numbers]
    x = [F.when(F.abs(v) < F.lit(math.inf), v) for v in x]  # NaN and infinity are missing
    t = [F.col(f"`{c}`") for c in texts]
    key = row_id if row_id is not None else F.concat_ws("|", *[v.cast("string") for v in (*x, *t)])
    label = F.lit(None).cast("string") if target is None else F.col(f"`{target}`").cast("string")
    fold = F.floor(hashrand.uniform(seed, key, "fold") * F.lit(float(folds))).cast("int")
    rows = tagged.where(F.col(f"`{segment}`").isNotNull()).select(
        F.col(f"`{segment}`").alias("seg"),
        F.coalesce(F.col(IS_REAL), F.lit(False)).alias("is_real"),
        *[v.alias(f"x{i}") for i, v in enumerate(x)],
        *[v.alias(f"t{i}") for i, v in enumerate(t)],
        label.alias("label"),
        fold.alias("fold"),
        train_flag(key, seed=seed).alias("is_train"),
    )
    return rows, numbers, texts


def _known(count: int) -> Column:
    out = F.lit(True)
    for i in range(count):
        out = out & F.col(f"x{i}").isNotNull()
    return out


def _moments(rows: DataFrame, d: int, gaps: frozenset[int] | None = None) -> DataFrame:
    """(seg, n_real, n_synth, lo, hi, mean, sd, correlation_similarity): one aggregate by segment and side, folded once more.

    Without nulls a column has one deviation, whatever it is paired with; only columns in ``gaps`` (all without it) have nulls."""
    gaps = frozenset(range(d)) if gaps is None else gaps
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    known = {(i, j): [F.col(f"x{k}").isNotNull() for k in sorted({i, j} & gaps)] for i, j in pairs}

    def where(tests: list[Column], value: Column) -> Column:
        for t in tests:
            value = F.when(t, value)
        return value

    every = [F.col(f"x{k}").isNotNull() for k in sorted(gaps)]
    whole = [F.count(F.lit(1)).alias("n"), F.count(where(every, F.lit(1))).alias("whole")]
    single, joint = [], []
    for i in range(d):
        v = where(every, F.col(f"x{i}"))
        single.append([F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")])
    for i, j in pairs:
        one, two = where(known[i, j], F.col(f"x{i}")), where(known[i, j], F.col(f"x{j}"))
        # expressions that are alike are aggregated once
        shared = [F.covar_pop(one, two).alias(f"c{i}_{j}")] if i != j else []
        joint.append([*shared, *([F.var_pop(one).alias(f"p{i}_{j}"), F.var_pop(two).alias(f"q{i}_{j}")] if gaps else [])])
    # Code of one aggregate over too many columns is too long for the JVM to compile.
    bunches = [[c for cols in found[i : i + n] for c in cols] for found, n in ((single, COLUMNS_AT_ONCE), (joint, PAIRS_AT_ONCE)) for i in range(0, len(found), n)]
    bunches = [b for b in bunches if b]
    if d <= COLUMNS_AT_ONCE:
        bunches = [[c for b in bunches for c in b]]
    sides = rows.groupBy("seg", "is_real").agg(*whole, *bunches[0])
    for bunch in bunches[1:]:
        sides = sides.join(rows.groupBy("seg", "is_real").agg(*bunch), ["seg", "is_real"])
    if not gaps:
        sides = sides.select("*", *[F.col(f"v{at}").alias(f"{n}{i}_{j}") for i, j in pairs for n, at in (("p", i), ("q", j))])

    def corr(i: int, j: int) -> Column:
        vx, vy = F.col(f"p{i}_{j}"), F.col(f"q{i}_{j}")
        top = lambda k: F.greatest(F.abs(f"lo{k}"), F.abs(f"hi{k}"))
        dust = lambda v, k: v <= F.lit(FLAT) * top(k) * top(k)
        value = F.lit(1.0) if i == j else F.try_divide(F.col(f"c{i}_{j}"), F.sqrt(vx) * F.sqrt(vy))
        return F.coalesce(F.when(dust(vx, i) | dust(vy, j), F.lit(0.0)).otherwise(F.when(vx.isNotNull(), value)), F.lit(0.0))

    corrs = F.array(*[corr(i, j) for i, j in pairs]) if pairs else F.array().cast("array<double>")
    per = lambda p: F.array(*[F.col(f"{p}{i}") for i in range(d)]) if d else F.array().cast("array<double>")
    sides = sides.select("seg", "is_real", "n", "whole", per("lo").alias("lo"), per("hi").alias("hi"), per("m").alias("m"), per("v").alias("v"), corrs.alias("corr"))
    side = lambda c, real: F.max(F.when(F.col("is_real") == F.lit(real), F.col(c))).alias(f"{c}_{'r' if real else 's'}")
    wide = sides.groupBy("seg").agg(*[side(c, real) for c in ("n", "whole", "lo", "hi", "m", "v", "corr") for real in (True, False)])
    both_ends = lambda c, f: F.array(*[f(F.col(f"{c}_r")[i], F.col(f"{c}_s")[i]) for i in range(d)]) if d else F.array().cast("array<double>")

    # Pooled mean and deviation from those of the two sides.
    nr, ns = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("whole_r", "whole_s"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean, sd = [], []
    for i in range(d):
        a, b = zero(F.col("m_r")[i]), zero(F.col("m_s")[i])
        mean.append(zero(F.try_divide(a * nr + b * ns, nr + ns)))
        square = zero(F.col("v_r")[i]) * nr + zero(F.col("v_s")[i]) * ns + zero(F.try_divide(nr * ns, nr + ns)) * (a - b) * (a - b)
        dev = F.sqrt(F.try_divide(square, F.when(nr + ns > 1, nr + ns - 1.0)))
        sd.append(F.when(dev > 0, dev).otherwise(F.lit(1.0)))
    weights = F.array(*[F.lit(1.0 if i == j else 2.0) for i, j in pairs]) if pairs else None
    similar = F.lit(1.0)
    if d >= 2:
        gaps = F.zip_with(F.zip_with("corr_r", "corr_s", lambda a, b: (a - b) * (a - b)), weights, lambda g, w: g * w)
        similar = F.lit(1.0) / (F.lit(1.0) + F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g)))
    array = lambda cols: F.array(*cols) if cols else F.array().cast("array<double>")
    return wide.select(
        "seg",
        F.coalesce("n_r", F.lit(0)).alias("n_real"),
        F.coalesce("n_s", F.lit(0)).alias("n_synth"),
        both_ends("lo", F.least).alias("lo"),
        both_ends("hi", F.greatest).alias("hi"),
        array(mean).alias("mean"),
        array(sd).alias("sd"),
        similar.alias("correlation_similarity"),
    )


def _value_counts(rows: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """(seg, feature, num, text, n_real, n_synth): every distinct value of every column of every segment."""
    entry = [F.struct(F.lit(i).alias("feature"), F.col(f"x{i}").alias("num"), F.lit(None).cast("string").alias("text")) for i in range(len(numbers))]
    entry += [F.struct(F.lit(len(numbers) + i).alias("feature"), F.lit(None).cast("double").alias("num"), F.col(f"t{i}").alias("text")) for i in range(len(texts))]
    long = rows.select("seg", "is_real", F.inline(F.array(*entry))).where("num is not null or text is not null")
    return long.groupBy("seg", "feature", "num", "text").agg(F.count_if("is_real").alias("n_real"), F.count_if(~F.col("is_real")).alias("n_synth"))


def _column_totals() -> dict[str, Column]:
    return {"t_real": F.sum("n_real"), "t_synth": F.sum("n_synth"), "distinct": F.count_if(F.col("n_real") > 0), "lo": F.min("num"), "hi": F.max("num")}


def _ranked_spread(values: DataFrame) -> DataFrame:
    """The value counts with the column's totals and running counts, by ranges of rows."""
    values = stored(values, "values")
    rows = lookup(values, values.groupBy("seg", "feature").agg(*[c.alias(n) for n, c in _column_totals().items()]), ["seg", "feature"])
    return running(rows, ["seg", "feature"], ["num", "text"], {"upto_real": ("count", "n_real"), "upto_synth": ("count", "n_synth")})


def _ranked_whole(values: DataFrame) -> DataFrame:
    """As ``_ranked_spread``, for segments that lie in one partition each."""
    column = Window.partitionBy("seg", "feature")
    upto = column.orderBy("num", "text").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.select("*", *[F.sum(f"n_{s}").over(upto).alias(f"upto_{s}") for s in ("real", "synth")])
    return ranked.select("*", *[c.over(column).alias(n) for n, c in _column_totals().items()])


def _distances(ranked: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """(seg, wasserstein, js_divergence, kl_divergence) from the counts alone.

    The area between two distribution functions is summed by parts: each value times the change of the gap
    at it. So no value needs to know its neighbour, and running counts are enough."""
    share = lambda n, side: F.try_divide(F.col(n).cast("double"), F.col(f"t_{side}").cast("double"))
    after = F.abs(share("upto_real", "real") - share("upto_synth", "synth"))
    before = F.abs(F.try_divide((F.col("upto_real") - F.col("n_real")).cast("double"), F.col("t_real").cast("double")) - F.try_divide((F.col("upto_synth") - F.col("n_synth")).cast("double"), F.col("t_synth").cast("double")))
    p, q = (F.coalesce(share(f"n_{s}", s), F.lit(0.0)) for s in ("real", "synth"))
    m = (p + q) / F.lit(2.0)
    half = lambda a: F.when(a > 0, a * F.ln(a / m)).otherwise(F.lit(0.0))
    pf, qf = (F.when(s > 0, s).otherwise(F.lit(C.KL_FILL)) for s in (p, q))
    by_column = ranked.groupBy("seg", "feature", "t_real", "t_synth", "distinct", "lo", "hi").agg(
        F.sum((F.col("num") - F.col("lo")) * (before - after)).alias("w1"),
        F.sum((half(p) + half(q)) / F.lit(2.0)).alias("js"),
        F.sum(pf * F.ln(pf / qf)).alias("x"),
        F.sum(pf).alias("s"),
        F.sum(qf).alias("t"),
    )
    judged = [i for i, c in enumerate(numbers) if not judge_id_name(c)]
    counted = F.col("feature").isin(judged) & (F.col("t_real") > 0) & (F.col("t_synth") > 0)
    counted = counted & ~(F.col("distinct") > F.lit(C.JUDGE_UNIQUE_RATIO) * F.col("t_real"))
    scale = F.greatest(F.col("hi") - F.col("lo"), F.lit(C.RANGE_FLOOR))
    return by_column.groupBy("seg").agg(
        F.coalesce(F.avg(F.when(counted, F.abs(F.col("w1")) / scale)), F.lit(0.0)).alias("wasserstein"),
        F.coalesce(F.avg(F.when(F.col("feature") >= len(numbers), F.col("js"))), F.lit(0.0)).alias("js_divergence"),
        F.coalesce(F.avg(F.col("x") / F.col("s") - F.ln(F.col("s") / F.col("t"))), F.lit(0.0)).alias("kl_divergence"),
    )


def _mmd(rows: DataFrame, d: int, features: int, seed: int) -> DataFrame:
    """(seg, mmd) by random features of numbers brought to the segment's own mean and deviation."""
    omega = [hash_normals(seed, f"w{i}", features) * math.sqrt(2.0 / d) for i in range(d)]
    angles = [sum((F.col(f"z{i}") * F.lit(float(omega[i][j])) for i in range(1, d)), F.col("z0") * F.lit(float(omega[0][j]))) for j in range(features)]
    scaled = rows.where(_known(d)).select("seg", "is_real", *[((F.col(f"x{i}") - F.col("mean")[i]) / F.col("sd")[i]).alias(f"z{i}") for i in range(d)])
    turned = scaled.select("seg", "is_real", *[a.alias(f"a{j}") for j, a in enumerate(angles)])
    means = turned.groupBy("seg", "is_real").agg(F.array(*[f(F.col(f"a{j}")) for j in range(features) for f in (lambda a: F.avg(F.cos(a)), lambda a: F.avg(F.sin(a)))]).alias("at"))
    sides = means.groupBy("seg").agg(*[F.max(F.when(F.col("is_real") == F.lit(real), F.col("at"))).alias(n) for n, real in (("r", True), ("s", False))])
    square = F.aggregate(F.zip_with("r", "s", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, g: a + g)
    return sides.select("seg", F.sqrt(square / F.lit(float(features))).alias("mmd"))


def _copies(rows: DataFrame, d: int, t: int, quasi: list[str]) -> DataFrame:
    """(seg, exact_matches, k_anonymity) from one count of row contents."""
    content = [*[f"x{i}" for i in range(d)], *[f"t{i}" for i in range(t)]]
    counts = rows.groupBy("seg", *content).agg(F.count_if("is_real").alias("r"), F.count_if(~F.col("is_real")).alias("s"))
    if not quasi:
        return counts.groupBy("seg").agg(F.count_if((F.col("r") > 0) & (F.col("s") > 0)).alias("exact_matches"), F.when(F.sum("s") > 0, F.sum("s")).alias("k_anonymity"))
    groups = counts.groupBy("seg", *quasi).agg(F.count_if((F.col("r") > 0) & (F.col("s") > 0)).alias("same"), F.sum("s").alias("s"))
    return groups.groupBy("seg").agg(F.sum("same").alias("exact_matches"), F.min(F.when(F.col("s") > 0, F.col("s"))).alias("k_anonymity"))


def _best(scores: Column) -> Column:
    near = F.transform(scores, lambda v: F.round(v, PLACES))
    return F.array_position(near, F.array_max(near)).cast("int")


def _first_best(scores: list[str]) -> Column:
    """As ``_best`` of scores of which only the last may be null. Only those that rounding could make equal are rounded."""
    if not scores:
        return F.lit(None).cast("int")
    cols = [F.col(c) for c in scores]
    most = lambda cols: F.greatest(*cols) if len(cols) > 1 else cols[0]
    first = lambda cols: F.coalesce(*[F.when(c == most(cols), F.lit(i + 1)) for i, c in enumerate(cols)])
    close = sum((F.coalesce((c >= most(cols) - F.lit(2.0 * 10.0**-PLACES)).cast("int"), F.lit(0)) for c in cols), F.lit(0))
    return F.when(close == 1, first(cols)).when(close > 1, first([F.round(c, PLACES) for c in cols]))


def _cells(rows: DataFrame, names: list[str], d: int, target: str | None) -> DataFrame:
    """(seg, is_real, fold, label, part, c0, c1, ...): each row's share of the fits and its cell of every column.

    Cells of numbers are integers, ``CELLS`` for nulls; those of texts are texts."""
    complete = F.col("label").isNotNull() if target else F.lit(False)
    cells = []
    for i in range(len(names)):
        if i >= d:
            cells.append(F.coalesce(F.concat(F.lit("v"), F.col(f"t{i - d}")), F.lit("null")))
            complete = complete & F.col(f"t{i - d}").isNotNull()
            continue
        v, lo, hi = F.col(f"x{i}"), F.col("lo")[i], F.col("hi")[i]
        slot = F.least(F.floor(F.try_divide(v - lo, (hi - lo) / F.lit(float(CELLS)))), F.lit(CELLS - 1)).cast("int")
        cells.append(F.when(v.isNull(), F.lit(CELLS)).when(hi > lo, slot).otherwise(F.lit(0)))
        complete = complete & v.isNotNull()
    return rows.select(
        "seg", "is_real", "fold", "label",
        F.when(~complete, F.lit("none")).when(~F.col("is_real"), F.lit("synth")).when(F.col("is_train"), F.lit("train")).otherwise(F.lit("test")).alias("part"),
        *[c.alias(f"c{i}") for i, c in enumerate(cells)],
    )


def _segment_totals(rows: DataFrame, folds: int) -> DataFrame:
    """(seg, rows of each fold, classes with their rows, rows of each part), stored."""
    part = F.col("part")
    sides = rows.groupBy("seg", "fold", "label").agg(
        _sum_if(F.col("is_real")).alias("r"), _sum_if(~F.col("is_real")).alias("s"), *[_sum_if(part == p).alias(p) for p in ("train", "test", "synth")]
    )
    per_class = sides.groupBy("seg", "label").agg(*[F.sum(c).alias(c) for c in ("train", "test", "synth")]).where("train + test + synth > 0")
    classes = per_class.groupBy("seg").agg(
        F.sort_array(F.collect_list(F.struct("label", "train", "synth"))).alias("classes"), *[F.sum(c).alias(f"n_{c}") for c in ("train", "test", "synth")]
    ).withColumn("labels", F.col("classes.label"))
    whole = sides.groupBy("seg").agg(
        F.array(*[_sum_if(F.col("fold") == f, F.col("r")) for f in range(folds)]).alias("fold_r"),
        F.array(*[_sum_if(F.col("fold") == f, F.col("s")) for f in range(folds)]).alias("fold_s"),
    )
    return stored(whole.join(classes, "seg", "left"), "segments")


GRAIN = ["seg", "feature", "cell"]


def _long(rows: DataFrame, features: int, *keep: str) -> DataFrame:
    return rows.select("seg", *keep, F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"c{i}").cast("string").alias("cell")) for i in range(features)])))


def _add(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _terms(model: DataFrame, used: list[int]) -> DataFrame:
    """(seg, feature, cell, size, odds by fold, by_real and by_synth by class) of cells with their segment's totals."""
    less = lambda c: F.transform(c, lambda x: (_add(F.col(c)) - x).cast("double"))
    share = lambda at, n: F.zip_with(less(at), less(n), lambda a, b: F.ln((a + 1.0) / (b + F.col("size"))))
    odds = F.zip_with(share("at_r", "fold_r"), share("at_s", "fold_s"), lambda a, b: a - b)

    def terms(side: str) -> Column:
        """By class: logarithm of the cell's share; the first feature brings the class's own share as well."""
        k = F.size("classes").cast("double")
        if "found" in model.columns:
            own = F.transform("classes", lambda c: F.coalesce(F.try_element_at("found", c["label"])[side], F.lit(0)))
        else:
            own = F.slice(f"own_{side}", 1, k.cast("int"))
        prior = lambda c: F.when(F.col("feature") == F.lit(used[0] if used else -1), F.ln((c[side] + 1.0) / (F.col(f"n_{side}") + k))).otherwise(F.lit(0.0))
        return F.zip_with("classes", own, lambda c, n: F.ln((n.cast("double") + 1.0) / (c[side] + F.col("size_whole"))) + prior(c))

    return model.select(*[c for c in (*GRAIN, "text", "size") if c in model.columns], odds.alias("odds"), terms("train").alias("by_real"), terms("synth").alias("by_synth"))


SIDES = ("by_real", "by_synth")


def _scored_spread(cells: DataFrame, segments: DataFrame, names: list[str], used: list[int], attacked: list[int], folds: int, k: int) -> DataFrame:
    """(seg, is_real, label, part, score and the sums of the class terms) of each row, by a join of all its cells."""
    part = F.col("part")
    long = _long(cells, len(names), "row", "is_real", "fold", "label", "part")
    counts = long.groupBy(*GRAIN, "fold", "label").agg(
        _sum_if(F.col("is_real")).alias("r"), _sum_if(~F.col("is_real")).alias("s"), *[_sum_if(part == p).alias(p) for p in ("train", "synth")], _sum_if(part != "none").alias("whole")
    )
    counts = stored(counts, "cell_counts")
    by_fold = counts.groupBy(*GRAIN).agg(
        *[F.array(*[_sum_if(F.col("fold") == f, F.col(side)) for f in range(folds)]).alias(f"at_{side}") for side in ("r", "s")], F.sum("whole").alias("whole")
    )
    by_class = counts.where(F.col("label").isNotNull()).groupBy(*GRAIN, "label").agg(F.sum("train").alias("train"), F.sum("synth").alias("synth"))
    by_class = by_class.groupBy(*GRAIN).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("train", "synth")))).alias("found"))
    cell = stored(by_fold.join(by_class, GRAIN, "left"), "cell_model")
    sizes = cell.groupBy("seg", "feature").agg(F.count(F.lit(1)).cast("double").alias("size"), F.count_if(F.col("whole") > 0).cast("double").alias("size_whole"))
    model = stored(lookup(cell, sizes, ["seg", "feature"]), "cell_sizes")
    model = stored(_terms(lookup(model, segments, ["seg"]), used), "cell_terms")
    rows = segments.agg(F.coalesce(F.sum(_add(F.col("fold_r")) + _add(F.col("fold_s"))), F.lit(0))).first()[0]
    by_cell = cell.select(*GRAIN, (_add(F.col("at_r")) + _add(F.col("at_s"))).alias("n"))
    joined = lookup(long, model, GRAIN, found=hot_of(by_cell, GRAIN, "n", rows * len(names)))
    asked = F.col("feature").isin(used) & part.isin("test", "synth")
    score = F.sum(F.when(F.col("feature").isin(attacked), F.element_at("odds", F.col("fold") + 1))).alias("score")
    if k <= CLASSES_WIDE:
        sums = [F.sum(F.when(asked, F.get(c, F.lit(j)))).alias(f"{c}{j}") for c in SIDES for j in range(k)]
    else:
        sums = [F.collect_list(F.when(asked, F.col(c))).alias(c) for c in SIDES]
    return joined.groupBy("seg", "row", "is_real", "label", "part").agg(score, *sums)


def _counted(cells: DataFrame, segments: DataFrame, features: int, folds: int, k: int) -> DataFrame:
    """(seg, feature, cell, text, at_r, at_s by fold, own_train, own_synth by class, whole): rows of every cell, added up at once."""
    part, side = F.col("part"), F.when(F.col("is_real"), F.lit(1).cast("bigint")).otherwise(F.lit(UPPER))
    share = F.when(part == "train", F.lit(1).cast("bigint")).when(part == "synth", F.lit(UPPER))
    place = F.array_position("labels", F.col("label"))
    rows = cells.join(segments.select("seg", "labels"), "seg").select("*", place.alias("place"), side.alias("side"), share.alias("share"))
    tests = {f"f{f}": F.when(F.col("fold") == f, F.col("side")) for f in range(folds)} | {f"k{j}": F.when(F.col("place") == j + 1, F.col("share")) for j in range(k)}
    tests["whole"] = (part != "none").cast("bigint")
    added = [F.coalesce(c, F.lit(0)).alias(n) for n, c in tests.items()]
    names = [f"c{i}" for i in range(features)]
    texts = {f.name for f in cells.schema if f.name in names and f.dataType.typeName() == "string"}
    entry = [F.struct(F.lit(i).alias("feature"), (F.lit(None).cast("int") if c in texts else F.col(c)).alias("cell"), (F.col(c) if c in texts else F.lit(None).cast("string")).alias("text")) for i, c in enumerate(names)]
    long = rows.select("seg", *added, *names).select("seg", *tests, F.inline(F.array(*entry)))
    sums = long.groupBy("seg", "feature", "cell", "text").agg(*[F.sum(n).alias(n) for n in tests])
    low, high = (lambda n: F.col(n).bitwiseAND(UPPER - 1)), (lambda n: F.shiftright(n, 32))
    array = lambda f, names: F.array(*[f(n) for n in names]) if names else F.array().cast("array<bigint>")
    by_fold, by_class = [f"f{f}" for f in range(folds)], [f"k{j}" for j in range(k)]
    return sums.select(
        "seg", "feature", "cell", "text", array(low, by_fold).alias("at_r"), array(high, by_fold).alias("at_s"),
        array(low, by_class).alias("own_train"), array(high, by_class).alias("own_synth"), "whole",
    )


def _model_whole(cells: DataFrame, segments: DataFrame, names: list[str], used: list[int], folds: int, k: int | None = None) -> DataFrame:
    """The terms of all cells where a segment's rows lie in one partition. Without ``k``, or with very many classes, by lists of classes."""
    part, fold = F.col("part"), F.col("fold")
    if k is not None and k <= CLASSES_WIDE:
        cell = _counted(cells, segments, len(names), folds, k)
    else:
        ends = [(f"{side}{f}", (F.col("is_real") if side == "r" else ~F.col("is_real")) & (fold == f)) for side in "rs" for f in range(folds)]
        tests = [*ends, *[(p, part == p) for p in ("train", "synth")], ("whole", part != "none")]
        counts = _long(cells, len(names), "is_real", "fold", "label", "part").groupBy(*GRAIN, "label").agg(*[F.count_if(t).alias(n) for n, t in tests])
        cell = counts.groupBy(*GRAIN).agg(
            *[F.array(*[F.sum(f"{side}{f}") for f in range(folds)]).alias(f"at_{side}") for side in "rs"], F.sum("whole").alias("whole"),
            F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", F.struct("train", "synth"))))).alias("found"),
        )
        # Cells of numbers and of texts side by side, as above.
        d = [i for i in range(len(names)) if cells.schema[f"c{i}"].dataType.typeName() != "string"]
        number = F.col("feature").isin(d)
        cell = cell.withColumn("text", F.when(~number, F.col("cell"))).withColumn("cell", F.when(number, F.col("cell")).cast("int"))
    column = Window.partitionBy("seg", "feature")
    sizes = [F.count(F.lit(1)).over(column).cast("double").alias("size"), F.count_if(F.col("whole") > 0).over(column).cast("double").alias("size_whole")]
    return _terms(cell.select("*", *sizes).join(segments, "seg"), used)


def _lists(model: DataFrame, k: int) -> tuple[list[int], DataFrame]:
    """(columns with few cells in every segment; one row for each of them and its segment: cells, their terms one after the other)."""
    few = model.groupBy("feature").agg(F.max("size").alias("size")).where(F.col("size") <= CELLS_WIDE).collect() if k <= CLASSES_WIDE else []  # a row a column
    few = sorted(r["feature"] for r in few)
    found = model.where(F.col("feature").isin(few)).groupBy("seg", "feature").agg(F.collect_list(F.struct("cell", "text", "odds", *SIDES)).alias("m"))
    sizes = [F.size(F.col(f"m.{c}")[0]).alias(n) for c, n in (("by_real", "classes"), ("odds", "folds"))]
    return few, found.select("seg", "feature", *sizes, F.col("m.cell").alias("cell"), F.col("m.text").alias("text"), *[F.flatten(F.col(f"m.{c}")).alias(f"_{c}") for c in ("odds", *SIDES)])


def _scored_whole(
    cells: DataFrame, model: DataFrame, names: list[str], used: list[int], attacked: list[int], k: int, listed: tuple[list[int], DataFrame] | None = None
) -> DataFrame:
    """As ``_scored_spread``, by a hash join within the partition for each column, its terms added up at once. Of columns with few cells
    (``listed``) all terms of a segment are one row, so the join is by segment alone."""
    asked = F.col("part").isin("test", "synth")
    sums: dict[str, Column] = {}

    def plus(name: str, value: Column) -> None:
        sums[name] = sums[name] + value if name in sums else value

    number = lambda i: cells.schema[f"c{i}"].dataType.typeName() != "string"
    few, lists = listed or _lists(model, k)
    keep, scored = ["seg", "is_real", "fold", "label", "part"], cells
    # Where a segment has fewer classes than others, what stands behind its own is none of a row's terms.
    told = lambda j: asked & (F.col("classes") > j)
    for i in few:
        place = F.array_position("cell" if number(i) else "text", F.col(f"c{i}")).cast("int") - 1
        rest = [f"c{j}" for j in range(len(names)) if j not in few or j > i]
        terms = lists.where(F.col("feature") == i).drop("feature").hint("shuffle_hash")
        scored = scored.join(terms, "seg").select(*keep, *rest, *sums, "classes", "folds", *[f"_{c}" for c in ("odds", *SIDES)], place.alias("place"))
        if i in attacked:
            plus("score", F.get("_odds", F.col("place") * F.col("folds") + F.col("fold")))
        if i in used:
            for c in SIDES:
                for j in range(k):
                    plus(f"{c}{j}", F.when(told(j), F.get(f"_{c}", F.col("place") * F.col("classes") + F.lit(j))))
        scored = scored.select(*keep, *rest, *[v.alias(n) for n, v in sums.items()])
        sums = {n: F.col(n) for n in sums}
    for i in [i for i in range(len(names)) if i not in few]:
        own = model.where(F.col("feature") == i).select("seg", F.col("cell" if number(i) else "text").alias(f"c{i}"), "odds", *[F.col(c).alias(f"_{c}") for c in SIDES])
        scored = scored.join(own.hint("shuffle_hash"), ["seg", f"c{i}"])
        if i in attacked:
            plus("score", F.element_at("odds", F.col("fold") + 1))
        if i in used and k <= CLASSES_WIDE:
            for c in SIDES:
                for j in range(k):
                    plus(f"{c}{j}", F.when(asked, F.get(f"_{c}", F.lit(j))))
        elif i in used:
            for c in SIDES:
                value = F.when(asked, F.col(f"_{c}"))
                sums[c] = F.zip_with(c, value, lambda p, q: p + q) if c in sums else value
        rest = [f"c{j}" for j in range(i + 1, len(names)) if j not in few]
        scored = scored.select(*keep, *rest, *[v.alias(n) for n, v in sums.items()])
        sums = {n: F.col(n) for n in sums}
    empty = {"score": F.lit(None).cast("double")}
    if k <= CLASSES_WIDE:
        empty |= {f"{c}{j}": F.lit(None).cast("double") for c in SIDES for j in range(k)}
        return scored.select("seg", "is_real", "label", "part", *[sums.get(n, v).alias(n) for n, v in empty.items()])
    lists = [(F.array(F.col(c)) if c in sums else F.array().cast("array<array<double>>")).alias(c) for c in SIDES]
    return scored.select("seg", "is_real", "label", "part", sums.get("score", empty["score"]).alias("score"), *lists)


def _hits(scored: DataFrame, k: int) -> DataFrame:
    """(seg, is_real, part, label, by_real, by_synth, n, told): rows by guessed classes and the attack's hits among them."""

    def best(c: str) -> Column:
        if k <= CLASSES_WIDE:
            return _first_best([f"{c}{j}" for j in range(k)])
        return _best(F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.get(c, F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))

    # Rounding takes no sign away from a score of more than one place.
    score = F.when(F.abs("score") > F.lit(10.0**-PLACES), F.col("score")).otherwise(F.round("score", PLACES))
    hits = scored.select(
        "seg", "is_real", "part", "label",
        F.when(score == 0, 0.5).when((score > 0) == F.col("is_real"), 1.0).when(score.isNotNull(), 0.0).alias("told"),
        best("by_real").alias("by_real"),
        best("by_synth").alias("by_synth"),
    )
    return hits.groupBy("seg", "is_real", "part", "label", "by_real", "by_synth").agg(F.count(F.lit(1)).alias("n"), F.sum("told").alias("told"))


def _rates(placed: DataFrame, segments: DataFrame, used: list[int]) -> DataFrame:
    """(seg, utility values, mia_risk_score) from hits beside their segment's classes."""
    own = F.when(F.col("classes").isNotNull(), F.array_position(F.transform("classes", lambda c: c["label"]), F.col("label")).cast("int"))
    placed = placed.select("seg", "is_real", "part", "n", "told", (F.col("by_real") == own).alias("hit_real"), (F.col("by_synth") == own).alias("hit_synth"))
    mean = lambda p, hit: F.try_divide(_sum_if((F.col("part") == p) & F.col(hit), F.col("n")).cast("double"), _sum_if(F.col("part") == p, F.col("n")).cast("double"))
    side = lambda real: F.try_divide(F.sum(F.when(F.col("is_real") == F.lit(real), F.col("told"))), _sum_if(F.col("is_real") == F.lit(real), F.col("n")).cast("double"))
    found = placed.groupBy("seg").agg(
        mean("test", "hit_real").alias("baseline_accuracy"), mean("test", "hit_synth").alias("tstr_accuracy"), mean("synth", "hit_real").alias("trts_accuracy"),
        ((side(True) + side(False)) / F.lit(2.0)).alias("told"),
    )
    out = segments.join(found, "seg")
    usable = (F.size("classes") >= 2) & (F.least(F.col("n_train") + F.col("n_test"), F.col("n_synth")) >= C.UTILITY_MIN_ROWS) & (F.col("n_train") > 0) & (F.col("n_test") > 0)
    usable = usable & F.lit(bool(used))
    seen = F.least(_add(F.col("fold_r")), _add(F.col("fold_s"))) * 2 >= C.ATTACK_MIN_ROWS
    drop = F.greatest(F.lit(0.0), F.col("baseline_accuracy") - F.col("tstr_accuracy")) * F.lit(100.0)
    return out.select("seg", *[F.when(usable, F.col(c)).alias(c) for c in UTILITY[:3]], F.when(usable, drop).alias("performance_drop"), F.when(seen, F.col("told")).alias("mia_risk_score"))


def _classes(segments: DataFrame) -> int:
    return max(segments.agg(F.max(F.size("classes"))).first()[0] or 0, 0)


def _classifiers(rows: DataFrame, names: list[str], d: int, target: str | None, folds: int, whole: bool) -> DataFrame:
    """(seg, utility values, mia_risk_score): ``bayes.utility`` and ``bayes.attack`` with the segment as a further key; stored."""
    used = [i for i, c in enumerate(names) if c != target]
    attacked = [i for i, c in enumerate(names) if not attack_id_name(c)]
    cells = _cells(rows, names, d, target)
    if not whole:
        cells = stored(cells.withColumn("row", F.monotonically_increasing_id()), "cells")
        segments = _segment_totals(cells, folds)
        k = _classes(segments)
        # Hits are added up by label, where a class's place among its segment's classes is one small join.
        hits = stored(_hits(_scored_spread(cells, segments, names, used, attacked, folds, k), k), "hits")
        return stored(_rates(lookup(hits, segments, ["seg"]), segments, used), "rates")
    segments = _segment_totals(cells, folds)
    k = _classes(segments)
    model = _model_whole(cells, segments, names, used, folds, k).persist(StorageLevel.DISK_ONLY)
    few, lists = _lists(model, k)
    lists = lists.persist(StorageLevel.DISK_ONLY)
    hits = _hits(_scored_whole(cells, model, names, used, attacked, k, (few, lists)), k)
    out = stored(_rates(hits.join(segments, "seg"), segments, used), "rates")
    lists.unpersist()
    model.unpersist()
    return out


def _measured(rows: DataFrame, numbers: list[str], texts: list[str], target: str | None, quasi: list[str], features: int, folds: int, seed: int, parts: int | None) -> DataFrame:
    """All values by segment. With ``parts``, rows are dealt to so many partitions by segment, and stay there."""
    d, t, whole = len(numbers), len(texts), parts is not None
    if whole:
        rows = rows.repartition(parts, "seg").sortWithinPartitions("seg").persist(StorageLevel.DISK_ONLY)
    else:
        rows = stored(rows, "segment_rows")
    n, *filled = rows.agg(F.count(F.lit(1)), *[F.count(f"x{i}") for i in range(d)]).first()
    moments = stored(_moments(rows, d, frozenset(i for i, here in enumerate(filled) if here < n)), "moments")
    wide = rows
    if d:
        known = moments.select("seg", "lo", "hi", "mean", "sd")
        sizes = moments.select("seg", (F.col("n_real") + F.col("n_synth")).alias("n"))
        wide = rows.join(known, "seg") if whole else lookup(rows, known, ["seg"], found=hot_of(sizes, ["seg"], "n", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    values = _value_counts(rows, numbers, texts)
    found = [
        stored(_distances(_ranked_whole(values) if whole else _ranked_spread(values), numbers, texts), "distances"),
        stored(_copies(rows, d, t, [f"t{texts.index(c)}" for c in quasi]), "copies"),
        _classifiers(wide, [*numbers, *texts], d, target, folds, whole),
        stored(_mmd(wide, d, features, seed), "mmd") if d else moments.select("seg", F.lit(0.0).alias("mmd")),
    ]
    if whole:
        rows.unpersist()
    for f in found:
        moments = moments.join(f, "seg", "left")
    return moments


def scorecards(
    tagged: DataFrame, segment: str, target: str | None = None, row_id: Column | None = None, quasi: list[str] | None = None,
    features: int = 64, folds: int = C.ATTACK_FOLDS, seed: int = C.DEFAULT_SEED,
) -> DataFrame:
    """One row per value of the column ``segment``: it and the 12 measured values of ``scorecard.evaluate`` (``with_compliance`` adds
    the last), as if each segment were judged by itself with the classifiers of ``bayes``.

    ``tagged`` holds both sides of all segments and the flag ``is_real`` (null counts as synthetic). All its numbers and texts are
    measured; ``target`` names the class to predict, ``row_id`` is an expression that deals rows to folds and to the training share
    (the row's values without it) and ``quasi`` names text columns for k-anonymity (the first two texts). NaN and infinity count
    as null; classifiers cut numbers by the range of all rows of the segment. Rows without a segment belong to none. A segment
    without rows on one side has null in every column: nothing was measured. Without numbers MMD is 0, an empty table gives no rows."""
    rows, numbers, texts = _plain(tagged, segment, row_id, target, folds, seed)
    if not numbers and not texts:
        raise ValueError("no number and no text to measure")
    quasi = quasi_identifiers(tagged.select(*texts)) if quasi is None and texts else quasi or []
    spark, measure = tagged.sparkSession, lambda part, parts: _measured(part, numbers, texts, target, quasi, features, folds, seed, parts)
    sizes = stored(rows.groupBy("seg").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = [(r["seg"],) for r in sizes.where(F.col("n") > max(total / SHARE, WHOLE_ROWS)).collect()]
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / PART_ROWS))
    # Partitions by segment serve every key that holds the segment, in joins as well.
    # Counts are far below overflow, so their sums need no test for it; rows were read and cast before, by the session's own rule.
    dealt = setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")
    with dealt, setting(spark, "spark.sql.codegen.hugeMethodLimit", str(METHOD_BYTES)), setting(spark, "spark.sql.ansi.enabled", "false"):
        if large:
            these = F.broadcast(spark.createDataFrame(large, sizes.select("seg").schema))
            out = measure(rows.join(these, "seg", "left_anti"), parts).unionByName(measure(rows.join(these, "seg", "left_semi"), None))
        else:
            out = measure(rows, parts)
    both = (F.col("n_real") > 0) & (F.col("n_synth") > 0)
    names = ("wasserstein", "js_divergence", "correlation_similarity", "mmd", "kl_divergence", *UTILITY, "exact_matches", "mia_risk_score", "k_anonymity")
    return stored(out.select(F.col("seg").alias(segment), *[F.when(both, F.col(c)).alias(c) for c in names]), "scorecards")
