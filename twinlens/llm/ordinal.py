"""Severity grades by cumulative-link (proportional odds) regression.

P(grade <= k) = logistic(threshold[k] - w . x) with one weight vector for all
thresholds. Features are the presence of words and of word beginnings; those that
go with the grades are selected from counts over all labelled rows, then the
weights are fitted on a bounded sample of labelled rows. The prediction is the
expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.texts import as_batch, blocks, column, ddl, mapped, mixed, unused, words
from twinlens.session import fresh_path, settle

#: Word beginnings of so many characters are features beside whole words.
BEGINNING = 5
SAMPLE_ROWS = 20_000
FEATURES = 4_096
LEAST_DOCS = 5
RIDGE = 1e-3
STEPS = 400
#: Features that a task gathers before it hands their counts on.
GATHERED = 1 << 19
#: Bits of the map of labelled ids.
FILTER_BITS = 1 << 24


class Model(NamedTuple):
    keys: np.ndarray  #: sorted 64-bit feature hashes
    weights: np.ndarray
    thresholds: np.ndarray  #: ascending, one fewer than grades


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit feature) of every word and of every beginning of a longer word."""
    w = words(texts)
    longer = w.end - w.start > BEGINNING
    start = w.start[longer]
    begin = mixed(w.rolling.spans(start, start + BEGINNING) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.concatenate([w.doc, w.doc[longer]]), np.concatenate([w.hash, begin])


def _present(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, feature) once."""
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    return doc[new], feature[new]


def _added(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with the sums of both counts."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    total = lambda n: np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    return keys[new], total(low), total(high)


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` joined with ``labels`` on the id, written as a table once, so that the
    passes over it shuffle no text again. Texts whose id has no label stay where
    they are: a bitmap of ``FILTER_BITS`` bits tells most of them (any number of
    labels fits; more labels let more texts travel, the join drops those). A document with
    several label rows stands there once for each; a null id meets no label."""
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(FILTER_BITS))
    cells = labels.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 32 AS INT))")).alias("bits"))
    found = cells.toPandas()  # FILTER_BITS / 32 rows at most
    mask = np.zeros(FILTER_BITS // 32, np.uint32)
    mask[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    shipped = docs.sparkSession.sparkContext.broadcast(mask)

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((shipped.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    path = fresh_path(docs.sparkSession, "labelled")
    # a merge join at every size, so that small inputs run as large ones do
    docs.where(known(place)).join(labels.hint("merge"), id_col).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def counted(labelled: DataFrame, grade_col: str = "grade", text_col: str = "text") -> DataFrame:
    """(feature, r, rising): how much the presence of each feature differs between grade 0
    and the grades above it (r, a likelihood ratio), from document
    counts over all labelled rows, and whether the grades above 0 hold it more often."""
    rows = labelled.where(F.col(grade_col).isNotNull()).select(F.col(grade_col).cast("int").alias("grade"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("feature", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # each feature once, with its documents of grade 0 and above
        for block in blocks(batches, "text"):
            high = np.array(column(block, "grade")) > 0
            doc, feature = _present(*features(column(block, "text")))
            kept.append(_added(feature, ~high[doc], high[doc]))
            if sum(len(k) for k, _, _ in kept) > GATHERED:
                kept = [_added(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
                if len(kept[0][0]) > GATHERED // 2:
                    yield as_batch(schema, kept[0][0].view(np.int64), *kept[0][1:])
                    kept = []
        if kept:
            keys, low, high = _added(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            yield as_batch(schema, keys.view(np.int64), low, high)

    n = rows.agg(F.coalesce(F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)), F.lit(0)).alias("high"), F.count(F.lit(1)).alias("all")).first()
    n_high, n_low = float(n["high"]), float(n["all"] - n["high"])
    sums = mapped(rows, count_blocks, "feature long, low long, high long").groupBy("feature").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    sums = sums.where(F.col("low") + F.col("high") >= LEAST_DOCS)
    a, b = F.col("high") + F.lit(0.5), F.col("low") + F.lit(0.5)
    expected = (a + b) * F.lit((n_high + 1) / (n_high + n_low + 2))
    ratio = 2 * (a * F.log(a / expected) + b * F.log(b / (a + b - expected)))
    return settle(sums.select("feature", ratio.alias("r"), (a > expected).alias("rising")))


def top(counts: DataFrame, count: int = FEATURES, rising: bool = False) -> np.ndarray:
    """The ``count`` features of the greatest r, with ``rising`` only rising ones. Ties go to the smaller hash."""
    own = counts.where("rising") if rising else counts
    best = own.select("feature", "r").orderBy(F.desc("r"), "feature").limit(count)
    return np.sort(np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64))


def select(labelled: DataFrame, grade_col: str = "grade", text_col: str = "text", count: int = FEATURES, rising: bool = False) -> np.ndarray:
    """``top`` of the features that all labelled rows hold."""
    return top(counted(labelled, grade_col, text_col), count, rising)


def _hits(texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in keys) of the selected features that each text holds, once each."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, feature = features(texts)
    at = np.minimum(np.searchsorted(keys, feature), len(keys) - 1)
    hit = keys[at] == feature
    pairs = np.unique(doc[hit] * len(keys) + at[hit])
    return pairs // len(keys), pairs % len(keys)


def with_hits(docs: DataFrame, keys: np.ndarray, keep: list[str], text_col: str = "text", out: str = "hits") -> DataFrame:
    """The ``keep`` columns and, as an array, the places in ``keys`` of the features that the text holds."""
    text = unused([*keep, out], "_text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = f"{ddl(docs.select(*keep))}, {out} array<int>"
    shipped = docs.sparkSession.sparkContext.broadcast(keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            doc, at = _hits(column(block, text), shipped.value)
            ends = np.searchsorted(doc, np.arange(block.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], lists], names=[*keep, out])

    return mapped(rows, find, schema)


def fit_arrays(hits: list, grades: np.ndarray, width: int, steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by accelerated gradient ascent of the penalised log-likelihood."""
    levels = int(grades.max()) + 1
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.concatenate([np.asarray(h, np.int64) for h in hits]) if len(row) else np.zeros(0, np.int64)
    share = np.clip(np.array([(grades <= k).mean() for k in range(levels - 1)]), 1e-4, 1 - 1e-4)
    w, theta = np.zeros(width), np.log(share / (1 - share))
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    n = len(grades)
    seen = np.maximum(np.bincount(col, minlength=width), 1)
    rate_w = 4.0 * n / (seen + 50.0)  # rarer features take larger steps
    vw, vt = np.zeros(width), np.zeros(levels - 1)
    for _ in range(steps):
        aw, at = w + 0.8 * vw, theta + 0.8 * vt
        eta = np.bincount(row, weights=aw[col], minlength=n)
        low = np.concatenate([[-np.inf], at])[grades]
        high = np.concatenate([at, [np.inf]])[grades]
        f_high = np.where(np.isinf(high), 1.0, logistic(high - eta))
        f_low = np.where(np.isinf(low), 0.0, logistic(low - eta))
        p = np.maximum(f_high - f_low, 1e-9)
        d_high, d_low = f_high * (1 - f_high) / p, f_low * (1 - f_low) / p
        slope = d_low - d_high  # of the log-likelihood in eta
        gw = np.bincount(col, weights=slope[row], minlength=width) / n - ridge * aw
        gt = np.array([d_high[grades == k].sum() - d_low[grades == k + 1].sum() for k in range(levels - 1)]) / n
        vw = 0.8 * vw + np.clip(0.1 * rate_w * gw, -0.1, 0.1)
        vt = 0.8 * vt + np.clip(0.5 * gt, -0.1, 0.1)
        w, theta = w + vw, np.maximum.accumulate(theta + vt)
    return w, theta


def fit(labelled: DataFrame, id_col: str = "doc_id", grade_col: str = "grade", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, keys: np.ndarray | None = None) -> Model:
    """Fit on about ``sample_rows`` labelled rows at most, drawn by the digest of
    id and text; features are chosen from all labelled rows. Rows with a null grade
    teach nothing; without a labelled row of a grade above 0 the model predicts 0."""
    keys = select(labelled, grade_col, text_col) if keys is None else keys
    known = labelled.where(F.col(grade_col).isNotNull())
    n = known.count()
    if n > sample_rows:
        share = F.pmod(F.xxhash64(id_col, F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        known = known.where(share < sample_rows / n)
    got = with_hits(known.select(F.col(grade_col).cast("int").alias("grade"), F.col(text_col).alias("text")), keys, ["grade"]).toPandas()
    grades = got["grade"].to_numpy(np.int64)
    if not len(grades) or grades.max() < 1 or not len(keys):
        return Model(keys[:0], np.zeros(0), np.full(1, 40.0))
    return Model(keys, *fit_arrays(list(got["hits"]), grades, len(keys)))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: str = "severity") -> DataFrame:
    """The ``keep`` columns and the expected grade: the sum over thresholds of
    P(grade > k). A null or empty text has no feature and gets the model's
    expectation for such a text. A row per row of ``docs``. A kept column called ``out``
    stays; the new one then gets an underscore in front."""
    out = unused(keep, out)
    text = unused([*keep, out], "_text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text))
    schema = f"{ddl(docs.select(*keep))}, {out} double"
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for block in blocks(batches, text):
            doc, at = _hits(column(block, text), m.keys)
            eta = np.bincount(doc, weights=m.weights[at], minlength=block.num_rows) if len(at) else np.zeros(block.num_rows)
            expected = (1 / (1 + np.exp(np.clip(m.thresholds[None, :] - eta[:, None], -40, 40)))).sum(1)
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], pa.array(expected, pa.float64())], names=[*keep, out])

    return mapped(rows, score, schema)


def silver_grades(labelled: DataFrame, keys: np.ndarray, flag_col: str = "toxic", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Grades from a yes/no label: 0 for no; 1 for yes; 2 for yes with more of the
    label's own features (``keys``, as ``select`` finds them with ``rising``) than half of the yes rows have."""
    flag, hits = unused([*keep, "text"], "_flag"), unused([*keep, "text"], "_hits")
    own = with_hits(labelled.select(*keep, F.col(flag_col).alias(flag), F.col(text_col).alias("text")), keys, [*keep, flag, "text"], out=hits)
    n = F.size(hits)
    middle = own.where(F.col(flag) > 0).agg(F.percentile_approx(n, 0.5).alias("m")).first()["m"] or 0
    return own.select(*keep, "text", F.when(F.col(flag).isNull(), None).when(F.col(flag) <= 0, 0).when(n <= middle, 1).otherwise(2).alias("grade"))
