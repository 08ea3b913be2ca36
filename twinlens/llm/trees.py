"""Document quality by gradient-boosted trees over document statistics.

Training is by histograms: every statistic is cut into at most ``BINS`` bins at its
quantiles, and a node's best cut is read from sums of gradients by bin. The fitted
trees lie flat in arrays (feature, threshold, children, value), so scoring walks all
documents of a block down one level of a tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.texts import blocks, codes, column, ddl, letters, mapped, unused, words
from twinlens.session import settle

STATISTICS = (
    "log_chars", "log_words", "mean_word", "long_words", "letters", "upper", "digits", "spaces", "symbols", "stops", "commas",
    "bars", "marks", "hashes", "distinct_words", "top_word", "distinct_pairs", "repeated_pairs", "repeated_lines", "mean_line",
    "short_lines", "ended_lines", "accented", "longest_run",
)
SAMPLE_ROWS = 50_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
LEAST_HESSIAN = 2.0
RIDGE = 1.0


class Model(NamedTuple):
    feature: np.ndarray  #: of each node; -1 in a leaf
    threshold: np.ndarray  #: a document goes left if its statistic is at most this
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of ``STATISTICS`` per text; a null or empty text has noughts."""
    n = len(texts)
    cp, bounds = codes(texts)
    size = np.diff(bounds)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]).astype(float)

    chars = np.maximum(size, 1)
    is_letter = letters()[cp]
    ascii_upper = (cp >= 65) & (cp <= 90)
    upper = ascii_upper | (cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7)
    digit, space = (cp >= 48) & (cp <= 57), (cp == 32) | (cp >= 9) & (cp <= 13)
    symbol = ~(is_letter | digit | space)
    same = np.zeros(len(cp), bool)
    same[1:] = cp[1:] == cp[:-1]
    same[bounds[:-1][bounds[:-1] < len(cp)]] = False  # a run ends with its text
    edges = np.flatnonzero(~same) if len(cp) else np.zeros(0, np.int64)
    run = np.diff(np.append(edges, len(cp)))
    longest = np.zeros(n)
    np.maximum.at(longest, np.searchsorted(bounds, edges, side="right") - 1, run)

    w = words(texts)
    count = np.bincount(w.doc, minlength=n).astype(float)
    some = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)

    def repeats(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values, the commonest one's count and the rows whose value is not alone, by text."""
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(d)))
        top = np.zeros(n)
        np.maximum.at(top, d[at], times)
        return np.bincount(d[at], minlength=n), top, np.bincount(d[at], weights=np.where(times > 1, times, 0), minlength=n)

    kinds, top, _ = repeats(w.doc, w.hash)
    near = w.doc[1:] == w.doc[:-1]
    pair = (w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:])[near]
    pair_kinds, _, pair_again = repeats(w.doc[:-1][near], pair)
    pairs = np.maximum(np.bincount(w.doc[:-1][near], minlength=n), 1)

    line_doc, line_hash, line_len, line_end = [], [], [], []
    for k, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x.strip()]
        line_doc += [k] * len(lines)
        line_hash += [hash(x) for x in lines]  # compared within this call only
        line_len += [len(x) for x in lines]
        line_end += [x.rstrip()[-1] in ".!?:;\"'" for x in lines]
    line_doc, line_len = np.array(line_doc, np.int64), np.array(line_len, float)
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    _, _, line_again = repeats(line_doc, np.array(line_hash, np.int64))
    by_doc = lambda x: np.bincount(line_doc, weights=x, minlength=n) / lines
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), np.bincount(w.doc, weights=length, minlength=n) / some,
            np.bincount(w.doc, weights=length > 12, minlength=n) / some, total(is_letter) / chars, total(upper) / chars, total(digit) / chars,
            total(space) / chars, total(symbol) / chars, total(cp == 46) / some, total(cp == 44) / some, total(cp == 124) / some,
            total((cp == 33) | (cp == 63)) / some, total((cp == 35) | (cp == 36) | (cp == 37) | (cp == 38) | (cp == 42)) / some,
            kinds / some, top / some, pair_kinds / pairs, pair_again / pairs, line_again / lines, by_doc(line_len),
            by_doc(line_len < 20), by_doc(np.array(line_end, float)), total(is_letter & (cp > 127)) / chars, longest,
        ]
    )


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text", out: str = "statistics") -> DataFrame:
    """The ``keep`` columns and the text's statistics as an array."""
    return _mapped(docs, keep, text_col, f"{out} array<double>", lambda x: [_lists(x)], (out,))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def _mapped(docs: DataFrame, keep: list[str], text_col: str, extra: str, fn, names: tuple[str, ...]) -> DataFrame:
    text = unused([*keep, *names], "_text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], *fn(statistics(column(block, text)))], names=[*keep, *names])

    return mapped(rows, run, f"{ddl(docs.select(*keep))}, {extra}")


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_arrays(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Model:
    """Boosted trees for labels 0/1, by Newton steps on the logistic loss."""
    rows, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    offset = np.arange(width) * BINS
    start = float(np.log(np.clip(y.mean(), 1e-4, 1 - 1e-4) / np.clip(1 - y.mean(), 1e-4, 1 - 1e-4)))
    score = np.full(rows, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for column_of, empty in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            column_of.append(empty)
        return len(feature) - 1

    for _ in range(trees):
        p = _logistic(score)
        grad, hess = p - y, p * (1 - p)
        roots.append(node())
        at = np.full(rows, roots[-1])
        open_nodes = [roots[-1]]
        for level in range(depth + 1):
            index = np.full(len(feature), -1)
            index[open_nodes] = np.arange(len(open_nodes))
            live = np.flatnonzero(index[at] >= 0)
            own = index[at[live]]
            g = np.bincount(own, weights=grad[live], minlength=len(open_nodes))
            h = np.bincount(own, weights=hess[live], minlength=len(open_nodes))
            for k, nd in enumerate(open_nodes):
                value[nd] = -rate * g[k] / (h[k] + RIDGE)
            if level == depth:
                break
            cell = (own[:, None] * width * BINS + offset + binned[live]).ravel()
            size = len(open_nodes) * width * BINS
            gs = np.bincount(cell, weights=np.repeat(grad[live], width), minlength=size).reshape(-1, width, BINS).cumsum(2)
            hs = np.bincount(cell, weights=np.repeat(hess[live], width), minlength=size).reshape(-1, width, BINS).cumsum(2)
            gr, hr = g[:, None, None] - gs, h[:, None, None] - hs
            gain = gs**2 / (hs + RIDGE) + gr**2 / (hr + RIDGE) - (g**2 / (h + RIDGE))[:, None, None]
            gain[(hs < LEAST_HESSIAN) | (hr < LEAST_HESSIAN)] = -1
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = -1
            flat = gain.reshape(len(open_nodes), -1)
            best = flat.argmax(1)
            further = []
            for k, nd in enumerate(open_nodes):
                if flat[k, best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), BINS)
                    feature[nd], threshold[nd] = f, float(cuts[f][b])
                    left[nd], right[nd] = node(), node()
                    further += [left[nd], right[nd]]
            if not further:
                break
            fa, la, ra = np.array(feature), np.array(left), np.array(right)
            split = live[fa[at[live]] >= 0]
            nd = at[split]
            go_left = x[split, fa[nd]] <= np.array(threshold)[nd]
            at[split] = np.where(go_left, la[nd], ra[nd])
            open_nodes = further
        score += np.array(value)[at]
    return Model(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), start)


def score_arrays(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of label 1: every tree is walked by all rows at once, level by level."""
    total = np.full(len(x), model.start)
    row = np.arange(len(x))
    for root in model.roots:
        at = np.full(len(x), root)
        while True:
            f = model.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[row, np.maximum(f, 0)] <= model.threshold[at]
            at = np.where(inner, np.where(go_left, model.left[at], model.right[at]), at)
        total += model.value[at]
    return _logistic(total)


def fit(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """``fit_rows`` on the statistics of the labelled texts."""
    rows = with_statistics(labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text")), ["id", "label"])
    return fit_rows(rows, "id", "label", sample_rows=sample_rows)


def fit_rows(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "quality", statistics_col: str = "statistics", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample_rows`` labelled rows at most, drawn by the digest of id
    and statistics. Rows with a null label teach nothing; without a row the score is 0.5."""
    share = F.pmod(F.xxhash64(id_col, statistics_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = settle(labelled.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("int").alias("label"), F.col(statistics_col).alias("x"), share.alias("share")))
    n = known.count()
    got = known.where(F.col("share") < sample_rows / max(n, 1)).select("label", "x").toPandas()
    if got.empty:
        none = np.zeros(0, np.int64)
        return Model(none, np.zeros(0), none, none, np.zeros(0), none, 0.0)
    return fit_arrays(np.stack(got["x"].to_numpy()), (got["label"] > 0).to_numpy(float))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The ``keep`` columns and the probability of label 1, a row per row of ``docs``.
    A null or empty text is scored by its statistics, all nought."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs, keep, text_col, f"{out} double", lambda x: [pa.array(score_arrays(shipped.value, x), pa.float64())], (out,))


def predict_rows(rows: DataFrame, model: Model, keep: list[str], statistics_col: str = "statistics", out: str = "score") -> DataFrame:
    """As ``predict``, from rows of ``with_statistics``."""
    x = unused([*keep, out], "_x")
    own = rows.select(*keep, F.col(statistics_col).alias(x))
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(x).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score_arrays(shipped.value, values), pa.float64())], names=[*keep, out])

    return mapped(own, run, f"{ddl(rows.select(*keep))}, {out} double")
