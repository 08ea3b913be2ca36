"""Language proportions of each document by expectation-maximisation.

A document is a bag of character trigrams. Each learned language gives every
trigram a probability; a document is taken as a mixture of languages whose
proportions maximise its likelihood. The set of languages is chosen by penalised
likelihood: a language stays only if it raises the log-likelihood by more than
``PENALTY * log(trigrams + 1)``.

Trigrams are hashed to ``2 ** BITS`` cells, so a model has that many numbers per
language whatever the corpus holds. Counts cover all rows given to ``learn``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.texts import as_batch, blocks, codes, column, ddl, letters, mapped, mixed, unused

BITS = 16
CELLS = 1 << BITS
PENALTY = 3.0
SMOOTHING = 0.5
ROUNDS = 30
CLOSE = 1e-3
#: Counts of so many languages stay in a task's memory before they are sent on.
HELD = 64
UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    probability: np.ndarray  #: a row per cell, a column per language


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell) of every trigram, and whether a text has a letter. All that is
    no letter is a space; a trigram never spans two texts and has a letter in the middle,
    so every text with a letter has at least one."""
    cp, bounds = codes([f" {t.lower()} " if t else "" for t in texts])
    is_letter = letters()[cp]
    folded = np.where(is_letter, cp, 32).astype(np.uint64)
    total = np.concatenate([[0], np.cumsum(is_letter)])
    has = total[bounds[1:]] > total[bounds[:-1]]
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at = np.flatnonzero(is_letter[1:-1] & (doc[:-2] == doc[2:]))
    key = folded[at] << np.uint64(42) | folded[at + 1] << np.uint64(21) | folded[at + 2]
    return doc[at], (mixed(key) >> np.uint64(64 - BITS)).astype(np.int64), has


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Count trigrams of all rows by language. Rows with a null language or text
    teach nothing. The driver gets at most ``2 ** BITS`` sums per language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                cells = np.flatnonzero(n)
                yield as_batch(schema, [name] * len(cells), cells, n[cells])
            held.clear()

        for block in blocks(batches, "text"):
            langs = column(block, "lang")
            doc, cell, _ = trigrams(column(block, "text"))
            names = sorted(set(langs))
            which = np.searchsorted(names, langs) if names else np.zeros(0, np.int64)
            for k, name in enumerate(names):
                n = np.bincount(cell[which[doc] == k], minlength=CELLS)
                if name in held:
                    held[name] += n
                else:
                    held[name] = n
            if len(held) > HELD:
                yield from sent()
        yield from sent()

    sums = mapped(rows, count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    n = np.zeros((CELLS, len(languages)))
    n[sums["cell"].to_numpy(np.int64), np.searchsorted(languages, sums["lang"].to_numpy(str)) if len(sums) else []] = sums["n"]
    return Model(languages, (n + SMOOTHING) / (n.sum(0) + SMOOTHING * CELLS))


def _starts(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Converged proportions and log-likelihoods of documents whose (trigram) rows
    follow one another from ``starts``. A share of nought stays nought. Documents
    that have converged leave the rounds."""
    length = np.diff(np.append(starts, len(p)))
    total = np.add.reduceat(n, starts)
    share, like = share.copy(), np.zeros(len(starts))
    active = np.arange(len(starts))
    doc = np.repeat(np.arange(len(starts)), length)
    own_p, own_n, own_starts = p, n, starts
    for k in range(ROUNDS):
        part = own_p * share[active][doc]
        mix = part.sum(1)
        new = np.add.reduceat(part * (own_n / mix)[:, None], own_starts) / total[active][:, None]
        moved = np.abs(new - share[active]).max(1)
        share[active] = new
        done = moved < CLOSE if k < ROUNDS - 1 else np.ones(len(active), bool)
        if done.all() or done.mean() > 0.3:
            like[active] = np.add.reduceat(own_n * np.log(np.maximum((own_p * new[doc]).sum(1), 1e-300)), own_starts)
            if done.all():
                break
            keep = ~done
            rows = keep[doc]
            active = active[keep]
            own_p, own_n = own_p[rows], own_n[rows]
            doc = np.repeat(np.arange(len(active)), length[active])
            own_starts = np.concatenate([[0], np.cumsum(length[active])[:-1]])
    return share, like


def mixtures(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (a row per text; all nought without a trigram) and whether each text has a letter."""
    doc, cell, has = trigrams(texts)
    share = np.zeros((len(texts), len(model.languages)))
    if not len(doc) or not model.languages:
        return share, has
    key, n = np.unique(doc * CELLS + cell, return_counts=True)
    doc, p = key >> BITS, model.probability[key & (CELLS - 1)]
    starts = _starts(doc)
    which, total = doc[starts], np.add.reduceat(n, starts)
    single = np.add.reduceat(n[:, None] * np.log(p), starts)
    best = single.argmax(1)
    own = np.repeat(np.arange(len(which)), np.diff(np.append(starts, len(doc))))
    # No mixture can beat the best language alone by more than this, as log is concave.
    gain = np.add.reduceat(n[:, None] * p / p[np.arange(len(p)), best[own]][:, None], starts).max(1) / total
    cost = PENALTY * np.log(total + 1)
    share[which, best] = 1
    left = total * np.log(np.maximum(gain, 1)) > cost
    if left.any():
        rows = left[own]
        ids = np.flatnonzero(left)
        length = np.diff(np.append(starts, len(doc)))[ids]
        share[which[ids]] = _chosen(p[rows], n[rows], np.concatenate([[0], np.cumsum(length)[:-1]]), length, cost[ids], single[ids])
    return share, has


def _chosen(p: np.ndarray, n: np.ndarray, starts: np.ndarray, length: np.ndarray, cost: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Backward elimination: drop the language with the least share while the
    likelihood falls by no more than the penalty of one language."""
    docs, langs = len(starts), p.shape[1]
    best, at = np.zeros((docs, langs)), np.arange(docs)
    best[at, single.argmax(1)] = 1
    share, like = _em(p, n, starts, np.full((docs, langs), 1 / langs))
    while len(at):
        share[share < 1e-6] = 0
        share /= share.sum(1, keepdims=True)
        several = (share > 0).sum(1) > 1
        # as good as the best single language: that one it is, and all in between were tested on the way down
        alone = like - single[at].max(1) <= cost[at]
        best[at[~several]] = share[~several]
        go = several & ~alone
        rows = np.repeat(go, length[at])
        at, share, like = at[go], share[go], like[go]
        p, n = p[rows], n[rows]
        if not len(at):
            break
        starts = np.concatenate([[0], np.cumsum(length[at])[:-1]])
        best[at] = share
        fewer = share.copy()
        fewer[np.arange(len(at)), np.where(share > 0, share, np.inf).argmin(1)] = 0
        fewer /= fewer.sum(1, keepdims=True)
        tried, reached = _em(p, n, starts, fewer)
        good = like - reached <= cost[at]
        rows = np.repeat(good, length[at])
        at, share, like = at[good], tried[good], reached[good]
        p, n = p[rows], n[rows]
        starts = np.concatenate([[0], np.cumsum(length[at])[:-1]]).astype(np.int64)
    return best


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of ``docs``: its id, the ``keep`` columns, lang_pred, score (share
    of that language, 0 to 1), and languages with their shares in falling order.
    A null text and one without a letter are ``und`` with score 0; so is everything if
    the model has learned no language. Ties go to the language that comes first by
    name. Other columns are not read. Kept columns called like a new one stay; the
    new one then gets an underscore in front."""
    names: list[str] = []
    for n in ("lang_pred", "score", "languages", "shares"):
        names.append(unused([id_col, *keep, *names], n))
    text = unused([id_col, *keep, *names], "_text")
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias(text))
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)
    extra = ", ".join(f"{n} {t}" for n, t in zip(names, ("string", "double", "array<string>", "array<double>"), strict=True))
    kept = [id_col, *keep]
    schema = f"{ddl(rows.drop(text))}, {extra}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for block in blocks(batches, text):
            share, has = mixtures(column(block, text), model)
            order = np.argsort(-share, axis=1, kind="stable")
            first, top, langs, shares = [], [], [], []
            for k in range(len(share)):
                found = [j for j in order[k] if share[k, j] > 0] if has[k] else []
                first.append(model.languages[found[0]] if found else UNDETERMINED)
                top.append(min(1.0, float(share[k, found[0]])) if found else 0.0)
                langs.append([model.languages[j] for j in found])
                shares.append([float(share[k, j]) for j in found])
            own = [block.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(first, pa.string()), pa.array(top, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=[*kept, *names],
            )

    return mapped(rows, score, schema)
