"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared where they share a seed, a run of
``MATCH`` words, found by rolling Karp-Rabin hashes. Matches are marked longest
first, each word of either side at most once, until none of ``MATCH`` words is left.
The marked share of the item is its coverage: passages that were put into another
order are covered just as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.texts import Rolling, blocks, column, ddl, mapped, ranges, unused, words

MATCH = 5
COVERAGE = 0.5
#: Pairs of equal seeds that are held at once.
PAIRS = 1 << 20
#: So many words of the benchmark go to the tasks at a time (16 bytes each).
BLOCK_WORDS = 2_000_000


class Items(NamedTuple):
    """A part of the benchmark as arrays."""

    name: list  #: item ids
    words: np.ndarray  #: hashes of all items' words
    bounds: np.ndarray
    seeds: np.ndarray  #: sorted distinct seed hashes
    first: np.ndarray  #: where each seed's places start in place
    place: np.ndarray  #: of the seeds, in words


def _seeds(hashes: np.ndarray, doc: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every run of ``match`` words within one text."""
    if len(hashes) < match:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[match - 1 :] == doc[: len(doc) - match + 1])
    return at, Rolling(hashes).spans(at, at + match)


def index(names: list, texts: list[str | None], match: int = MATCH) -> Items:
    w = words(texts)
    place, seed = _seeds(w.hash, w.doc, match)
    order = np.argsort(seed, kind="stable")
    keys, first = np.unique(seed[order], return_index=True)
    return Items(names, w.hash, np.searchsorted(w.doc, np.arange(len(texts) + 1)), keys, np.append(first, len(order)), place[order])


def runs_of(doc_at: np.ndarray, item_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the document, place in the item, seeds) of every run of shared seeds that follow each other in both."""
    order = np.lexsort((doc_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] - i[1:] != d[:-1] - i[:-1]) | (d[1:] != d[:-1] + 1)
    begin = np.flatnonzero(fresh)
    return d[begin], i[begin], np.diff(np.append(begin, len(d)))


def runs_by_slices(doc_at: np.ndarray, doc_seed: np.ndarray, item_at: np.ndarray, item_seed: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``runs_of`` of all pairs of equal seeds of one text and one item, whose pairs may be too many
    to hold: a run lies on one diagonal, so about ``limit`` pairs on neighbouring diagonals
    are looked at together and only their runs are kept."""
    limit = limit or PAIRS
    order = np.lexsort((doc_at, doc_seed))
    seed, place = doc_seed[order], doc_at[order]
    low, high = np.searchsorted(seed, item_seed), np.searchsorted(seed, item_seed, side="right")
    some = high > low
    low, high, own = low[some], high[some], item_at[some]
    if not len(own):
        return (np.zeros(0, np.int64),) * 3
    # places of one seed ascend, so those on the diagonals from a to b are a stretch of them
    group = np.searchsorted(seed, seed)
    span = int(doc_at.max() + item_at.max()) + 2
    line = group * span + place  # ascends as a whole
    base = group[low] * span
    at = lambda diagonal: np.clip(np.searchsorted(line, base + np.clip(own + diagonal, 0, span - 1)), low, high)
    first, last = int(doc_at.min() - own.max()), int(doc_at.max() - own.min()) + 1
    out, start, step = [], first, max(1, (last - first) * limit // max(1, int((high - low).sum())))
    while start < last:
        stop = min(last, start + step)
        a, b = at(start), at(stop)
        n = b - a
        if n.sum() > 2 * limit and stop - start > 1:
            step = max(1, step // 2)
            continue
        if n.any():
            out.append(runs_of(place[ranges(a, n)], np.repeat(own, n)))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def tiles(doc_at: np.ndarray, item_at: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles from the places of shared seeds."""
    return tiles_of_runs(*runs_of(doc_at, item_at), match)


def tiles_of_runs(d: np.ndarray, i: np.ndarray, seeds: np.ndarray, match: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, words) from runs of shared
    seeds. Longest first; ties go to the earlier place in the item, then in the document."""
    size = seeds + match - 1
    heap = [(-n, b, a) for n, a, b in zip(size.tolist(), d.tolist(), i.tolist(), strict=True)]
    heapq.heapify(heap)
    low_d, low_i = int(d.min()), int(i.min())
    used_d, used_i = np.zeros(int((d + size).max()) - low_d, bool), np.zeros(int((i + size).max()) - low_i, bool)
    out = []
    while heap:
        n, b, a = heapq.heappop(heap)
        n = -n
        taken = used_d[a - low_d : a - low_d + n] | used_i[b - low_i : b - low_i + n]
        if not taken.any():
            used_d[a - low_d : a - low_d + n] = True
            used_i[b - low_i : b - low_i + n] = True
            out.append((a, b, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[1], taken.view(np.int8), [1]])))
        for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= match:
                heapq.heappush(heap, (-(e - s), b + s, a + s))
    return out


def compare(texts: list[str | None], items: Items, match: int = MATCH, coverage: float = COVERAGE) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """(text, item, coverage, tiles) of each pair with enough coverage."""
    w = words(texts)
    at, seed = _seeds(w.hash, w.doc, match)
    if not len(at) or not len(items.seeds):
        return []
    key = np.minimum(np.searchsorted(items.seeds, seed), len(items.seeds) - 1)
    hit = items.seeds[key] == seed
    at, key = at[hit], key[hit]
    times = items.first[key + 1] - items.first[key]
    doc = w.doc[at]
    out = []
    # texts whose seeds give up to PAIRS pairs are looked at together, others alone
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    pairs = np.add.reduceat(times, begin) if len(begin) else times
    ends, k = np.append(begin[1:], len(doc)), 0
    while k < len(begin):
        stop, total = k + 1, pairs[k]
        while stop < len(begin) and total + pairs[stop] <= PAIRS:
            total += pairs[stop]
            stop += 1
        part = slice(begin[k], ends[stop - 1])
        if total > PAIRS:
            out += _alone(doc[begin[k]], at[part] - np.searchsorted(w.doc, doc[begin[k]]), seed[hit][part], key[part], items, match, coverage)
        else:
            out += _expanded(w, at[part], key[part], times[part], items, match, coverage)
        k = stop
    return out


def _alone(doc: int, at: np.ndarray, seed: np.ndarray, key: np.ndarray, items: Items, match: int, coverage: float) -> list:
    """``compare`` of one text in which seeds repeat so often that their pairs are not to be held at once."""
    kinds = np.unique(key)
    touched = np.unique(np.searchsorted(items.bounds, items.place[ranges(items.first[kinds], items.first[kinds + 1] - items.first[kinds])], side="right") - 1)
    out = []
    for k in touched.tolist():
        words_of = items.words[items.bounds[k] : items.bounds[k + 1]]
        places, own = _seeds(words_of, np.zeros(len(words_of), np.int8), match)
        shared = np.isin(own, seed)
        found = _tiled(len(words_of), places[shared], lambda p=places[shared], o=own[shared]: tiles_of_runs(*runs_by_slices(at, seed, p, o), match), match, coverage)
        if found:
            out.append((int(doc), k, *found))
    return out


def _tiled(size: int, places: np.ndarray, make, match: int, coverage: float) -> tuple[float, list] | None:
    """(covered share, tiles) of an item of ``size`` words with shared seeds at ``places``, if it is enough."""
    covered = np.zeros(size + match, np.int64)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + match, -1)
    if (np.cumsum(covered)[:size] > 0).sum() < coverage * size:
        return None  # tiles cover no more than their seeds
    found = make()
    share = sum(n for _, _, n in found) / size
    return (share, found) if share >= coverage else None


def _expanded(w, at: np.ndarray, key: np.ndarray, times: np.ndarray, items: Items, match: int, coverage: float) -> list:
    """``compare`` of some texts with all pairs of their seeds at hand."""
    in_item = items.place[ranges(items.first[key], times)]
    in_doc = np.repeat(at, times)
    doc = w.doc[in_doc]
    item = np.searchsorted(items.bounds, in_item, side="right") - 1
    order = np.lexsort((in_doc, item, doc))
    doc, item, in_doc, in_item = doc[order], item[order], in_doc[order], in_item[order]
    starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else []
    out = []
    for a, b in zip(starts, np.append(starts[1:], len(doc)) if len(doc) else [], strict=True):
        k = item[a]
        places = in_item[a:b] - items.bounds[k]
        own_doc = in_doc[a:b] - int(np.searchsorted(w.doc, doc[a]))
        found = _tiled(int(items.bounds[k + 1] - items.bounds[k]), places, lambda d=own_doc, p=places: tiles(d, p, match), match, coverage)
        if found:
            out.append((int(doc[a]), int(k), *found))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, match: int, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_words`` words: more of it means more
    passes over the documents, never a larger broadcast. Items alike in text are one,
    with the least id; null texts have no words."""
    rows = benchmark.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).cast("string").alias("text")).agg(F.min(id_col).alias("id"))
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("id", "text").collect()
        if part or n == 1:
            yield index([r["id"] for r in part], [r["text"] for r in part], match)


def contamination(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    match: int = MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row of ``docs``: the ``keep`` columns, contaminated, coverage (the greatest
    of any reported item, else 0) and hits, an array of (item, coverage, tiles) in
    the order of item id for every item of which at least the share ``coverage`` is
    tiled; a tile is (doc_at, item_at, words) in words.

    Null and empty texts, and an empty benchmark, give no hits. An item of fewer than
    ``match`` words can't be found. Words are runs of letters, digits and underscores,
    lower-cased. No row is shuffled: each block of the benchmark is sent to the tasks. Kept columns
    called like a new one stay; the new one then gets an underscore in front."""
    spark = docs.sparkSession
    hits_c, flag_c, share_c = (unused(keep, n) for n in ("hits", "contaminated", "coverage"))
    text = unused([*keep, hits_c, flag_c, share_c], "_text")
    item_type = benchmark.schema[item_id].dataType.simpleString()
    hit_type = f"array<struct<item:{item_type},coverage:double,tiles:array<struct<doc_at:int,item_at:int,words:int>>>>"
    out = docs.select(*keep, F.col(text_col).cast("string").alias(text), F.expr(f"cast(array() as {hit_type})").alias(hits_c))
    schema = ddl(out)
    for items in benchmark_blocks(benchmark, item_id, item_text, match, block_words):
        shipped = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, text):
                hits = block.column(hits_c)
                found = compare(column(block, text), shipped.value, match, coverage)
                if found:
                    lists = hits.to_pylist()
                    for doc, item, share, parts in found:
                        parts = [{"doc_at": a, "item_at": b, "words": n} for a, b, n in parts]
                        lists[doc].append({"item": shipped.value.name[item], "coverage": share, "tiles": parts})
                    hits = pa.array(lists, hits.type)
                yield pa.RecordBatch.from_arrays([hits if c == hits_c else block.column(c) for c in block.schema.names], names=block.schema.names)

        out = mapped(out, run, schema)
    top = F.coalesce(F.array_max(F.transform(hits_c, lambda h: h["coverage"])), F.lit(0.0))
    return out.select(*keep, (F.size(hits_c) > 0).alias(flag_c), top.alias(share_c), F.array_sort(hits_c).alias(hits_c))


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    match: int = MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns. Each block
    of texts is compared in place, so no row is shuffled and texts are read once."""
    out, schema = docs, ddl(docs)
    for items in benchmark_blocks(benchmark, item_id, item_text, match, block_words):
        shipped = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, text_col):
                bad = {doc for doc, *_ in compare(column(block, text_col), shipped.value, match, coverage)}
                yield block.filter(pa.array([k not in bad for k in range(block.num_rows)])) if bad else block

        out = mapped(out, run, schema)
    return out
