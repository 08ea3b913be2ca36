"""Arrow batches of texts cut into bounded blocks, and their words as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64


def mapped(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``rows.mapInArrow``, with batches of ``BATCH_BYTES`` in this session from now on, unless its
    limit was changed: by default a batch holds 10,000 texts or 64 MB, twice (in the JVM and in Python) for each core."""
    spark = rows.sparkSession
    if spark.conf.get(_BATCH_LIMIT) in ("67108864b", "67108864", "64MB"):
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return rows.mapInArrow(fn, schema)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices whose texts hold at most ``limit`` bytes; a longer text comes alone and whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def unused(taken, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def ddl(df) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the place where each text starts (one more for the end)."""
    texts = [t or "" for t in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def word_characters() -> np.ndarray:
    """Which code points belong to words: letters, digits and the underscore."""
    return np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Karp-Rabin hashes of any spans of an array, by prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _BASE):
        n = 1 << max(10, int(len(values)).bit_length())
        self.inverse = _powers(n, pow(int(base), -1, 1 << 64))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(n, int(base))[: len(values)], out=self.sums[1:], dtype=np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


class Words(NamedTuple):
    doc: np.ndarray  #: index of the text
    hash: np.ndarray  #: 64-bit hash of the word
    start: np.ndarray  #: code point where the word starts, counted over all texts
    end: np.ndarray
    rolling: Rolling
    bounds: np.ndarray  #: where each text starts


def words(texts: list[str | None]) -> Words:
    """Runs of letters, digits and underscores of the lower-cased texts."""
    cp, bounds = codes([t.lower() if t else "" for t in texts])
    inside = word_characters()[cp]
    edge = np.zeros(len(cp) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(cp):
        edge[0], edge[-1] = inside[0], inside[-1]
    starts_text = bounds[1:-1]
    # a word that runs to the end of one text and one that opens the next are two words
    touching = starts_text[(starts_text > 0) & (starts_text < len(cp))]
    touching = np.unique(touching[inside[touching - 1] & inside[touching]]) if len(touching) else touching
    cuts = np.flatnonzero(edge)
    if len(touching):
        cuts = np.sort(np.concatenate([cuts, touching, touching]))
    start, end = cuts[0::2], cuts[1::2]
    rolling = Rolling(cp)
    doc = np.searchsorted(bounds, start, side="right") - 1
    return Words(doc, rolling.spans(start, end), start, end, rolling, bounds)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., then start[1], ...: the indexes of many slices."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    step = np.ones(total, np.int64)
    step[0] = start[0]
    at = np.cumsum(length)[:-1]
    step[at] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(step)


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
