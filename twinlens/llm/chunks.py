"""Substring deduplication by content-defined chunks.

A text is cut after white space where a rolling gear hash of the last ``WINDOW``
bytes is the least among ``SPACES`` white spaces in a row, so the cuts depend on the content
around them only: an insertion moves the cuts near it and no others. Copies of a passage are
cut alike from its first least hash to its last, and there is one in every ``SPACES`` white
spaces: no passage is missed because its cuts lie near each other. Long stretches without white
space are cut by the same rule after any character. Chunks are counted by a rolling hash
first, and a bitmap of fixed size tells which may repeat, so most of them never travel. The
rest are compared by digest; of equal chunks the one with the least (id, digest of the text, position) stays.
Consecutive chunks that are all later copies form a run, and a run of at least
``LEAST_BYTES`` is cut out of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.bitmaps import added, bitmap, marked
from twinlens.llm.texts import Rolling, as_batch, blocks, column, ddl, mapped, mixed, ranges, unused
from twinlens.operators.hotkeys import lookup
from twinlens.session import stored

WINDOW = 16
#: Of so many white spaces in a row one ends a chunk at least; on average one of (SPACES + 1) / 2 does.
SPACES = 11
#: With characters of three bytes or more (scripts without spaces) one of so many does,
WIDE_CHARACTERS = 31
#: and in stretches of more than so many bytes without white space one of as many others.
STRETCH = 64
LEAST_BYTES = 96
#: Bits of the map of chunks that may repeat.
MAP_BITS = 1 << 26
#: Chunks that a task gathers before it hands their counts on.
GATHERED = 1 << 19
#: Bytes of texts that are cut at once; arrays of some 60 bytes for each of them are alive then.
CUT_BYTES = 1 << 18


def _gear() -> np.ndarray:
    table = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    table[0] = 0
    return table


GEAR = _gear()


def least_of(value: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Places of the least value (the first of equal ones) of every ``width`` values in a
    row within a text. Of equal values that follow one another so, as in a text that
    repeats itself, one in ``width`` stays."""
    if len(value) < width:
        return np.zeros(0, np.int64)
    within = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
    at = np.unique(within + np.lib.stride_tricks.sliding_window_view(value, width)[within].argmin(1))
    new = np.ones(len(at), bool)
    new[1:] = (value[at[1:]] != value[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]) | (np.diff(at) >= width)
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    step = (at - at[first]) // width
    step[1:][~new[1:]] -= step[:-1][~new[1:]]
    return at[new | (step > 0)]


def cuts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) in bytes of every chunk, in order. Chunks cover the texts."""
    pad = b"\0" * WINDOW  # a text's hash starts afresh
    data = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = WINDOW + np.concatenate([[0], np.cumsum(size + WINDOW)[:-1]]).astype(np.int64)
    h = GEAR[data]
    for shift in (1, 2, 4, 8):  # sums of 2, 4, 8 and 16 bytes, each byte doubled for every byte after it
        h[shift:] += h[:-shift] << np.uint16(shift)
    value = mixed(h.astype(np.uint64))
    space = (data == 32) | (data >= 9) & (data <= 13)
    wide = np.zeros(len(data), bool)
    wide[2:] = data[:-2] >= 0xE0  # the third byte of a wide character, or a byte after it
    following = np.append(data[1:], 0)
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, first, 1)
    np.add.at(step, first + size, -1)
    solid = (np.cumsum(step[:-1]) > 0) & ~space
    edge = np.flatnonzero(np.diff(np.concatenate([[0], solid.view(np.int8), [0]])))
    opens, closes = edge[0::2], edge[1::2]
    long = closes - opens > STRETCH
    kinds = [(np.flatnonzero(space), first, SPACES), (np.flatnonzero(wide & (following & 0xC0 != 0x80)), first, WIDE_CHARACTERS)]
    if long.any():
        opens, closes = opens[long], closes[long]
        at = ranges(opens, closes - opens)
        kinds.append((at[~wide[at] & (following[at] & 0xC0 != 0x80)], opens, STRETCH))
    ends = [at[least_of(value[at], np.searchsorted(group, at, side="right"), width)] for at, group, width in kinds]
    at = np.unique(np.concatenate(ends)) + 1
    doc = np.searchsorted(first, at, side="right") - 1
    inside = (doc >= 0) & (at <= first[doc] + size[doc])
    stops = np.unique(np.concatenate([at[inside], first + size, first]))
    start, end = stops[:-1], stops[1:]
    doc = np.searchsorted(first, start, side="right") - 1
    own = (doc >= 0) & (end <= first[doc] + size[doc]) & (end > start)
    doc, start, end = doc[own], start[own], end[own]
    return doc, start - first[doc], end - first[doc]


def _chunks(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``cuts`` and a rolling hash of each chunk."""
    doc, start, end = cuts(raw)
    base = np.cumsum([0, *[len(r) for r in raw]])[doc]
    return doc, start, end, Rolling(np.frombuffer(b"".join(raw), np.uint8)).spans(base + start, base + end)


def repeated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rolling hashes ``h`` of the chunks that all texts have more than once."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for block in blocks(batches, "text", CUT_BYTES):
            h = _chunks([t.encode() for t in column(block, "text")])[3]
            kept.append((h, np.ones(len(h), np.int64)))
            if sum(len(x) for x, _ in kept) > GATHERED:
                kept = [added(kept)]
                if len(kept[0][0]) > GATHERED // 2:
                    yield as_batch(schema, kept[0][0].view(np.int64), kept[0][1])
                    kept = []
        if kept:
            h, n = added(kept)
            yield as_batch(schema, h.view(np.int64), n)

    return mapped(rows, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: np.ndarray | None = None) -> DataFrame:
    """(doc_id, mark, start, end, digest) of every chunk, or of those whose rolling hash has its bit
    set; mark is a digest of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    rows = rows.withColumn("mark", F.xxhash64("text"))
    schema = f"{ddl(docs.select(F.col(id_col).alias('doc_id')))}, mark long, start int, end int, digest long"
    shipped = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for block in blocks(batches, "text", CUT_BYTES):
            raw = [t.encode() for t in column(block, "text")]
            doc, start, end, h = _chunks(raw)
            if shipped is not None:
                likely = marked(h, shipped.value)
                doc, start, end = doc[likely], start[likely], end[likely]
            if not len(doc):
                continue
            found = [digest(raw[d][a:b]) for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").take(at),
                    block.column("mark").take(at),
                    pa.array(start, pa.int32()),
                    pa.array(end, pa.int32()),
                    pa.array(np.array(found, np.uint64).view(np.int64)),
                ],
                names=["doc_id", "mark", "start", "end", "digest"],
            )

    return mapped(rows, chunk, schema)


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, parts): the chunks of each text that an earlier one equals, as
    byte spans in order. The array holds a text's own chunks at most. A chunk that very many texts
    hold is one row here whatever their number; their rows meet it apart."""
    place = F.struct("doc_id", "mark", "start")
    likely = stored(occurrences(docs, id_col, text_col, bitmap(repeated(docs, text_col), MAP_BITS)), "chunks")
    firsts = likely.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first")
    later = lookup(likely, firsts, ["digest"]).where(~F.col("first").eqNullSafe(place)).select("doc_id", "mark", "start", "end")
    return later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("parts"))


def _maybe(marks: DataFrame) -> Callable[[str], Column]:
    """A test of a column of marks: true for all of ``marks`` and, as their bitmap fills, for some others."""
    shipped = marks.sparkSession.sparkContext.broadcast(bitmap(marks.select(F.col("mark").alias("h")), MAP_BITS))

    @F.pandas_udf("boolean")
    def test(mark: pd.Series) -> pd.Series:
        return pd.Series(marked(mark.to_numpy(np.int64).view(np.uint64), shipped.value))

    return test


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = LEAST_BYTES, removed: str = "removed_bytes") -> DataFrame:
    """All rows and columns of ``docs``, their texts without later copies of passages,
    and ``removed``, the number of bytes cut out.

    A null or empty text stays as it is. Rows alike in id and text are one document,
    so all of them stay alike. A text that is a copy as a whole becomes empty; its
    row stays. Ties go to the smaller id (null first), then the smaller digest of
    the text, then the earlier place. Digests have 64 bits: a false run needs several
    chunks in a row to collide. Only texts that may hold copies meet their spans in a join; a bitmap
    tells them apart, so the others do not travel."""
    mark, parts = unused(docs.columns, "_mark"), unused(docs.columns, "_parts")
    found = stored(copies(docs, id_col, text_col), "spans")
    spans = found.select(F.col("doc_id").alias("_span_id"), F.col("mark").alias("_span_mark"), F.col("parts").alias(parts))
    rows, maybe = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string"))), _maybe(found)
    held = rows.where(maybe(mark))
    joined = held.join(spans, held[id_col].eqNullSafe(spans["_span_id"]) & (held[mark] == spans["_span_mark"]), "left").select(*docs.columns, parts)
    others = rows.where(~maybe(mark)).select(*docs.columns, F.lit(None).cast(joined.schema[parts].dataType).alias(parts))
    joined = joined.unionByName(others)
    names, schema = docs.columns, f"{ddl(docs)}, {removed} long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            texts, lost = column(block, text_col), [0] * block.num_rows
            for k, found in enumerate(column(block, parts)):
                if found:
                    texts[k], lost[k] = without(texts[k], found, least_bytes)
            cols = [pa.array(texts, block.schema.field(text_col).type) if c == text_col else block.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lost, pa.int64())], names=[*names, removed])

    return mapped(joined, cut, schema)


def without(text: str, parts: list[dict], least_bytes: int) -> tuple[str, int]:
    """The text without the runs of adjoining parts that are long enough, and the bytes cut out."""
    raw, kept, at, lost = text.encode(), [], 0, 0
    k = 0
    while k < len(parts):
        start, end = parts[k]["start"], parts[k]["end"]
        k += 1
        while k < len(parts) and parts[k]["start"] == end:
            end = parts[k]["end"]
            k += 1
        if end - start >= least_bytes:
            kept.append(raw[at:start])
            at, lost = end, lost + end - start
    return b"".join([*kept, raw[at:]]).decode(), lost
