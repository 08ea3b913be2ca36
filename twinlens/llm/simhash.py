"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

If the 64 bits are dealt to m partitions and thresholds t_1 .. t_m sum to
``DISTANCE - m + 1``, two fingerprints within ``DISTANCE`` bits are within t_i in at
least one partition i. Correlated bits go to the same partition. Partition count
and thresholds are those of the least estimated cost: rows probed plus candidates,
where candidates are estimated per partition and threshold from the bits' shares and
the values that fingerprints really share, and thresholds are chosen by dynamic
programming. A probe flips half of a threshold's bits on either side and joins on
equality; what meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.components import components
from twinlens.llm.texts import as_batch, blocks, column, ddl, mapped
from twinlens.operators.hotkeys import lookup
from twinlens.session import settle

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
#: A candidate costs so much of what a probed row costs.
CANDIDATE_COST = 0.2


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Of the lower-cased (A-Z) text's word shingles, repeats included; of the whole sequence if it is shorter."""
    raw = b" ".join((text or "").encode().lower().split())
    if not raw:
        return np.zeros(0, "<u8")
    space = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    start, end = np.append(0, space + 1), np.append(space, len(raw))
    if len(start) >= words:
        start, end = start[: len(start) - words + 1], end[words - 1 :]
    else:
        start, end = start[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)], "<u8")


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; 0 without a hash."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the ``keep`` columns, fp) of every row; fp is a signed long. A null text has no word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))
    own = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            fp = np.array([fingerprint(shingle_hashes(t, words)) for t in column(block, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[block.column(c) for c in own], pa.array(fp, pa.int64())], names=[*own, "fp"])

    return mapped(rows, run, f"{ddl(rows.drop('text'))}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, how often bits i and j are both set): 64 x 64 sums over all rows."""
    schema = pa.schema([("n", pa.int64()), ("both", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            v = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(v), 1 << 16):
                b = np.unpackbits(v[at : at + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += (b.T @ b).astype(np.int64)
            n += len(v)
        yield as_batch(schema, [n], [both.ravel().tolist()])

    parts = fps.select("fp").mapInArrow(count, "n long, both array<long>").select("n", F.posexplode("both").alias("at", "both"))
    sums = parts.groupBy("at").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS, np.int64)
    for r in sums:
        both[r["at"]] = r["both"]
    return (sums[0]["n"] if sums else 0), both.reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the bits to ``parts`` partitions of (nearly) equal width: each starts with
    the bit most correlated to the rest and takes the bits most correlated to its own."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(r, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        own = [max(left, key=lambda b: (r[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: (r[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(sorted(own))
    return out


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def estimated(n: int, both: np.ndarray, bits: list[int], same: int, radius: int) -> np.ndarray:
    """Estimated pairs within 0 .. radius bits in a partition: bits taken as
    independent, but at least the pairs that really share the value."""
    p = np.diag(both)[bits] / max(n, 1)
    chance = np.zeros(radius + 2)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.maximum(np.cumsum(chance[: radius + 1]) * n * (n - 1) / 2, same)


def thresholds(costs: list[np.ndarray], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: partition unused) that sum to ``total`` at the least sum of
    ``costs[i][t + 1]``, by dynamic programming over the partitions."""
    m = len(costs)
    low = -m
    best = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picks) in best.items():
            for t in range(-1, len(own) - 1):
                key = used + t
                if low <= key and (key not in new or cost + own[t + 1] < new[key][0]):
                    new[key] = (cost + float(own[t + 1]), [*picks, t])
        best = new
    return best[total]


def masked(bits: list[int]) -> int:
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def plan(fps: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use."""
    n, both = bit_statistics(fps)
    choices = []
    groups = {m: grouped_bits(n, both, m) for m in range(1, distance + 1)}
    keys = {(m, k): masked(bits) for m, parts in groups.items() for k, bits in enumerate(parts)}
    # pairs of equal values per partition: one pass, a row per value and partition
    same: dict[int, int] = {}
    if distance > 1:
        entry = F.explode(F.array(*[F.struct(F.lit(m * 100 + k).alias("part"), F.col("fp").bitwiseAND(F.lit(v)).alias("value")) for (m, k), v in keys.items() if m > 1]))
        counts = fps.select(entry.alias("e")).groupBy("e.part", "e.value").agg(F.count(F.lit(1)).alias("c"))
        same = {r["part"]: int(r["s"] or 0) for r in counts.groupBy("part").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("s")).collect()}
    for m, parts in groups.items():
        costs = []
        for k, bits in enumerate(parts):
            found = estimated(n, both, bits, same.get(m * 100 + k, 0), distance)
            probes = [n * (ball(len(bits), t // 2) + ball(len(bits), t - t // 2)) for t in range(distance + 1)]
            costs.append(np.concatenate([[0.0], np.array(probes) + CANDIDATE_COST * found]))
        cost, picks = thresholds(costs, distance - m + 1)
        choices.append((cost, m, picks))
    _, m, picks = min(choices)
    return [(bits, t) for bits, t in zip(groups[m], picks, strict=True) if t >= 0]


def _flips(bits: list[int], radius: int) -> Column:
    masks = [masked(list(c)) for k in range(radius + 1) for c in combinations(bits, k)]
    return F.array(*[F.lit(x) for x in masks]) if len(masks) < 64 else F.from_json(F.lit(str(masks)), "array<bigint>")


def _keys(part: int, value: Column, flips: Column) -> Column:
    return F.transform(flips, lambda f: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(f).alias("key")))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v) of all pairs of distinct values of ``fp`` that differ in at most
    ``distance`` bits; ``fps`` holds each value once."""
    chosen = plan(fps, distance)

    def side(name: str, query: bool) -> DataFrame:
        entries = []
        for k, (bits, t) in enumerate(chosen):
            value = F.col("fp").bitwiseAND(F.lit(masked(bits)))
            entries.append(_keys(k, value, _flips(bits, t - t // 2 if query else t // 2)))
        return fps.select(F.col("fp").alias(name), F.explode(F.concat(*entries)).alias("e")).select(name, "e.part", "e.key")

    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    q, d = side("u", True), side("v", False)
    met = q.join(d, (q["part"] == d["part"]) & (q["key"] == d["key"]) & near)
    return met.drop("part", "key").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = SHINGLE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, the ``keep`` columns, fp, component, component_id) of every row:
    component_id is the smallest doc_id (nulls aside) that can be reached over links of
    at most ``distance`` bits, component the smallest fingerprint.

    Equal fingerprints are one node, so copies are never paired. Null, empty and blank
    texts have fingerprint zero and no shingle, and are one node. Rows alike stay rows. One
    fingerprint or one component may hold any share of the rows: such are joined apart."""
    fps = settle(fingerprints(docs, id_col, text_col, words, keep))
    groups = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(groups.select("fp"), distance)).select(F.col("node").alias("fp"), "component")
    labelled = settle(groups.join(linked, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    known = settle(lookup(labelled, least, ["component"]).select("fp", "component", "component_id"))
    return lookup(fps, known, ["fp"]).select("doc_id", *keep, "fp", "component", "component_id")
