"""Bitmaps of hashes: they tell in a fixed space what may be in a set of any size.

As the set grows the map fills and lets more through. What passes must be checked all the
same, so a full map costs time and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for the low end of each long ``h``; ``bits`` (a power of two) in all, whatever their number."""
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    cells = hashes.groupBy(F.shiftright(low, 5).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST((h & {bits - 1}) % 32 AS INT))")).alias("bits"))
    found = cells.toArrow()  # bits / 32 rows at most
    out = np.zeros(bits // 32, np.uint32)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def marked(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes have their bit set."""
    cell = (h & np.uint64(32 * len(bits) - 1)).astype(np.int64)
    return (bits[cell >> 5] >> (cell & 31).astype(np.uint32)) & 1 == 1


def added(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a list of (hashes, counts) once, with the sum of its counts."""
    h, n = (np.concatenate(x) for x in zip(*kept, strict=True))
    if not len(h):
        return h, n
    order = np.argsort(h)
    h, n = h[order], n[order]
    new = np.append(True, h[1:] != h[:-1])
    return h[new], np.add.reduceat(n, np.flatnonzero(new))
