"""Random draws as Column expressions of (seed, row id, stream).

The draw depends on nothing but those three, so a lost task that runs again, or
another number of partitions, gives the same rows. One md5 carries four 32-bit
uniforms (``slot`` 0-3). A public seed makes added noise removable: keep the
seed secret wherever the noise protects somebody.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def digest(seed: int, row_id: Column, stream: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), row_id.cast("string"), F.lit(stream)))


def uniform(seed: int, row_id: Column, stream: str, slot: int = 0) -> Column:
    """Uniform on the open interval (0, 1)."""
    bits = F.conv(F.substring(digest(seed, row_id, stream), 1 + 8 * slot, 8), 16, 10)
    return (bits.cast("bigint").cast("double") + F.lit(0.5)) / F.lit(TWO_POW_32)


def normal(seed: int, row_id: Column, stream: str, mean=0.0, sd=1.0) -> Column:
    """Box-Muller on two slots of one digest."""
    u1 = uniform(seed, row_id, stream, 0)
    u2 = uniform(seed, row_id, stream, 1)
    z = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return _col(mean) + _col(sd) * z


def lognormal(seed: int, row_id: Column, stream: str, mu: float, sigma: float) -> Column:
    return F.exp(normal(seed, row_id, stream, mu, sigma))


def laplace(seed: int, row_id: Column, stream: str, scale) -> Column:
    return laplace_of(uniform(seed, row_id, stream), scale)


def laplace_of(u: Column, scale) -> Column:
    """Laplace noise from a uniform draw, which is read twice: best a column by itself."""
    centred = u - F.lit(0.5)
    return -_col(scale) * F.signum(centred) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def bernoulli(seed: int, row_id: Column, stream: str, p: float) -> Column:
    return (uniform(seed, row_id, stream) < F.lit(p)).cast("int")


def poisson_thresholds(lam: float, upper: int) -> list[float]:
    """P(X <= j) for j below ``upper``; everything above lands on ``upper``."""
    total, term, out = 0.0, math.exp(-lam), []
    for j in range(upper):
        total += term
        out.append(total)
        term *= lam / (j + 1)
    return out


def poisson(seed: int, row_id: Column, stream: str, lam: float, upper: int) -> Column:
    return step_index(uniform(seed, row_id, stream), poisson_thresholds(lam, upper))


def step_index(u: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds lie at or below ``u``.

    Not a chain of branches, in which Spark would evaluate ``u`` with its digest
    once per branch. Longer lists are one literal: unrolled, a few of them make
    the generated method too long for the JVM to compile.
    """
    if len(thresholds) > 8:
        edges = F.split(F.lit(",".join(repr(float(t)) for t in thresholds)), ",").cast("array<double>")
        # The outer lambda binds ``u``, which the inner one would draw again per threshold.
        return F.element_at(F.transform(F.array(u), lambda x: F.size(F.filter(edges, lambda t: t <= x))), 1)
    out = F.lit(0)
    for t in thresholds:
        out = out + (u >= F.lit(float(t))).cast("int")
    return out


def cumulative(weights: Sequence[float]) -> list[float]:
    total, run, out = float(sum(weights)), 0.0, []
    for w in weights[:-1]:
        run += w
        out.append(run / total)
    return out


def choice(seed: int, row_id: Column, stream: str, values: Sequence, weights: Sequence[float] | None = None) -> Column:
    index = step_index(uniform(seed, row_id, stream), cumulative(weights or [1.0] * len(values)))
    return pick(index, values)


def pick(index: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + F.lit(1))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
