"""Running sums within keys that no single task has to hold.

A window over a key puts all rows of the key into one task. Here rows are
dealt by ranges of the whole (key, order, row) tuple, so a key, and even rows that are
alike, can lie in many partitions. Each partition adds up its own rows; only the
first key of a partition can have rows in earlier ones, so one number per partition is
carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.operators.columns import unused
from twinlens.session import stored

#: How running values are combined, by kind: (of two values, numpy and Spark type).
_KINDS = {
    "sum": (lambda a, b: a + b, np.float64, "double"),
    "count": (lambda a, b: a + b, np.int64, "bigint"),
    "xor": (lambda a, b: a ^ b, np.int64, "bigint"),
}


def _within(kind: str, value: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running values that start afresh where ``new`` is set."""
    if kind == "sum":  # each key by itself: a difference of totals would carry one key's rounding, or infinity, to the next
        return pd.Series(value).groupby(np.cumsum(new)).cumsum(skipna=False).to_numpy()
    upto = np.cumsum(value) if kind == "count" else np.bitwise_xor.accumulate(value)
    start = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
    before = np.where(start > 0, upto[start - 1], 0)
    return upto - before if kind == "count" else upto ^ before


def running(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, tuple[str, str | Column]], parts: int | None = None) -> DataFrame:
    """All rows and columns of ``df`` and, for each ``out: (kind, value)``, the sum (kind
    "sum": double, "count": whole numbers) or exclusive or ("xor") of the values of the rows of
    the same key up to and with this one, by ``order``. A null value counts as 0, null keys
    are one key. Rows equal in ``order`` follow their digest; rows alike follow each other.
    The result is a stored table; it is range-partitioned, so no key is ever one task's."""
    names = df.columns
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = [*names, *values]
    own = {out: unused([*taken, *values], f"_of_{out}") for out in values}
    part_c, at_c, lead_c, tie_c, id_c = (unused([*taken, *own.values()], n) for n in ("_part", "_at", "_lead", "_tie", "_id"))
    kinds = {out: kind for out, (kind, _) in values.items()}
    cols = [F.coalesce((F.col(v) if isinstance(v, str) else v).cast(_KINDS[k][2]), F.lit(0).cast(_KINDS[k][2])).alias(own[out]) for out, (k, v) in values.items()]
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]  # a map has no digest
    rows = df.select(*names, *cols, F.xxhash64(*plain).alias(tie_c), F.monotonically_increasing_id().alias(id_c))
    whole = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col(tie_c), F.col(id_c)]
    rows = rows.repartitionByRange(parts, *whole).sortWithinPartitions(*whole).drop(tie_c, id_c)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += "".join(f", `{out}` {_KINDS[k][2]}" for out, k in kinds.items()) + f", {part_c} int, {at_c} long, {lead_c} boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last, leading = TaskContext.get().partitionId(), 0, None, True
        carried = {out: 0 for out in kinds}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            head, tail = ([repr(batch.column(k)[i].as_py()) for k in keys] for i in (0, n - 1))
            new[0] = last is not None and head != last
            last = tail
            carry_on = np.cumsum(new) == 0
            sums = []
            for out, kind in kinds.items():
                combine, dtype, _ = _KINDS[kind]
                total = _within(kind, batch.column(own[out]).to_numpy(zero_copy_only=False).astype(dtype), new).copy()
                total[carry_on] = combine(total[carry_on], dtype(carried[out]))
                carried[out] = total[-1]
                sums.append(pa.array(total))
            lead = carry_on if leading else np.zeros(n, bool)
            leading = leading and bool(carry_on.all())
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(at + np.arange(n)), pa.array(lead)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *sums, *extra], names=[*names, *kinds, part_c, at_c, lead_c])
            at += n

    done = stored(rows.mapInArrow(run, schema), "running")
    ends = done.groupBy(part_c).agg(
        F.min(F.struct(at_c, *keys)).alias("first") if keys else F.min(F.struct(at_c)).alias("first"),
        F.max(F.struct(at_c, lead_c, *[k for k in keys], *kinds)).alias("last"),
    )
    carry, open_key, open_sum = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r[part_c]):  # a row per partition
        first, last = repr([r["first"][k] for k in keys]), repr([r["last"][k] for k in keys])
        mine = open_sum if first == open_key else {out: 0 for out in kinds}
        if first == open_key:
            carry.append((r[part_c], *[_KINDS[k][1](mine[out]).item() for out, k in kinds.items()]))
        total = {out: _KINDS[k][1](r["last"][out]) for out, k in kinds.items()}
        if r["last"][lead_c]:
            total = {out: _KINDS[k][0](total[out], _KINDS[k][1](mine[out])) for out, k in kinds.items()}
        open_key, open_sum = last, total
    if not carry:
        return done.drop(part_c, at_c, lead_c)
    more = {out: unused([*taken, part_c, at_c, lead_c], f"_carry_{out}") for out in kinds}
    table = spark.createDataFrame(carry, f"{part_c} int" + "".join(f", `{more[out]}` {_KINDS[k][2]}" for out, k in kinds.items()))
    joined = done.join(F.broadcast(table), part_c, "left")
    full = []
    for out, kind in kinds.items():
        own_sum, add = F.col(f"`{out}`"), F.coalesce(F.col(f"`{more[out]}`"), F.lit(0).cast(_KINDS[kind][2]))
        both = own_sum.bitwiseXOR(add) if kind == "xor" else own_sum + add
        full.append(F.when(F.col(lead_c), both).otherwise(own_sum).alias(out))
    return joined.select(*[F.col(f"`{c}`") for c in names], *full)
