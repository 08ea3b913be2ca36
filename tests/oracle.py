"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c] + 0.0
        elif not pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if v is None else str(v))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    got, want = normal(got), normal(want)
    problems = []
    for c in got.columns:
        a, b = got[c], want[c]
        if str(a.dtype)[:3] != str(b.dtype)[:3] and not (a.dtype == object or b.dtype == object):
            problems.append(f"{c}: type {a.dtype} != {b.dtype}")
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same[~same].index[0]
            problems.append(f"{c}: {int((~same).sum())} differ, first {a[at]!r} != {b[at]!r}")
    return problems


def main(argv: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from twinlens.catalog import load
    from twinlens.session import local_session

    sf_dir = argv[0]
    names = argv[1:]
    registry = load()
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, q in registry.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            t0 = time.time()
            got = q.run(spark, sf_dir).toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"rows  {name:24s} {t1 - t0:6.2f}s {len(got)} rows {got.head(3).to_dict('records')}")
                continue
            want = con.execute(q.sql).df()
            t2 = time.time()
            problems = compare(got, want)
            print(f"{'BAD ' if problems else 'ok  '}  {name:24s} {t1 - t0:6.2f}s / {t2 - t1:5.2f}s {len(got)} rows {'; '.join(problems)}")
            bad += bool(problems)
        except Exception as e:  # keep going, report all
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__}: {str(e)[:600]}")
        sys.stdout.flush()
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
