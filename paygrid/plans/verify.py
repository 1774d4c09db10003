"""Compare a registered Spark query with its DuckDB oracle (tests, CLI)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from paygrid.sources.fixture import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 2)
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 and str(v)[10:] in ("", " 00:00:00") else str(v)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, name: str, sf_dir: str, con=None, verbose: bool = False) -> tuple[bool, str]:
    from paygrid.plans import load_all
    queries, oracle = load_all()
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    left = sdf.toPandas()
    t1 = time.time()
    if name not in oracle:
        return True, f"{name}: rows-only {len(left)} rows ({t1 - t0:.1f}s)"
    right = con.execute(oracle[name]).df()
    t2 = time.time()
    if sorted(left.columns) != sorted(right.columns):
        return False, f"{name}: columns differ {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return False, f"{name}: rows {len(left)} vs {len(right)}"
    a, b = frame_rows(left), frame_rows(right)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{name}: values differ, e.g. {diff}"
    return True, f"{name}: ok {len(left)} rows (spark {t1 - t0:.1f}s, duck {t2 - t1:.1f}s)"


def main(argv):
    from paygrid.plans import load_all
    from paygrid.session import get_spark
    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
    spark = get_spark()
    queries, _ = load_all()
    con = duck(sf_dir)
    bad = 0
    for n in names or list(queries):
        try:
            ok, msg = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and go on
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1:])
