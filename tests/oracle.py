"""Run a query and its SQL over one directory and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def duck(d):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"create view {name} as select * from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


def compare(spark, name, d, quiet=True):
    import __spark_entry__ as e

    t = time.time()
    df = e.queries()[name](spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None, len(got), 0, took
    cur = duck(d).execute(sql)
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns), (name, sorted(cols), sorted(df.columns))
    want = rows_of(cols, cur.fetchall())
    if got != want and not quiet:
        a, b = set(map(repr, got)), set(map(repr, want))
        print("  only spark:", sorted(a - b)[:5], "\n  only sql:", sorted(b - a)[:5])
    return got == want, len(got), len(want), took


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from skein.session import build_session

    spark = build_session(cpus=8)
    d = sys.argv[1]
    names = sys.argv[2:] or list(e.queries())
    for n in names:
        try:
            ok, a, b, s = compare(spark, n, d, quiet=False)
            print(f"{n}: {'rows only' if ok is None else 'same' if ok else 'DIFFERENT'} {a} {b} {s:.1f}s", flush=True)
        except Exception as x:  # noqa: BLE001
            print(f"{n}: ERROR {type(x).__name__} {str(x)[:1500]}", flush=True)
