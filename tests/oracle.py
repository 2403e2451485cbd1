"""Spark-vs-DuckDB comparison used by the tests and by ``python -m tests.oracle``.

Mirrors the driver's check: same row count, same column names, and equal
values after sorting columns by name and rows by value (doubles compared to a
relative 1e-9).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           if not isinstance(x, float) else (False, "f", round(x, 6))
                                           for x in r))


def _eq(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        try:
            a, b = float(a), float(b)
        except (TypeError, ValueError):
            return False
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"row count {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = _rows(spark_pdf), _rows(duck_pdf)
    for i, (ra, rb) in enumerate(zip(a, b)):
        if not all(_eq(x, y) for x, y in zip(ra, rb)):
            return False, f"row {i} differs: {ra} vs {rb} (cols {sorted(spark_pdf.columns)})"
    return True, f"{len(a)} rows equal"


def run(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from netgeo.session import get_spark
    spark = get_spark("local[8]")
    qs, orc = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            spdf = sdf.toPandas()
            ts = time.time() - t0
            if name not in orc:
                print(f"{name:28s} rows-only  {len(spdf)} rows  spark {ts:.1f}s", flush=True)
                continue
            dpdf = con.execute(orc[name]).df()
            ok, msg = compare(spdf, dpdf)
        except Exception as e:  # report and continue
            ok, msg, ts = False, f"{type(e).__name__}: {str(e)[:400]}", time.time() - t0
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} {msg[:300]}  spark {ts:.1f}s", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf, args = args[0], args[1:]
    sys.exit(1 if run(args or None, sf) else 0)
