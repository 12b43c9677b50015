"""Run queries() against oracle_sql() the way the driver does (rows, schema, values).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except ImportError:
        pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    dpdf = con.execute(sql).df() if sql else None
    t2 = time.time()
    if dpdf is None:
        print(f"{name}: rows-only spark={len(spdf)} ({t1 - t0:.1f}s)")
        return True
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    ok = sc == dc and len(sr) == len(dr) and sr == dr
    status = "OK " if ok else "BAD"
    print(f"{status} {name}: spark={len(sr)} duck={len(dr)} ({t1 - t0:.1f}s / {t2 - t1:.1f}s)")
    if not ok and verbose:
        if sc != dc:
            print("   cols spark", sc)
            print("   cols duck ", dc)
        else:
            sset, dset = set(sr), set(dr)
            only_s = [r for r in sr if r not in dset][:3]
            only_d = [r for r in dr if r not in sset][:3]
            print("   cols", sc)
            for r in only_s:
                print("   spark-only", str(r)[:700])
            for r in only_d:
                print("   duck-only ", str(r)[:700])
    return ok


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    import __spark_entry__ as E
    from leadlake.session import get_spark
    spark = get_spark()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    names = args or list(qs)
    bad = []
    for n in names:
        try:
            if not compare(spark, con, n, qs[n], sqls.get(n), sf_dir):
                bad.append(n)
        except Exception as e:  # report and continue
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:1500]}")
            bad.append(n)
    print(f"{len(names) - len(bad)}/{len(names)} ok; bad: {bad}")


if __name__ == "__main__":
    main()
