"""Compare every catalogue query with its DuckDB oracle (as the driver does).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    sys.path.insert(0, ".")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    names = names or [n for n in qs if n in sqls]
    con = duck(sf_dir)
    results = {}
    for name in names:
        t0 = time.time()
        sdf = qs[name](spark, sf_dir)
        s_cols = sdf.columns
        s_rows = rows_of(s_cols, [tuple(r) for r in sdf.collect()])
        t1 = time.time()
        rel = con.sql(sqls[name])
        d_cols = rel.columns
        d_rows = rows_of(d_cols, rel.fetchall())
        same_cols = sorted(s_cols) == sorted(d_cols)
        ok = same_cols and s_rows == d_rows
        diff = 0
        if same_cols and not ok:
            sset, dset = set(s_rows), set(d_rows)
            diff = len(sset ^ dset)
        results[name] = ok
        if verbose:
            print(f"{'OK ' if ok else 'BAD'} {name:24s} rows spark={len(s_rows)} duck={len(d_rows)} "
                  f"cols_same={same_cols} sym_diff={diff} spark_s={t1 - t0:.2f}", flush=True)
            if not ok and same_cols:
                sset, dset = set(s_rows), set(d_rows)
                print("   spark-only:", sorted(sset - dset, key=repr)[:3])
                print("   duck-only: ", sorted(dset - sset, key=repr)[:3])
            elif not same_cols:
                print("   spark cols:", sorted(s_cols), "\n   duck cols: ", sorted(d_cols))
    return results


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from creditspark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    res = compare(spark, sf, sys.argv[2:] or None)
    print(f"{sum(res.values())}/{len(res)} match")
