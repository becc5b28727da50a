"""Run registered queries and compare each with its SQL twin in DuckDB.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from parcelmill.plans.bindings import SOURCE_TABLES
from parcelmill.session import get_session


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((x is None, x or "") for x in t)
    )


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    import importlib

    entry = importlib.import_module("__spark_entry__")
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = get_session("check", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                        spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    names = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:700]}")
            continue
        dt = time.time() - t0
        if name not in oracle:
            print(f"rows  {name}: {len(got[1])} rows {dt:.2f}s")
            continue
        try:
            t0 = time.time()
            res = con.execute(oracle[name])
            want_cols = [d[0] for d in res.description]
            want_types = {d[0]: str(d[1]) for d in res.description}
            want = rows_of(want_cols, res.fetchall())
            dd = time.time() - t0
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ORACLE-ERROR {name}: {str(e)[:700]}")
            continue
        if got == want:
            odd = {c: t for c, t in want_types.items() if "HUGEINT" in t or "DECIMAL" in t or "[]" in t or "STRUCT" in t}
            print(f"ok    {name}: {len(got[1])} rows {dt:.2f}s (duck {dd:.2f}s){' TYPES ' + str(odd) if odd else ''}"
                  f"{' EMPTY' if not got[1] else ''}")
        else:
            bad += 1
            print(f"DIFF  {name}: rows {len(got[1])} vs {len(want[1])}; cols {got[0]} vs {want[0]}")
            ws, gs = set(want[1]), set(got[1])
            for r in [r for r in got[1] if r not in ws][:3]:
                print("   spark ", r)
            for r in [r for r in want[1] if r not in gs][:3]:
                print("   duckdb", r)
            print("   types", types, want_types)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
