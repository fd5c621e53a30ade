"""Run registered queries against their SQL twins in DuckDB.

usage: check_oracle.py [--sf DIR] [--partitions N] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from glyphfold.catalog import load
from glyphfold.schemas import TABLES
from glyphfold.session import local_session


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--partitions", type=int, default=8)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    queries, oracle = load()
    spark = local_session(8, args.partitions, "8g", tempfile.mkdtemp(prefix="oracle-"))
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[-900:]}")
            bad += 1
            continue
        took = time.time() - t0
        if name not in oracle:
            print(f"rows  {name}: {len(rows)} rows {took:.1f}s")
            continue
        t0 = time.time()
        try:
            rel = con.sql(oracle[name])
            want = rel.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"ORACLE FAIL {name}: {str(exc)[:900]}")
            bad += 1
            continue
        duck = time.time() - t0
        gc, g = table(df.columns, rows)
        wc, w = table(rel.columns, want)
        if gc != wc or g != w:
            bad += 1
            diff = [(a, b) for a, b in zip(g, w) if a != b][:4]
            print(f"DIFF  {name}: rows {len(g)} vs {len(w)} cols {gc} vs {wc}\n   {diff}")
        else:
            print(f"ok    {name}: {len(g)} rows {took:.1f}s (duck {duck:.1f}s)")
            if len(g) == 0:
                print("      WARNING: empty result")
        kinds = dict(df.dtypes)
        duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        odd = {c: (kinds[c], duck_types.get(c)) for c in kinds if same.get(kinds[c]) != duck_types.get(c)}
        if odd:
            print(f"      types: {odd}")
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
