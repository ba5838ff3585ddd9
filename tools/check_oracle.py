"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from statfold.plans.catalog import ORACLE, QUERIES  # noqa: E402
from statfold.session import build_session  # noqa: E402
from statfold.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        return str([_norm(x) for x in v.tolist()])
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if isinstance(v, pd.Timestamp):
        return str(v.date()) if v == v.normalize() else str(v)
    return str(v) if not isinstance(v, (int, bool)) else int(v)


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in QUERIES.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            print(f"rows-only {name}: {len(sdf)} rows {ts:.1f}s")
            continue
        try:
            odf = con.execute(ORACLE[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {name}: {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = _rows(sdf)
        oc, orr = _rows(odf)
        if sc != oc:
            print(f"MISMATCH-COLS {name}: spark={sc} sql={oc}")
            bad += 1
        elif len(sr) != len(orr):
            print(f"MISMATCH-ROWS {name}: spark={len(sr)} sql={len(orr)}")
            bad += 1
        elif sr != orr:
            diff = [(a, b) for a, b in zip(sr, orr) if a != b][:3]
            print(f"MISMATCH-VALUES {name}: {diff}")
            bad += 1
        else:
            print(f"ok {name}: {len(sr)} rows {ts:.1f}s")
    print(f"done, {bad} problems")


if __name__ == "__main__":
    main()
