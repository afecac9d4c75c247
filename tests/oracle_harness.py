"""Compare each registered Spark query with its DuckDB SQL on the same parquet tables.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e)[:2000])
            if verbose:
                print(name, "SPARK_ERROR", str(e)[:2000])
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("ROWS_ONLY", len(s_rows))
            if verbose:
                print(f"{name}: rows-only {len(s_rows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            d_cols = [c[0] for c in cur.description]
            d_rows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", str(e)[:2000])
            if verbose:
                print(name, "SQL_ERROR", str(e)[:2000])
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        hs, ls = digest(s_cols, s_rows)
        hd, ld = digest(d_cols, d_rows)
        ok = ok_cols and len(s_rows) == len(d_rows) and hs == hd
        results[name] = ("MATCH" if ok else "MISMATCH", len(s_rows), len(d_rows))
        if verbose:
            print(f"{name}: {'MATCH' if ok else 'MISMATCH'} spark={len(s_rows)} duck={len(d_rows)} "
                  f"cols_ok={ok_cols} ({ts:.1f}s)")
            if not ok:
                if not ok_cols:
                    print("  spark cols", s_cols, "\n  duck cols ", d_cols)
                sl, dl = set(ls), set(ld)
                for x in sorted(sl - dl)[:5]:
                    print("  spark-only", x[:300])
                for x in sorted(dl - sl)[:5]:
                    print("  duck-only ", x[:300])
    return results


if __name__ == "__main__":
    from pagewise.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if v[0] not in ("MATCH", "ROWS_ONLY")}
    print("SUMMARY", len(res), "queries;", len(bad), "not matching:", sorted(bad))
