"""Run catalog queries in Spark and their oracle SQL in DuckDB, then compare.

    python tests/oracle_check.py [--strict] [sf_dir] [key ...]

Mirrors the driver's check: row count, column names, and an order-insensitive
comparison of values.  Floats are compared after rounding to 5 digits, or
bit for bit with ``--strict``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

from nearfold.session import local_session  # noqa: E402
from nearfold.sources.fixtures import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = False


def norm_val(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(norm_val(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"row count {len(spark_rows)} vs {len(duck_rows)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(norm_val(r[i]) for i in si) for r in spark_rows), key=repr)
    b = sorted((tuple(norm_val(r[i]) for i in di) for r in duck_rows), key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first: {bad[0]}"
    return None


def main(argv):
    global STRICT
    STRICT = "--strict" in argv
    argv = [a for a in argv if a != "--strict"]
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E

    spark = local_session(8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    for key in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[key](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: spark error {type(e).__name__}: {str(e)[:400]}")
            failed += 1
            continue
        ts = time.time() - t0
        if key not in sqls:
            print(f"ROWS {key}: {len(rows)} rows in {ts:.1f}s (no oracle)")
            continue
        try:
            res = con.execute(sqls[key])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {key}: duckdb error {e}")
            failed += 1
            continue
        err = compare(rows, cols, drows, dcols)
        if err:
            failed += 1
            print(f"FAIL {key}: {err}")
        else:
            print(f"OK   {key}: {len(rows)} rows in {ts:.1f}s")
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
