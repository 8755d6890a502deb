"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names, column types (coarsely) and the multiset
of rows. Prints one line per query and a summary; exit code 1 on mismatch.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import canon as rows_of  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = set(argv[1:])
    from bedcensus.session import get_session
    import __spark_entry__ as E

    spark = get_session(master="local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        s_cols = df.columns
        s_rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in sqls:
            print(f"{name:40s} spark-only rows={len(s_rows)} {t1 - t0:.1f}s")
            continue
        res = con.execute(sqls[name])
        d_cols = [c[0] for c in res.description]
        d_rows = res.fetchall()
        t2 = time.time()
        ok_cols = sorted(s_cols) == sorted(d_cols)
        ok_n = len(s_rows) == len(d_rows)
        ok_v = ok_cols and rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
        status = "OK" if (ok_cols and ok_n and ok_v) else "MISMATCH"
        if status != "OK":
            bad += 1
        print(
            f"{name:40s} {status} rows={len(s_rows)}/{len(d_rows)} cols={'ok' if ok_cols else (s_cols, d_cols)}"
            f" spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s",
            flush=True,
        )
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
