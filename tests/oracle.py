"""Runs registered queries in Spark and their SQL twins in DuckDB and compares the results.

``python tests/oracle.py [--sf DIR] [name part …]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = "/root/testdata/sf0.01"


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(row[i]) for i in order) for row in rows), key=repr)


def duck(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, name, fn, sql, folder, con):
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return len(got), None, "rows only"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return len(got), False, f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return len(got), False, f"first difference {a} != {b}"
    return len(got), True, "match"


def main():
    from obsframe.session import local_session
    import __spark_entry__ as e

    args = sys.argv[1:]
    folder = DEFAULT
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark = local_session(8)
    con = duck(folder)
    oracles = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if args and not any(a in name for a in args):
            continue
        t0 = time.time()
        try:
            n, ok, note = compare(spark, name, fn, oracles.get(name), folder, con)
        except Exception as ex:  # report and go on with the next query
            n, ok, note = -1, False, f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += ok is False
        print(f"{'FAIL' if ok is False else 'ok  '} {name} rows={n} {time.time() - t0:.1f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
