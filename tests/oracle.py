"""Run registered queries next to their SQL on DuckDB: python tests/oracle.py SF_DIR [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return str(v) if not isinstance(v, (int, bool)) else int(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf):
    t = time.time()
    df = fn(spark, sf)
    got = normal(df.columns, df.collect())
    t1 = time.time() - t
    if sql is None:
        return ("rows-only", len(got[1]), t1, 0.0, "")
    t = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = normal(cols, cur.fetchall())
    t2 = time.time() - t
    if got[0] != want[0]:
        return ("COLUMNS", len(got[1]), t1, t2, f"{got[0]} vs {want[0]}")
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:2]
        return ("MISMATCH", len(got[1]), t1, t2, f"{len(got[1])} vs {len(want[1])} rows {got[0]}\n   " + "\n   ".join(map(str, bad)))
    return ("ok", len(got[1]), t1, t2, "")


def connect(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def main():
    import __spark_entry__ as E
    from tests.sessions import session
    sf, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark, con = session(), connect(sf)
    bad = 0
    sqls = E.oracle_sql()
    for name, fn in E.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            res = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:  # report and go on
            res = ("ERROR", 0, 0, 0, f"{type(e).__name__}: {str(e)[:900]}")
        bad += res[0] not in ("ok", "rows-only")
        print(f"{res[0]:9s} {name:44s} rows={res[1]:<7d} spark={res[2]:.2f}s duck={res[3]:.2f}s {res[4]}", flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main()
