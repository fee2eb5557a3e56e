"""Compare registered queries with their SQL on one data folder: ``python tests/check.py [folder] [names…]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _cell(v):
    if isinstance(v, float):
        return f"{v:.6f}" if v == v else "nan"
    return str(v)


def compare(spark, con, name, query, sql, folder):
    t0 = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows={len(got)} (no sql) spark={t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    info = f"rows={len(got)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)} {info}"
    a, b = canon_rows(df.columns, got), canon_rows(cols, want)
    if a == b:
        return True, info
    diff = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return False, f"{info} sql_rows={len(want)}\n   spark {diff[0]}\n   sql   {diff[1]}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from graphloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pick = sys.argv[2:]
    spark = build_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls, bad = oracle_sql(), []
    for name, q in queries().items():
        if pick and name not in pick:
            continue
        try:
            ok, info = compare(spark, con, name, q, sqls.get(name), folder)
        except Exception as e:  # noqa: BLE001 - a report over all queries
            ok, info = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print("ok  " if ok else "FAIL", name, info, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
