"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row counts, column names and the multiset of rows (like the driver does).

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    if isinstance(v, dict):
        return repr(sorted((k, _norm(x)) for k, x in v.items()))
    return repr(v)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, key, query, sql, sf_dir, show=5):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        print(f"{key:24s} rows={len(s_rows):8d} (no oracle) spark={t1-t0:.2f}s")
        return True
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    t2 = time.time()
    ok = True
    msgs = []
    if sorted(s_cols) != sorted(d_cols):
        ok = False
        msgs.append(f"columns differ: spark-only={sorted(set(s_cols)-set(d_cols))} "
                    f"oracle-only={sorted(set(d_cols)-set(s_cols))}")
    else:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        sc = Counter(tuple(_norm(r[i]) for i in si) for r in s_rows)
        dc = Counter(tuple(_norm(r[i]) for i in di) for r in d_rows)
        if sc != dc:
            ok = False
            only_s = list((sc - dc).elements())[:show]
            only_d = list((dc - sc).elements())[:show]
            msgs.append(f"rows differ: spark={len(s_rows)} oracle={len(d_rows)} cols={order}")
            msgs.append(f"  spark-only: {only_s}")
            msgs.append(f"  oracle-only: {only_d}")
    print(f"{key:24s} rows={len(s_rows):8d} {'OK ' if ok else 'FAIL'} spark={t1-t0:.2f}s duck={t2-t1:.2f}s")
    for m in msgs:
        print("   ", m)
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as ent
    if os.environ.get("PLAIN_SESSION") == "1":  # a session as a caller would build it, no strata settings
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false")
                 .config("spark.sql.session.timeZone", os.environ.get("PLAIN_TZ", "UTC"))
                 .config("spark.sql.ansi.enabled", os.environ.get("PLAIN_ANSI", "true")).getOrCreate())
    else:
        from strata.session import get_session
        spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = ent.queries(), ent.oracle_sql()
    bad = []
    for k in (keys or list(qs)):
        try:
            if not compare(spark, con, k, qs[k], sqls.get(k), sf_dir):
                bad.append(k)
        except Exception as e:  # report and continue
            print(f"{k:24s} ERROR {type(e).__name__}: {str(e)[:2000]}")
            bad.append(k)
    print("FAILED:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
