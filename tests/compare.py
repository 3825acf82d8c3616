"""Run checks against DuckDB on the same parquet files and report differences.

    python tests/compare.py [sf] [name-prefix ...]
"""

import glob
import math
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

LIMIT = 60
DATA = os.environ.get("TESTDATA", "/root/testdata")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if v is None:
        return "NULL"
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else a description."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"rows {len(got)} vs {len(want)}; {len(bad)} differ; first {bad[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from millrace import get_session

    sf = f"{DATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    prefixes = tuple(sys.argv[2:])
    spark = get_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    if os.environ.get("LARGE_PATH"):  # take the plans meant for large inputs, with small blocks
        for k, v in {"millrace.smallInputBytes": "0", "millrace.blockRows": "97", "millrace.knnChunk": "64"}.items():
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad, total = entry.oracle_sql(), 0, 0
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        guard = threading.Timer(LIMIT, lambda: (spark.sparkContext.cancelAllJobs(), con.interrupt()))
        guard.start()
        try:
            problem = compare(spark, con, sf, query, sqls.get(name))
        except Exception as e:  # report and go on to the next check
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        guard.cancel()
        total += 1
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {time.time() - start:6.2f}s {'sql ' if name in sqls else 'rows'} {name} {problem or ''}", flush=True)
    print(f"{total - bad}/{total} ok")
