"""Run registered queries against their SQL oracle; also usable by hand:

    python tests/oracle.py [sf_dir] [key prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return float(value) if abs(value) < 2**52 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, sf_dir, fn, sql):
    began = time.time()
    frame = fn(spark, sf_dir)
    got, got_names = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    compare.spark_seconds = time.time() - began
    if sql is None:
        return len(got), None
    cursor = con.execute(sql)
    want, want_names = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return len(got), f"columns {got_names} vs {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else "many"
        missing = [r for r in want if r not in set(got)][:3] if len(want) < 50000 else "many"
        return len(got), f"rows {len(got)} vs {len(want)}; spark only {extra}; oracle only {missing}"
    return len(got), None


if __name__ == "__main__":
    from threadloom.plans import load_all
    from threadloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracles = load_all()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for key, fn in queries.items():
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            n, problem = compare(spark, con, sf_dir, fn, oracles.get(key))
        except Exception as error:
            n, problem = -1, "".join(traceback.format_exception_only(error))[:900]
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {key} rows={n} spark {getattr(compare, "spark_seconds", 0):.1f}s of {time.time() - began:.1f}s {'' if key in oracles else '(no oracle)'} {problem or ''}", flush=True)
        if problem:
            bad.append(key)
    print("failed:", bad)
