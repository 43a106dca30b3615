"""Compare registered queries with their DuckDB SQL: python tests/oracle_check.py DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from kgaudit.workload.registry import BASE  # noqa: E402


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("kgaudit-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, int):
        return f"i{v}"
    return f"{type(v).__name__[0]}{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(name, fn, sql, spark, folder, con):
    t = time.time()
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return f"rows-only {len(got)}", spent, len(got) > 0
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"COLUMNS spark={got_cols} duckdb={want_cols}", spent, False
    if got != want:
        gs, ws = set(got), set(want)
        extra, lack = sorted(gs - ws)[:3], sorted(ws - gs)[:3]
        return f"DIFF spark={len(got)} duckdb={len(want)}\n   only spark {extra}\n   only duckdb {lack}", spent, False
    return f"ok {len(got)}", spent, True


def main():
    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = spark_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            msg, spent, fine = compare(name, fn, oracle.get(name), spark, folder, con)
        except Exception as e:  # report and go on
            if os.environ.get("TRACE"):
                traceback.print_exc()
            msg, spent, fine = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0, False
        if not fine:
            bad.append(name)
        print(f"{'  ' if fine else '!!'} {name:10s} {spent:6.2f}s {msg}", flush=True)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
