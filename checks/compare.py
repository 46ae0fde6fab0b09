"""Run each query in Spark and its SQL in DuckDB and compare them: ``python -m checks.compare SF_DIR [query ...]``."""

from __future__ import annotations

import collections
import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import oracle_sql
from checks.queries import queries
from maskwright.session import get_session


def bag(columns: list[str], rows) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return collections.Counter(tuple(norm(r[i]) for i in order) for r in rows)


def main(sf: str, only: list[str]) -> int:
    spark = get_session(
        master="local[8]", spark__driver__memory="16g", spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    sql, bad = oracle_sql(), 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            df = query(spark, sf)
            got = bag(df.columns, df.collect())
            spark_s, started = time.time() - started, time.time()
            if name not in sql:
                print(f"rows {name:26s} {sum(got.values())} rows, {spark_s:.1f} s", flush=True)
                continue
            res = con.execute(sql[name])
            columns = [d[0] for d in res.description]
            want = bag(columns, res.fetchall())
            same = got == want and sorted(columns) == sorted(df.columns)
            bad += not same
            print(f"{'ok  ' if same else 'DIFF'} {name:26s} {sum(got.values())} / {sum(want.values())} rows, {spark_s:.1f} s / {time.time() - started:.1f} s", flush=True)
            if not same:
                print("   columns", sorted(df.columns), sorted(columns))
                for label, only_in in (("spark", got - want), ("sql", want - got)):
                    for row in list(only_in)[:3]:
                        print("   only", label, str(row)[:400])
        except Exception as e:  # a failing query must not hide the others
            bad += 1
            print(f"FAIL {name:26s} {str(e)[:700]}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
