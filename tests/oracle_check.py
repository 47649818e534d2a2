"""Run catalogue queries and their DuckDB oracle side by side.

Usage: python tests/oracle_check.py [sf dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return v

    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name, query, sql):
    """None if equal, else a short description of the difference."""
    df = query(spark, sf)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = normal(res.fetchall(), names)
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    types = {type(v).__name__ for r in got[1] for v in r} ^ {type(v).__name__ for r in want[1] for v in r}
    if got[1] != want[1]:
        only = [r for r in got[1] if r not in set(want[1])][:2]
        miss = [r for r in want[1] if r not in set(got[1])][:2]
        return f"rows {len(got[1])} vs {len(want[1])}; spark only {str(only)[:500]}; sql only {str(miss)[:500]}"
    return f"types {types}" if types else None


def session():
    from feedlens.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = session(), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, sf, name, query, oracle[name])
            else:
                problem = None if query(spark, sf).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ('' if name in oracle else '(rows only)')}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
