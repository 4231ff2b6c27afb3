"""Compares a registered query with its SQL form on DuckDB.

Run as ``python tests/oracle.py [sf_dir] [query ...]``.
"""

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(mine[1]), None
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    other = canonical(names, result.fetchall())
    if mine == other:
        return len(mine[1]), None
    if mine[0] != other[0]:
        return len(mine[1]), f"columns {mine[0]} vs {other[0]}"
    a, b = set(mine[1]), set(other[1])
    return len(mine[1]), (f"{len(mine[1])} vs {len(other[1])} rows; only here {sorted(a - b)[:3]};"
                          f" only in SQL {sorted(b - a)[:3]}")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tablewright.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                            spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            n, problem = compare(session, con, sf, fn, sqls.get(name))
        except Exception as e:
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        label = "ok" if problem is None else "BAD"
        print(f"{label:4}{name:32}{n:8} rows {time.time() - start:6.2f}s {'' if name in sqls else '(no SQL) '}{problem or ''}",
              flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)
