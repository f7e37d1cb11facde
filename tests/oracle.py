"""Run registered queries against their SQL in DuckDB and compare values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from offerlens.registry.base import TABLES  # noqa: E402


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        v = v.replace(tzinfo=None)
    return None if v is None else (v if isinstance(v, str) else str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr(tuple(plain(r[i]) for i in order)) for r in rows))


def compare(spark_df, con, sql: str):
    """None if equal, else a short description of the difference."""
    got = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    a, b = rows_of(spark_df.columns, got), rows_of(names, want)
    if a == b:
        return None
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"rows {len(a)} vs {len(b)}\n   cols {sorted(names)}\n   spark {only_a}\n   duck  {only_b}"


def main() -> None:
    import __spark_entry__ as entry
    from offerlens.session import build_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                diff = compare(df, con, oracles[name])
            else:
                diff, n = None, df.count()
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        note = "" if name in oracles else f" (rows only: {n})" if diff is None else ""
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - t0:.1f}s{note}" + (f"\n   {diff}" if diff else ""), flush=True)
        bad += diff is not None
    print("queries", len(queries), "oracles", len(oracles), "bad", bad)


if __name__ == "__main__":
    main()
