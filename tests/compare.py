"""Run registered queries against their SQL twins in DuckDB.

``python tests/compare.py [--sf 0.01] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r)
    )


def check(con, spark, name, fn, sql, folder):
    """None when equal, else a message."""
    df = fn(spark, folder)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if len(got) > 0 else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    ocols, want = rows_of(names, cur.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}"
    kinds = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}}
    for c, t in df.dtypes:
        if t in kinds and types[c].upper() not in kinds[t]:
            return f"type of {c}: spark {t}, sql {types[c]}"
        if t == "timestamp":
            return f"type of {c}: timestamp with zone"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first:\n  {cols}\n  spark {bad[0][0]}\n  sql   {bad[0][1]}"
    return None if got else "equal but empty"


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    import __spark_entry__ as entry
    from metriloom.session import build_session

    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = duck(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            problem = check(con, spark, name, fn, sqls.get(name), folder)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {kind} {name} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
