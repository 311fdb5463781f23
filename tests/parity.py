"""Compare registered queries with their SQL twins in DuckDB.

    python tests/parity.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(value + 0.0, ".9g")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_norm(v) for v in value) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def kinds(df):
    short = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    return {f.name: short.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = kinds(df)
    off = {n: (mine[n], types[n]) for n in names if mine[n] != types[n]}
    if off:
        return f"types {off}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        lack = [r for r in b if r not in set(a)][:2]
        return f"{len(a)} vs {len(b)} rows\n   columns {sorted(names)}\n   spark {extra}\n   sql   {lack}"
    return None


def main() -> None:
    from callscope.plans import oracles, queries
    from callscope.session import get_spark

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = get_spark()
    con = duck(sf_dir)
    sqls = oracles()
    bad = 0
    for name, fn in queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, name, fn, sqls[name])
            else:
                problem = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        tag = "ok" if problem is None else "FAIL"
        print(f"{tag:5}{'sql ' if name in sqls else 'rows'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
