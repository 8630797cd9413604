"""Compares queries with their SQL, as the driver does: python -m tests.compare SF NAME..."""

from __future__ import annotations

import math
import sys
import time

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def oracle_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    import glob
    import os

    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from '{where}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def difference(spark, folder: str, name: str, query, sql: str) -> str:
    """Empty when both agree."""
    names, rows = spark_rows(query(spark, folder))
    other, expected = oracle_rows(folder, sql)
    if names != other:
        return f"columns {names} and {other}"
    if rows != expected:
        mine, theirs = set(rows) - set(expected), set(expected) - set(rows)
        return f"{len(rows)} and {len(expected)} rows; only here {sorted(mine, key=repr)[:3]}, only there {sorted(theirs, key=repr)[:3]}"
    return ""


def main(args: list[str]) -> None:
    import __spark_entry__ as entry
    from quirework.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{args[0]}"
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args[1:] or queries:
        began = time.time()
        try:
            if name in sql:
                said = difference(spark, folder, name, queries[name], sql[name]) or "same"
            else:
                said = f"no SQL, {queries[name](spark, folder).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
