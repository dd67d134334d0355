"""Run queries next to their SQL in DuckDB: python tests/compare.py [--sf 0.01] NAME..."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd


def canonical(value):
    if isinstance(value, Decimal):
        return format(value.normalize() + 0, "f")
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if value is None or value is pd.NaT:
        return "null"
    return str(value)


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter("|".join(canonical(r[i]) for i in order) for r in rows)


def sql_rows(sf_dir: str, sql: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def plain_row(v):
    from pyspark.sql import Row

    if isinstance(v, Row):
        return {k: plain_row(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [plain_row(x) for x in v]
    return v


def compare(spark, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty when both give the same columns and rows, else what differs."""
    names, rows = spark_rows(query(spark, sf_dir))
    other_names, other = sql_rows(sf_dir, sql)
    if sorted(names) != sorted(other_names):
        return f"{name}: columns {sorted(names)} and {sorted(other_names)}"
    a, b = bag(names, [tuple(plain_row(v) for v in r) for r in rows]), bag(other_names, other)
    if a == b:
        return ""
    return f"{name}: {sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tallyforge.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = f"/root/testdata/sf{args[1]}", args[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    for name in args or sorted(queries):
        began = time.time()
        try:
            if name in sql:
                said = compare(spark, sf, name, queries[name], sql[name]) or "equal"
            else:
                said = f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as error:
            said = f"ERROR {str(error)[:1500]}"
        print(f"{name} {time.time() - began:.1f}s {said}", flush=True)
