"""Compares driver queries to their DuckDB equivalents on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """'' if both give the same rows, else what differs."""
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connect(sf), entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(name == x or x == "own" and not name.startswith(("op", "pipeline")) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            said = differences(query(spark, sf), con, sqls[name]) if name in sqls else f"no SQL; {query(spark, sf).count()} rows"
        except Exception as error:  # noqa: BLE001 - the next query is to run all the same
            said = f"{type(error).__name__} {str(error)[:700]}"
        print(f"{name:24} {time.time() - began:6.1f} s  {said or 'same'}", flush=True)
