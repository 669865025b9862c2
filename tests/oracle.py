"""Comparison of a query with its SQL in DuckDB."""

import datetime
import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, in_order(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(directory, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{directory}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, in_order(tuple(plain(r[i]) for i in at) for r in result.fetchall())
