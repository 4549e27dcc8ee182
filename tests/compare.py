"""Rows of a Spark query against rows of SQL on the same tables."""

import math
import os
from collections import Counter

import duckdb


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 9) if isinstance(v, (int, float)) else str(v)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(value(r[c]) for c in columns) for r in df.collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(value(r[i]) for i in order) for r in cursor.fetchall())


def assert_same(df, sql, folder):
    left, right = spark_rows(df), sql_rows(sql, folder)
    assert left[0] == right[0]
    assert left[1] == right[1], (list((left[1] - right[1]).items())[:2], list((right[1] - left[1]).items())[:2])
