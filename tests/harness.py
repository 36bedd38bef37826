"""Side-by-side run of a query and its SQL check."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return str(value) if value.__class__.__name__ == "Decimal" else value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    return [columns[i] for i in order], rows


def difference(df, con, sql) -> str:
    """Empty when both sides hold the same rows, else a short description."""
    names, got = spark_rows(df)
    columns, want = sql_rows(con, sql)
    if names != columns:
        return f"columns {names} != {columns}"
    if not want:
        return "the check returns no rows"
    if got != want:
        only_spark, only_sql = got - want, want - got
        return (
            f"{sum(got.values())} vs {sum(want.values())} rows; only in query "
            f"{list(only_spark.items())[:3]} ({sum(only_spark.values())}); only in check "
            f"{list(only_sql.items())[:3]} ({sum(only_sql.values())})"
        )
    return ""
