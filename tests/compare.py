"""Comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from millrace.plans.common import TABLES


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is not None, type(v).__name__, v) for v in r])


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted([tuple(_cell(r[n]) for n in names) for r in df.collect()])


def sql_rows(db, sql: str):
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in result.fetchall()]
    return [columns[i] for i in order], _sorted(rows)
