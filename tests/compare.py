"""Rows of both engines in one order-insensitive form."""

import decimal

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER", "date": "DATE"}


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (str, bytes)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)) or hasattr(v, "dtype"):
        return float(f"{float(v):.9g}") if str(getattr(v, "dtype", "")) != "bool" else bool(v)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=str)
