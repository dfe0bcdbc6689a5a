"""Rows of Spark and DuckDB in one comparable form."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return db


def cell(x) -> str:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    return str(x)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())


def of_sql(db: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    c = db.execute(sql)
    found = [d[0] for d in c.description]
    cols = sorted(found)
    at = [found.index(x) for x in cols]
    return cols, sorted(tuple(cell(r[i]) for i in at) for r in c.fetchall())
