"""Compares a query's rows with what DuckDB makes of its SQL, column by column and without regard to order."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))


def compared(spark, name: str, query, sql: str, folder: str):
    own, other = query(spark, folder).toPandas(), duck(folder).sql(sql).df()
    assert sorted(own.columns) == sorted(other.columns), name
    assert rows(own) == rows(other), name
