"""Spark results against DuckDB's over the same tables."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(d):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def norm(df):
    cell = lambda x: "null" if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x) else f"{x:.7g}" if isinstance(x, float) else str(x)
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


def same(spark, d, query, sql):
    ours, theirs = query(spark, d).toPandas(), connect(d).execute(sql).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert norm(ours) == norm(theirs)
