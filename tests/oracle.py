"""Holds a query against its SQL in DuckDB, rows as multisets and numbers to five digits."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5)
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def check(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
