"""Running a registered query and its SQL side by side."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")


def sql_rows(sql: str, folder: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con.sql(sql).df()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    return sorted((tuple(plain(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


def assert_same(spark, query, sql: str, folder: str = DATA) -> None:
    ours, theirs = query(spark, folder).toPandas(), sql_rows(sql, folder)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
