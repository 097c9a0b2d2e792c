"""Compares a registered query with its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    try:
        return float(v) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(map(_plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


def sql_rows(sql: str, folder: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = con.sql(sql).df()
    return sorted(got.columns), rows(got)


def check(spark, query, sql: str, folder: str = DATA) -> None:
    got = query(spark, folder).toPandas()
    columns, wanted = sql_rows(sql, folder)
    assert sorted(got.columns) == columns
    assert rows(got) == wanted
