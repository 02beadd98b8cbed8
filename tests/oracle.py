"""Spark results against DuckDB on the same files."""

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connection(sf: str = SF):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.values.tolist()), key=repr)


def same(spark_df, sql: str, sf: str = SF) -> None:
    got, want = spark_df.toPandas(), connection(sf).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
