"""Running a query and its SQL side by side."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    show = lambda x: "null" if x is None or x is pd.NA or x != x else f"{float(x) + 0.0:.6f}" if isinstance(x, float | np.floating) else str(x)
    return sorted(tuple(map(show, r)) for r in df[cols].itertuples(index=False))


def connection(sf_dir: Path):
    con = duckdb.connect()
    for p in sf_dir.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'").fetchall()
    return con


def same(spark, queries, sql, name: str, sf_dir: Path) -> None:
    got, expected = queries[name](spark, str(sf_dir)).toPandas(), connection(sf_dir).sql(sql[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
