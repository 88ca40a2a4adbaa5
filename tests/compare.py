"""Rows of a Spark query against its SQL on DuckDB, in any order."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else round(float(v), 6)
    if isinstance(v, (np.integer, np.bool_)):
        return v.item()
    return v if isinstance(v, (int, bool)) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con
