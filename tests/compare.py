"""Run catalog queries in Spark and DuckDB and compare: names, types, rows."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (float, np.floating)):
            return repr(int(v) if np.isfinite(v) and v == int(v) else float(v))  # whole numbers beside missing ones are floats in pandas
        return repr(int(v)) if isinstance(v, (int, np.integer)) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def difference(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(duck_df.columns)}"
    if len(spark_df) != len(duck_df):
        return f"rows {len(spark_df)} / {len(duck_df)}"
    kinds = [(c, spark_df[c].dtype.kind, duck_df[c].dtype.kind) for c in spark_df.columns
             if spark_df[c].notna().all() and spark_df[c].dtype.kind != duck_df[c].dtype.kind
             and not {spark_df[c].dtype.kind, duck_df[c].dtype.kind} <= {"O", "U", "T"}]
    if kinds and len(spark_df):
        return f"types {kinds}"
    a, b = canonical(spark_df), canonical(duck_df)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first: {bad[0][0]} / {bad[0][1]}"
    return None


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from flowsift.session import local_session

    spark, con = local_session(8), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            problem = difference(got, con.execute(sql[name]).df()) if name in sql else None
        except Exception as error:
            took, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
            got = []
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:28s} rows={len(got):7d} {took:6.2f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
