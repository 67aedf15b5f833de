"""Compare every registered query with its SQL at a scale: python tests/check_oracles.py DIR"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from coordloom.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.astype({c: "float64" for c in df if str(df[c].dtype) == "Int64"})  # longs with nulls
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None: names, types, row count and exact values."""
    got, want = normal(got), normal(want)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got
             if got[c].dtype != want[c].dtype]
    if types:
        return f"types {types}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not len(got):
        return "both empty"
    unequal = [c for c in got if not ((got[c] == want[c]) | got[c].isna() & want[c].isna()).all()]
    return f"values differ in {unequal}" if unequal else None


def main(sf_dir: str, only: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sql = oracle_sql()
    for name, query in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            spent = time.time() - start
            problem = compare(got, con.execute(sql[name]).df())
            rows = len(got)
        except Exception as error:  # report and go on with the next query
            problem, rows, spent = f"{type(error).__name__}: {str(error)[:600]}", 0, 0.0
        bad += problem is not None
        print(f"{name:22s} {rows:8d} rows {spent:6.2f}s  {problem or 'equal'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
