"""Run every registered query against its SQL and report differences: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    mine, theirs = ordered(mine), ordered(theirs)
    for c in mine.columns:
        off = ~((mine[c] == theirs[c]) | (mine[c].isna() & theirs[c].isna()))
        if off.any():
            at = off.idxmax()
            return f"{c}: {off.sum()} rows, first {mine[c][at]!r} and {theirs[c][at]!r}"
    return None


def main() -> None:
    import __spark_entry__ as contract
    from tests.session import session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = session()
    con = duck(sf_dir)
    sql = contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        mine = run(spark, sf_dir).toPandas()
        t1 = time.time()
        if name not in sql:
            print(f"{name:28} rows only {len(mine)} {t1 - t:.1f}s", flush=True)
            continue
        try:
            theirs = con.execute(sql[name]).fetchdf()
        except duckdb.Error as error:
            bad += 1
            print(f"{name:28} SQL fails: {error}", flush=True)
            continue
        found = differences(mine, theirs)
        bad += found is not None
        print(f"{name:28} {'ok' if found is None else 'DIFFERENT ' + found} {len(mine)} rows {t1 - t:.1f}s sql {time.time() - t1:.1f}s", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
