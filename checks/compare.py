"""Run queries and their SQL side by side: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from shoplens.session import build_session, release


def plain_rows(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as comparable tuples, columns by name, in a fixed order."""
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return x.item() if hasattr(x, "item") else x

    rows = [tuple(cell(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def differences(spark, con, folder: str, name: str) -> str:
    """Empty when both sides agree."""
    got = QUERIES[name](spark, folder)
    mine = got.toPandas()
    release()
    if name not in ORACLES:
        return "" if len(mine) else "no rows"
    theirs = con.sql(ORACLES[name]).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    kinds = {c: (mine[c].dtype, theirs[c].dtype) for c in mine if mine[c].dtype.kind != theirs[c].dtype.kind
             or mine[c].dtype.itemsize != theirs[c].dtype.itemsize}
    if kinds:
        return f"types {kinds}"
    a, b = plain_rows(mine), plain_rows(theirs)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), ("", ""))
        return f"{len(a)} vs {len(b)} rows; first difference {str(first)[:600]}"
    return ""


def main() -> None:
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, con, folder, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        sql = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {sql:4} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
