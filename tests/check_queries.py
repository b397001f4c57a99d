"""Runs registered queries beside their SQL and compares rows, types and values.

    python tests/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proofspark.plans.catalog import QUERIES  # noqa: E402
from proofspark.plans.oracle import ORACLE_SQL  # noqa: E402
from proofspark.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True) if len(df) else df


def _kind(dtype) -> str:
    text = str(dtype)
    return "time" if text.startswith("datetime64") else "text" if text in ("object", "str") else text


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}"
    a, b = _sorted(ours), _sorted(theirs)
    for c in a.columns:
        if len(a) and not (a[c].isna().any()) and _kind(a[c].dtype) != _kind(b[c].dtype):
            return f"types of {c}: {a[c].dtype} and {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same[~same].index[0]
            return f"{(~same).sum()} values of {c}, first {a[c][i]!r} and {b[c][i]!r}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), oracle_connection(folder)
    spark.sparkContext.setLogLevel("ERROR")
    wrong = 0
    for name in names:
        begun = time.time()
        try:
            ours = QUERIES[name](spark, folder).toPandas()
            took = time.time() - begun
            theirs = con.execute(ORACLE_SQL[name]).df()
            found = differences(ours, theirs)
        except Exception as exc:  # noqa: BLE001
            took, ours, found = time.time() - begun, [], f"{type(exc).__name__}: {exc}"[:600]
        wrong += found is not None
        print(f"{name:28} {len(ours):7} rows {took:6.2f}s  {found or 'same'}", flush=True)
    print(f"{len(names) - wrong} of {len(names)} the same")
    return wrong


if __name__ == "__main__":
    sys.exit(main())
