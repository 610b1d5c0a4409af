"""Each registered query beside its SQL on the same tables, as DuckDB runs it."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else float(v) if hasattr(v, "as_tuple") else v
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {df.columns} and {columns}"
    theirs, ours = rows(columns, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    only, missing = list((ours - theirs).elements()), list((theirs - ours).elements())
    return f"{sum(ours.values())} rows, {sum(theirs.values())} by SQL; only here {only[:3]}; only there {missing[:3]}" if only or missing else ""
