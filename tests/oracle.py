"""Runs queries next to their SQL and compares the rows."""

import os

import duckdb
import numpy as np


def connect(sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def differences(spark, con, query, sql: str, sf: str) -> str:
    """What differs between the rows of both, or ''."""
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    names = sorted(got.columns)
    if names != sorted(want.columns):
        return f"columns {names} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    sides = []
    for df in (got, want):
        df = df[names].copy()
        for c in names:
            if df[c].dtype == object and df[c].map(lambda v: isinstance(v, (int, float, np.number)) or v is None).all() and not df[c].map(lambda v: isinstance(v, bool)).any():
                df[c] = df[c].astype(float)
            elif str(df[c].dtype)[:3] in ("int", "Int", "flo", "Flo", "UIn", "uin"):
                df[c] = df[c].astype(float)
        keys = df.map(lambda v: "" if v is None or v != v else str(v))
        sides.append(keys.sort_values(names).reset_index(drop=True))
    if sides[0].equals(sides[1]):
        return ""
    wrong = (sides[0] != sides[1]).any(axis=1)
    return f"{int(wrong.sum())} of {len(got)} rows differ, as {sides[0][wrong].head(2).to_dict('records')} and {sides[1][wrong].head(2).to_dict('records')}"
