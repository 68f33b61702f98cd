"""Holds a query against its SQL in DuckDB."""

from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of_sql(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = con.execute(sql)
    cols = [d[0] for d in r.description]
    return cols, r.fetchall()


def agree(df, sql: str, sf: str) -> None:
    cols, want = rows_of_sql(sql, sf)
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in want), key=repr)
    assert got == want
