"""Comparison of a query with its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    return str(v)


def differences(df, con, sql):
    """Rows that only one side has, as two counters; columns must agree."""
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    mine = Counter(tuple(_plain(v) for v in r) for r in df.select(*cols).collect())
    theirs = Counter(tuple(_plain(r[k]) for k in order) for r in rel.fetchall())
    return mine - theirs, theirs - mine
