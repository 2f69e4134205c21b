"""Compare a query with its SQL in DuckDB as sets of rows, columns sorted by name."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = os.environ.get("LOREKEEP_DATA", "/root/testdata")


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    return x


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(sql: str, sf: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA, sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), Counter(tuple(plain(row[i]) for i in at) for row in cur.fetchall())


def compare(df, sql: str, sf: str) -> None:
    names, want = duck_rows(sql, sf)
    assert sorted(df.columns) == names
    got = spark_rows(df)
    assert got == want, f"only here {list((got - want).items())[:5]}, only in SQL {list((want - got).items())[:5]}"
