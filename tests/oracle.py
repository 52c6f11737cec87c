"""Compares a query's rows with those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def kind(dtype: str) -> str:
    d = dtype.lower()
    if d in ("double", "float"):
        return "double"
    if any(x in d for x in ("int", "long")):
        return "int"
    if "bool" in d:
        return "bool"
    if d.startswith("decimal"):
        return "decimal"
    return "text"


def differences(df, con, sql: str) -> str:
    """Empty if both agree in names, kinds of types and rows."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = {d[0]: kind(str(d[1])) for d in got.description}
    ours = {n: kind(t) for n, t in df.dtypes}
    if ours != theirs:
        return f"types {[(n, ours[n], theirs[n]) for n in names if ours[n] != theirs[n]]}"
    a, b = rows(df.columns, df.collect()), rows(names, got.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    odd = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(odd)} of {len(a)} rows differ, as {odd[0]}" if odd else ""
