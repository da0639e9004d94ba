"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from millrace_checks.fixtures import TABLES


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        Counter(tuple(_value(row[i]) for i in order) for row in rows),
    )


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def differences(df, con, sql: str, limit: int = 3) -> str | None:
    """None when columns, types and rows agree, else a description."""
    cursor = con.execute(sql)
    want_columns, want = _bag([d[0] for d in cursor.description], cursor.fetchall())
    got_columns, got = _bag(df.columns, df.collect())
    if want_columns != got_columns:
        return f"columns {got_columns} != {want_columns}"
    if got != want:
        extra = list((got - want).items())[:limit]
        lacking = list((want - got).items())[:limit]
        return f"{got.total()} rows, {want.total()} expected; extra {extra}; lacking {lacking}"
    types = [{type(v).__name__ for row in bag for v in [row[i]]} for bag in (got, want)
             for i in range(len(got_columns))]
    half = len(got_columns)
    if types[:half] != types[half:]:
        return f"value types {types[:half]} != {types[half:]}"
    return None
