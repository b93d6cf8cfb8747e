"""Compare a Spark result with a DuckDB result: row count, column names, order-insensitive values."""
from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


# Spark type name -> DuckDB type name
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]", "array<bigint>": "BIGINT[]"}


def type_mismatches(spark_df, con, sql: str) -> dict:
    """Columns whose Spark type and DuckDB type differ."""
    rel = con.sql(f"SELECT * FROM ({sql}) LIMIT 0")
    d = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return {c: (t, d.get(c)) for c, t in spark_df.dtypes if TYPE_NAMES.get(t, t) != d.get(c)}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits: int):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return (round(v, digits) if digits is not None else v) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    return v


def rows_of(cols, rows, digits: int | None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i], digits) for i in order) for r in rows), key=repr)


def _close(a, b, tol: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y, tol) for x, y in zip(a, b))
    return a == b


def compare(spark_df, con, sql: str, digits: int | None = None, tol: float = 0.0) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    if len(s_rows) != len(d_rows):
        return False, f"row counts differ: spark={len(s_rows)} duck={len(d_rows)}"
    if tol:
        # sort on values rounded to 6 digits, then compare within the tolerance
        key = lambda cols, rows: [r for _, r in sorted(zip(rows_of(cols, rows, 6), rows_of(cols, rows, None)), key=lambda t: repr(t[0]))]
        a, b = key(s_cols, s_rows), key(d_cols, d_rows)
        diff = [(x, y) for x, y in zip(a, b) if not _close(x, y, tol)]
    else:
        a, b = rows_of(s_cols, s_rows, digits), rows_of(d_cols, d_rows, digits)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return False, f"values differ ({len(diff)} rows), e.g. {diff[:3]}"
    return True, f"{len(s_rows)} rows match"
