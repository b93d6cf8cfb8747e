"""Seeded, partition-independent random draws.

``draw(seed, tag, *keys)`` is a uniform number in [0, 1) that depends only on its arguments:
the first 32 bits of ``md5("seed|tag|key1|key2...")`` divided by 2**32. It is the same on
every executor, for every partitioning and after a task retry, and it can be written in plain
SQL, so sampling operators stay exactly checkable. Each use takes its own ``tag`` so that
draws for different decisions on the same row are independent.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    return F.col(k).cast("string")


def draw(seed: int, tag: str, *keys) -> Column:
    """Uniform [0, 1) draw keyed by ``seed``, ``tag`` and the given columns (names or Columns)."""
    s = F.concat_ws("|", F.lit(str(int(seed))), F.lit(tag), *[_as_col(k) for k in keys])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def draw_sql(seed: int, tag: str, *key_sql: str) -> str:
    """The same draw as a Spark SQL expression string (for ``F.expr`` inside lambdas)."""
    parts = ", ".join([f"'{int(seed)}'", f"'{tag}'"] + [f"CAST({k} AS STRING)" for k in key_sql])
    return f"(CAST(conv(substring(md5(concat_ws('|', {parts})), 1, 8), 16, 10) AS DOUBLE) / {TWO_POW_32})"
