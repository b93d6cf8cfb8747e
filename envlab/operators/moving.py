"""Trailing moving average of training losses (W5), skew-safe.

``avg over (partition by run order by step rows between 19 preceding and current row)`` puts a
whole run into one task. Here each run is cut into blocks of consecutive positions; each block
also receives copies of the previous block's last ``window - 1`` rows (a halo), so every window
frame lies inside one (run, block) partition of at most ``block + window - 1`` rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 20
BLOCK = 4096


def moving_average(df: DataFrame, key: str, pos: str, value: str, out: str, window: int = WINDOW,
                   block: int = BLOCK) -> DataFrame:
    """Mean of the last ``window`` values up to each row (fewer while the run is filling).

    ``pos`` must be the dense 0-based position inside the run (e.g. from ``rank_within``)."""
    if block < window:
        raise ValueError("block must be at least the window")
    own = F.floor(F.col(pos) / block).cast("long")
    in_tail = F.pmod(F.col(pos), F.lit(block)) >= block - (window - 1)
    # one read: a row goes to its own block, and a block's last rows to the next block as well
    x = df.withColumn("_own", own).withColumn("_blk", F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(key, "_blk").orderBy(pos).rowsBetween(-(window - 1), 0)
    return x.withColumn(out, F.avg(value).over(w)).where(F.col("_own").eqNullSafe(F.col("_blk"))).drop("_own", "_blk")


def log_cadence(df: DataFrame, step: str = "step", every: int = 100) -> DataFrame:
    """Rows logged every ``every`` steps (applied after the moving average)."""
    return df.where(F.pmod(F.col(step), F.lit(int(every))) == 0)
