"""Learning-curve aggregation over runs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlab.operators.sums import exact_mean_std

# Fixed values of the reference: learning rates kept, and the default metrics.
TARGET_LRS = (1e-3, 5e-4, 1e-4)
DEFAULT_METRICS = ("accuracy", "f1_macro", "f1_head", "f1_tail", "gap_head_tail")


def keep_target_lrs(df: DataFrame, lrs: Sequence[float] = TARGET_LRS) -> DataFrame:
    """Exact equality is safe, both sides parse the same literals to doubles."""
    return df.where(F.col("lr").isin(*[float(x) for x in lrs]))


def select_metrics(requested: Sequence[str], available: Sequence[str]) -> list[str]:
    """Requested metrics that exist in at least one log; error when none."""
    out = [m for m in requested if m in set(available)]
    if not out:
        raise ValueError(f"none of the requested metrics {list(requested)} is present in the logs")
    return out


def curve_summary(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("lr", "step")) -> DataFrame:
    """A9 + J6: mean and sample std of every metric by (lr, step) in one aggregate (the reference
    groups once per metric and merges mean with std). NaN is skipped; a group with no value has
    NULL mean; std of one value is NULL. ``keys`` may add grouping columns (Q9). The sums are
    exact (:func:`exact_mean_std`), so the curves are reproducible run to run."""
    x = exact_mean_std(df, keys, {m: F.col(m) for m in metrics})
    return x.select(*keys, *[c for m in metrics for c in (F.col(f"{m}_mean").alias(m), F.col(f"{m}_std"))])


def per_metric(summary: DataFrame, metric: str, keys: Sequence[str] = ("lr", "step")) -> DataFrame:
    """K6 shape: (lr, step, metric, metric_std) sorted by (lr, step) (T5)."""
    return summary.select(*keys, metric, f"{metric}_std").orderBy(*keys)
