"""Probability maths on ARRAY<DOUBLE> columns (F13, A19), as JVM higher-order functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def with_softmax(df, col: str, out: str, eps: float = EPS):
    """Add ``out`` = softmax of ``col`` (maximum subtracted, clamped from below at ``eps``).

    The maximum and the normaliser are materialised as columns first, so the per-element lambda
    reads them instead of recomputing them for every element."""
    df = df.withColumn("_sm_m", F.array_max(col))
    df = df.withColumn("_sm_e", F.transform(col, lambda x: F.exp(x - F.col("_sm_m"))))
    df = df.withColumn("_sm_z", F.aggregate("_sm_e", F.lit(0.0), lambda acc, x: acc + x))
    return df.withColumn(out, F.transform("_sm_e", lambda x: F.greatest(x / F.col("_sm_z"), F.lit(eps)))).drop(
        "_sm_m", "_sm_e", "_sm_z"
    )


def with_logsumexp(df, col: str, out: str):
    df = df.withColumn("_ls_m", F.array_max(col))
    return df.withColumn(
        out, F.col("_ls_m") + F.log(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_ls_m"))))
    ).drop("_ls_m")


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (natural log) of two clamped distributions."""
    terms = F.zip_with(
        p,
        q,
        lambda a, b: F.lit(0.5)
        * (a * (F.log(a) - F.log((a + b) * 0.5)) + b * (F.log(b) - F.log((a + b) * 0.5))),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def with_normalized(df, col: str, out: str, eps: float = EPS):
    """Add ``out`` = ``col / max(||col||, eps)`` (the norm is materialised first)."""
    df = df.withColumn("_nz_n", F.greatest(l2_norm(F.col(col)), F.lit(eps)))
    return df.withColumn(out, F.transform(col, lambda x: x / F.col("_nz_n"))).drop("_nz_n")


def pair_mean(items: str, fn) -> Column:
    """Mean of ``fn(items[i], items[j])`` over i < j, computed inside the row (the array holds one
    entry per environment head, so it is as long as the model has heads). NULL when fewer than two.

    ``items`` must name a column (not an expression): it is read once per pair, and an
    expression there would be re-evaluated on every read."""
    items = F.col(items)
    n = F.size(items)
    vals = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n - 2),
            lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: fn(F.element_at(items, i + 1), F.element_at(items, j + 1))),
        )
    )
    total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n >= 2, total / F.size(vals))
