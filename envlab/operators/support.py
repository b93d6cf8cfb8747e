"""Class support before and after balancing."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlab.operators.balance import gender_counts


def balanced_support(df: DataFrame, cls: str = "profession") -> DataFrame:
    """Rows per class after gender balancing: exactly ``2k``, so no sampling is needed (A3).

    Classes with ``k = 0`` are absent, as in the reference, and so are rows without a class.
    """
    return (
        gender_counts(df.where(F.col("gender").isin(0, 1)), cls)
        .where(F.col("k") > 0)
        .select(cls, (2 * F.col("k")).cast("long").alias("n"))
    )


def support_table(train: DataFrame, val: DataFrame, cls: str = "profession") -> DataFrame:
    """``(profession, train_count, val_count)`` over the classes that survive balancing in train;
    val counts default to 0 (J5)."""
    t = balanced_support(train, cls).withColumnRenamed("n", "train_count")
    v = balanced_support(val, cls).withColumnRenamed("n", "val_count")
    return t.join(v, cls, "left").select(cls, "train_count", F.coalesce("val_count", F.lit(0)).cast("long").alias("val_count"))


def threshold_counts(report: DataFrame, min_train: int, min_val: int) -> DataFrame:
    """Number of classes, and of classes under each threshold (A4)."""
    return report.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.count_if(F.col("train_count") < min_train).alias("n_low_train"),
        F.count_if(F.col("val_count") < min_val).alias("n_low_val"),
    )


def top_support(report: DataFrame, n: int = 10, col: str = "val_count", descending: bool = True, cls: str = "profession") -> DataFrame:
    """First ``n`` classes by support; ties by class name (the reference's stable sort)."""
    o = F.col(col).desc() if descending else F.col(col).asc()
    return report.orderBy(o, F.col(cls).asc()).limit(n)
