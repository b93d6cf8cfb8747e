"""C4 support report: how many examples per class survive gender balancing, in train and in validation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlab.operators.balance import check_balanced
from envlab.operators.support import support_table, threshold_counts, top_support


def support_report(corpus: DataFrame) -> DataFrame:
    """Train = train + dev splits, validation = test split, each balanced by gender on its own; an
    error if either has no balanced example."""
    check_balanced(corpus, {"train": F.col("split").isin("train", "dev"), "test": F.col("split") == "test"})
    train = corpus.where(F.col("split").isin("train", "dev"))
    val = corpus.where(F.col("split") == "test")
    return support_table(train, val)


def support_thresholds(corpus: DataFrame, min_train: int, min_val: int) -> DataFrame:
    return threshold_counts(support_report(corpus), min_train, min_val)


def support_top(corpus: DataFrame, n: int = 10, descending: bool = True) -> DataFrame:
    return top_support(support_report(corpus), n, "val_count", descending)
