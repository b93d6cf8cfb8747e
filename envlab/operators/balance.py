"""Gender balancing and test/train splitting.

Balancing keeps, in every class, ``k = min(#gender 0, #gender 1)`` rows of each gender; the kept
rows of the larger side are the ``k`` with the smallest seeded draw. Classes with ``k = 0`` vanish.
All selections go through :func:`envlab.operators.ranking.first_k`, so only key columns are
aggregated and the text never moves through a shuffle.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envlab.functions.draws import draw
from envlab.operators.ranking import DEFAULT_BUCKETS, apply_cuts, draw_bucket, first_k, first_k_cuts, flag_cuts


def gender_counts(df: DataFrame, cls: str = "profession", by: Sequence[str] = ()) -> DataFrame:
    """Per class: rows of gender 0, of gender 1 and ``k = least`` (A2). Partial + final hash aggregate.
    Rows without a class do not count, here as wherever classes do."""
    return df.where(F.col(cls).isNotNull()).groupBy(*by, cls).agg(
        F.count_if(F.col("gender") == 0).alias("n_g0"),
        F.count_if(F.col("gender") == 1).alias("n_g1"),
    ).withColumn("k", F.least("n_g0", "n_g1"))


def balance_by_gender(
    df: DataFrame,
    seed: int = 0,
    cls: str = "profession",
    key: str = "example_id",
    tag: str = "bal",
    buckets: int = DEFAULT_BUCKETS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows kept by gender balancing (A2 + W1); same columns as ``df``.

    Rows without a class or with a gender outside {0, 1} (or NULL) are never kept. ``by`` balances several
    independent sets in the same passes (e.g. train and test: classes are balanced within each).
    """
    by = list(by)
    x = df.where(F.col("gender").isin(0, 1) & F.col(cls).isNotNull()).withColumn("_draw", draw(seed, tag, key))
    ks = gender_counts(x, cls, by).select(*by, cls, F.explode(F.array(F.lit(0), F.lit(1))).alias("gender"), F.col("k").alias("_k"))
    out = first_k(x, by + [cls, "gender"], ks, "_draw", key, draw_bucket("_draw", buckets))
    return out.drop("_draw")


def check_balanced(df: DataFrame, sets: Mapping[str, Column], cls: str = "profession") -> None:
    """Raise if balancing leaves nothing in one of the ``sets`` (name: condition), each of which is balanced
    on its own. One aggregate over ``df``."""
    flags = F.array(*[F.when(cond, F.lit(name)) for name, cond in sets.items()])
    each = df.withColumn("_set", F.explode(F.array_compact(flags)))
    found = {r[0] for r in gender_counts(each, cls, ["_set"]).where("k > 0").select("_set").distinct().collect()}
    for name in sets:
        if name not in found:
            raise ValueError(f"no gender-balanced example found in {name}: check the gender labels")


def class_k(pool: DataFrame, k_target: int, cls: str = "profession") -> DataFrame:
    """Per class: ``K_eff = min(K, smallest class count)`` (A5), one row per class.

    The minimum runs over the per-class count table, whose size is the number of classes.
    """
    counts = pool.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    smallest = F.min("n").over(Window.partitionBy())
    return counts.select(cls, "n", F.least(F.lit(int(k_target)).cast("long"), smallest).alias("k_eff"))


def _test_cuts(pool: DataFrame, k_target: int, seed: int, cls: str, key: str, stratify: bool, buckets: int):
    x = pool.withColumn("_draw", draw(seed, "test", key))
    keff = class_k(pool, k_target, cls)
    if stratify:
        keys = [cls, "gender"]
        ks = keff.select(cls, F.explode(F.array(F.lit(0), F.lit(1))).alias("gender"), F.floor(F.col("k_eff") / 2).alias("_k"))
    else:
        keys = [cls]
        ks = keff.select(cls, F.col("k_eff").alias("_k"))
    cuts, n = first_k_cuts(x, keys, ks, "_draw", key, draw_bucket("_draw", buckets))
    return x, keys, cuts, n, keff


def flag_test_rows(pool: DataFrame, k_target: int, seed: int = 0, cls: str = "profession", key: str = "example_id",
                   stratify: bool = False, buckets: int = DEFAULT_BUCKETS, with_train_classes: bool = False):
    """Builder B split as a flag: ``_test`` is true for the ``K_eff`` test rows of each class
    (same rows as :func:`split_test_train`), so one pass can produce both parts.

    With ``with_train_classes`` also returns the classes left with training rows (those with
    more rows than ``K_eff``), read off the per-class counts instead of another pass."""
    if int(k_target) <= 0:
        raise ValueError("cannot build a balanced test set: k_test_per_class must be positive")
    x, keys, cuts, n, keff = _test_cuts(pool, k_target, seed, cls, key, stratify, buckets)
    flagged = flag_cuts(x, keys, cuts, n, "_draw", key, "_test").drop("_draw")
    if not with_train_classes:
        return flagged
    if stratify:
        train_classes = flagged.where(~F.col("_test")).select(cls)
    else:
        train_classes = keff.where(F.col("n") > F.col("k_eff")).select(cls)
    return flagged, train_classes


def split_test_train(
    pool: DataFrame,
    k_target: int,
    seed: int = 0,
    cls: str = "profession",
    key: str = "example_id",
    stratify: bool = False,
    buckets: int = DEFAULT_BUCKETS,
) -> tuple[DataFrame, DataFrame]:
    """Builder B split (A5 + W10 + J4): ``K_eff`` test rows per class, the rest is train.

    Default follows the reference code: the K test rows are drawn regardless of gender.
    ``stratify=True`` follows its docstring instead: K/2 of each gender.
    """
    x, keys, cuts, n, _ = _test_cuts(pool, k_target, seed, cls, key, stratify, buckets)
    test = apply_cuts(x, keys, cuts, n, "_draw", key, keep="first").drop("_draw")
    train = apply_cuts(x, keys, cuts, n, "_draw", key, keep="rest").drop("_draw")
    return test, train
