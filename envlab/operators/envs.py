"""Classes, groups, environment probabilities and environment assignment."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envlab.functions.draws import draw
from envlab.operators.ranking import DEFAULT_BUCKETS, draw_bucket, rank_within, rows_at_positions
from envlab.session import count_small, join_small


def class_ids(df: DataFrame, cls: str = "profession") -> DataFrame:
    """P5 + P6: ``(cls, label, grp)``: dense ids over the sorted distinct classes, and the fictive
    binary group (ids below ``C // 2`` -> 0, else 1).

    Rows without a class have no id. The numbering window sees one row per class, so its single partition is as small as the
    class list.
    """
    d = df.select(cls).where(F.col(cls).isNotNull()).distinct()
    w = Window.orderBy(cls)
    x = d.select(cls, (F.row_number().over(w) - 1).cast("int").alias("label"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_c"))
    return x.select(cls, "label", F.when(F.col("label") < F.floor(F.col("_c") / 2), 0).otherwise(1).cast("int").alias("grp"))


def env_grid(spark: SparkSession, gap: float, m: int = 2, color_p_mean: float = 0.2, val_color_p: float = 0.9) -> DataFrame:
    """F5 ("paper mode"): ``m = max(2, m)`` environments whose colouring probabilities are evenly
    spaced from ``mean - gap/2`` to ``mean + gap/2``, clamped to [0, 1]; ``p_align = 1 - p_color``.
    The validation row has ``env = 0`` and ``p_align = 1 - val_color_p``."""
    m = max(2, int(m))
    j = F.col("id")
    half = F.lit(float(gap)) / 2.0
    off = -half + j.cast("double") * (F.lit(float(gap)) / F.lit(float(m - 1)))
    p_color = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(float(color_p_mean)) + off))
    train = spark.range(m).select((j + 1).cast("int").alias("env"), p_color.alias("p_color"))
    train = train.withColumn("p_align", F.lit(1.0) - F.col("p_color"))
    val = spark.range(1).select(
        F.lit(0).alias("env"), F.lit(float(val_color_p)).alias("p_color"), (F.lit(1.0) - F.lit(float(val_color_p))).alias("p_align")
    )
    return train.unionByName(val)


def env_grid_legacy(spark: SparkSession, p1: float | None, p2: float | None, val_p: float | None = None) -> DataFrame:
    """aligned-injection probabilities given directly; validation defaults to 0.10."""
    if p1 is None or p2 is None:
        raise ValueError("legacy mode needs p1 and p2 (aligned-injection probabilities); or give gap")
    v = 0.10 if val_p is None else float(val_p)
    rows = [(1, float(p1)), (2, float(p2)), (0, v)]
    return spark.createDataFrame(rows, "env int, p_align double").withColumn(
        "p_color", F.lit(1.0) - F.col("p_align")
    ).select("env", "p_color", "p_align")


def assign_round_robin(train: DataFrame, m: int, seed: int, cls: str = "profession", key: str = "example_id",
                       buckets: int = DEFAULT_BUCKETS, by: list[str] | tuple = ()) -> DataFrame:
    """Shuffle each class by a seeded draw, then environment ``rank % m + 1``. ``by`` ranks
    independent sets apart (e.g. flagged test rows)."""
    x = train.withColumn("_d", draw(seed, "env", key))
    r = rank_within(x, [*by, cls], ["_d", key], draw_bucket("_d", buckets), name="_rr")
    return r.withColumn("env", (F.pmod(F.col("_rr"), F.lit(int(m))) + 1).cast("int")).drop("_d", "_rr")


def contiguous_env(train: DataFrame, m: int, seed: int, key: str = "example_id",
                   buckets: int = DEFAULT_BUCKETS) -> F.Column:
    """W2 + W3 as an expression: the environment (1..m) of a row of ``train`` when ``train`` is
    shuffled by a seeded draw and cut into contiguous slices of ``N // m`` rows, the last slice
    taking the remainder (not ``ntile``).

    Only the m - 1 slice boundaries are located exactly (sorting just the buckets that hold
    them); the expression compares a row's draw with those boundaries, so rows never move."""
    d = draw(seed, "shuf", key)
    m = int(m)
    cuts, n = rows_at_positions(train.withColumn("_d", d), lambda n: [j * (n // m) - 1 for j in range(1, m)] if n // m else [],
                                "_d", key, draw_bucket("_d", buckets))
    if n // m == 0:
        return F.lit(m)
    env = F.lit(1)
    for v, t in cuts:
        after = (d > F.lit(v)) | ((d == F.lit(v)) & (F.col(key) > F.lit(t)))
        env = env + after.cast("int")
    return env.cast("int")


def assign_contiguous(train: DataFrame, m: int, seed: int, key: str = "example_id",
                      buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """W2 + W3: :func:`contiguous_env` as a column ``env``."""
    return train.withColumn("env", contiguous_env(train, m, seed, key, buckets))


def shuffle_positions(train: DataFrame, seed: int, key: str = "example_id", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Exact position of every row in the global seeded shuffle (``shuffle_pos``)."""
    x = train.withColumn("_d", draw(seed, "shuf", key))
    return rank_within(x, [], ["_d", key], draw_bucket("_d", buckets), name="shuffle_pos").drop("_d")


def attach_classes(df: DataFrame, classes: DataFrame, cls: str = "profession", on_missing: str = "error",
                   rows: int | None = None) -> DataFrame:
    """Attach ``label`` and ``grp``. A class unknown to ``classes`` fails the job (the
    reference's KeyError) unless ``on_missing='drop'``; the check is an expression inside the
    same job, not a separate pass. ``rows``: the class table's size when already counted."""
    if rows is None:
        classes, n = count_small(classes)
    else:
        n = rows
    if on_missing == "error":
        j = join_small(df, classes, cls, "left", rows=n)
        msg = F.concat(F.lit("class has no id (no training rows after the split): "), F.col(cls).cast("string"))
        # a filter, so the check runs whatever columns a later step keeps (a projection could be pruned)
        return j.where(F.when(F.col("label").isNull(), F.raise_error(msg)).otherwise(F.lit(True)))
    return join_small(df, classes, cls, "inner", rows=n)
