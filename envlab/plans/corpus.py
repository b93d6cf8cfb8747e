"""Corpus builders: C1 (builder A), C2 (builder B) and C3 (toy letters).

Each builder returns a :class:`Corpus` whose ``lines`` are ``(env, example_id, text, labels)``
for the training environments (``env = "env_1" .. "env_m"``) and the out-of-distribution
validation set (``env = "val"``) together: the text is read once, by one scan, whatever is
written. ``train`` / ``val`` are the two parts; ``pooled`` (the "ERM" file) is ``train`` without its
environment, in a seeded shuffle order. Write them with :mod:`envlab.plans.jobs`.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.functions.draws import draw
from envlab.functions.text import inject_prefix, toy_text
from envlab.operators.balance import balance_by_gender, check_balanced, flag_test_rows
from envlab.operators.envs import (
    assign_round_robin,
    attach_classes,
    class_ids,
    contiguous_env,
    env_grid,
    env_grid_legacy,
)
from envlab.operators.ranking import draw_bucket, rank_within
from envlab.session import count_small, join_small

LINE_COLS = ["env", "example_id", "text", "labels"]


@dataclass
class Corpus:
    lines: DataFrame
    classes: DataFrame | None
    grid: DataFrame
    seed: int

    @property
    def train(self) -> DataFrame:
        return self.lines.where(F.col("env") != "val")

    @property
    def val(self) -> DataFrame:
        return self.lines.where(F.col("env") == "val")

    def pooled_sorted(self) -> DataFrame:
        """K2 as written: all training lines sorted by the seeded shuffle key (one range-partitioned
        sort, no position numbers needed)."""
        x = self.train.withColumn("_d", draw(self.seed, "erm", "env", "example_id"))
        return x.orderBy("_d", "env", "example_id").select("example_id", "text", "labels")

    @property
    def pooled(self) -> DataFrame:
        """All training lines, with ``erm_pos`` from a seeded global shuffle (T4)."""
        x = self.train.withColumn("_d", draw(self.seed, "erm", "env", "example_id"))
        r = rank_within(x, [], ["_d", "env", "example_id"], draw_bucket("_d"), name="erm_pos")
        return r.select("erm_pos", "example_id", "text", "labels")


def _env_name(c) -> F.Column:
    return F.concat(F.lit("env_"), c.cast("string"))


def _inject(rows: DataFrame, grid: DataFrame, seed: int, n_envs: int) -> DataFrame:
    """J2 + F3: attach the environment's aligned probability (a table of ``n_envs + 1`` rows) and
    inject the prefixes."""
    x = join_small(rows, grid.select("env", "p_align"), "env", rows=n_envs + 1)
    return x.select(
        F.when(F.col("env") == 0, F.lit("val")).otherwise(_env_name(F.col("env"))).alias("env"),
        "example_id",
        inject_prefix("text", "grp", "p_align", "example_id", seed).alias("text"),
        F.col("label").alias("labels"),
    )


def build_corpus_a(
    spark: SparkSession,
    corpus: DataFrame,
    gap: float | None = None,
    m: int = 2,
    color_p_mean: float = 0.2,
    val_color_p: float = 0.9,
    p1: float | None = None,
    p2: float | None = None,
    val_p: float | None = None,
    seed: int = 0,
    on_missing: str = "error",
    check: bool = True,
) -> Corpus:
    """Balance train+dev and test separately; ids from the balanced train classes;
    one global shuffle cut into contiguous environments; validation = balanced test. An error if
    either has no balanced example (``check=False`` leaves that out).

    Balancing, class ids and the slice boundaries are passes over key columns; the lines are
    then produced by one scan with map-side filters and broadcast lookups only."""
    if check:
        check_balanced(corpus, {"train": F.col("split").isin("train", "dev"), "test": F.col("split") == "test"})
    # train+dev and test are balanced separately, in the same passes
    sets = corpus.withColumn("_set", F.when(F.col("split") == "test", F.lit("test")).otherwise(F.lit("train")))
    both = balance_by_gender(sets.where(F.col("split").isin("train", "dev", "test")), seed, by=["_set"])
    train = both.where(F.col("_set") == "train")
    grid = env_grid(spark, gap, m, color_p_mean, val_color_p) if gap is not None else env_grid_legacy(spark, p1, p2, val_p)
    n_env = max(2, int(m)) if gap is not None else 2
    classes, n_cls = count_small(class_ids(train))
    env = F.when(F.col("_set") == "test", F.lit(0)).otherwise(contiguous_env(train, n_env, seed))
    rows = attach_classes(both.withColumn("env", env).drop("_set"), classes, on_missing=on_missing, rows=n_cls)
    return Corpus(_inject(rows, grid, seed, n_env), classes, grid, seed)


def build_corpus_b(
    spark: SparkSession,
    corpus: DataFrame,
    gap: float = 0.40,
    m: int = 2,
    color_p_mean: float = 0.2,
    val_color_p: float = 0.9,
    k_test_per_class: int = 250,
    seed: int = 0,
    stratify_test: bool = False,
    on_missing: str = "error",
) -> Corpus:
    """Pool all splits, balance by gender, take ``K_eff`` test rows per class, the rest is
    train; environments by per-class round robin.

    The test rows are flagged (not split off), so the pooled rows are scanned once and shuffled
    once, for the round-robin rank."""
    check_balanced(corpus, {"the corpus": F.lit(True)})
    pool = balance_by_gender(corpus, seed)
    flagged, train_classes = flag_test_rows(pool, k_test_per_class, seed, stratify=stratify_test, with_train_classes=True)
    m = max(2, int(m))
    grid = env_grid(spark, gap, m, color_p_mean, val_color_p)
    classes, n_cls = count_small(class_ids(train_classes))
    rr = assign_round_robin(flagged, m, seed, by=["_test"])
    rows = rr.withColumn("env", F.when(F.col("_test"), F.lit(0)).otherwise(F.col("env"))).drop("_test")
    rows = attach_classes(rows, classes, on_missing=on_missing, rows=n_cls)
    return Corpus(_inject(rows, grid, seed, m), classes, grid, seed)


def build_toy(
    spark: SparkSession,
    gap: float,
    n_train_per_env: int = 20000,
    n_val: int = 5000,
    m: int = 2,
    color_p_mean: float = 0.2,
    val_color_p: float = 1.0,
    seed: int = 0,
) -> Corpus:
    """C3 (S8 + F4): per environment ``n // 2`` pairs (y = 0, y = 1) of one-letter texts with a
    spurious prefix; validation likewise with ``p_align = 1 - val_color_p``. Rows come from
    ``spark.range`` (distributed); the shuffle position inside each environment is ``pos``."""
    m = max(2, int(m))
    grid = env_grid(spark, gap, m, color_p_mean, val_color_p)
    n_pairs = int(n_train_per_env) // 2
    rows = spark.range(2 * n_pairs).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(m))).alias("env"))
    val_rows = spark.range(2 * (int(n_val) // 2)).select(F.col("id"), F.lit(0).alias("env"))
    allrows = join_small(rows.unionByName(val_rows), grid.select("env", "p_align"), "env", rows=m + 1)
    y = F.pmod(F.col("id"), F.lit(2)).cast("int")
    key = F.concat_ws(":", F.col("env").cast("string"), F.col("id").cast("string"))
    x = allrows.select(
        F.when(F.col("env") == 0, F.lit("val")).otherwise(_env_name(F.col("env"))).alias("env"),
        F.col("id").alias("example_id"),
        toy_text(y, "p_align", key, seed).alias("text"),
        y.alias("labels"),
        draw(seed, "toyshuf", key).alias("_d"),
    )
    r = rank_within(x, ["env"], ["_d", "example_id"], draw_bucket("_d"), name="pos").drop("_d")
    return Corpus(r, None, grid, seed)
