"""Divergence between environment heads (A20, A21, J7, W9) and heads-log compaction.

Pairs of heads (i < j) are formed *inside* a row: an example's (or a step's) heads are gathered
into one array, as long as the model has heads, and the pairwise means are computed with
higher-order functions. No self-join and no pair rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlab.operators.ranking import rank_within
from envlab.functions.probs import argmax, dot, js_divergence, l2_distance, pair_mean, with_normalized, with_softmax

EVAL_BATCH = 64


def prediction_divergence(head_logits: DataFrame, max_batches: int | None = None, batch_size: int = EVAL_BATCH,
                          group: str | None = None) -> DataFrame:
    """Mean over evaluation batches of the per-batch mean (over examples, then over head
    pairs) Jensen-Shannon divergence and top-1 disagreement.

    Batches follow ``example_id`` order; all count unless ``max_batches`` asks for the first so many.
    With ``group`` (e.g. a step), the same is done per group. NULL when fewer than two heads.
    """
    keys = [group] if group else []
    src = head_logits.select(*keys, "example_id", "env", "logits")
    probs = with_softmax(src, "logits", "p")
    per_ex = probs.groupBy(*keys, "example_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("env", "p"))), lambda h: h["p"]).alias("ps")
    )
    per_ex = per_ex.withColumn("top", F.transform("ps", argmax))
    x = per_ex.select(
        *keys,
        "example_id",
        pair_mean("ps", js_divergence).alias("js"),
        pair_mean("top", lambda a, b: (a != b).cast("double")).alias("dis"),
    )
    # exact positions without a whole group in one task: buckets of 4096 ids, summed 4096 at a time
    ids = [F.floor(F.col("example_id") / (1 << bits)).cast("long") for bits in (12, 24, 36)]
    x = rank_within(x, keys, ["example_id"], ids[0], name="_pos", coarser=ids[1:])
    if max_batches is not None:
        x = x.where(F.col("_pos") < int(max_batches) * int(batch_size))
    b = x.groupBy(*keys, F.floor(F.col("_pos") / batch_size).alias("_batch")).agg(
        F.avg("js").alias("js"), F.avg("dis").alias("dis")
    )
    return b.groupBy(*keys).agg(F.avg("js").alias("js_mean"), F.avg("dis").alias("disagree_mean"))


def weight_divergence(head_weights: DataFrame) -> DataFrame:
    """Per step, mean over head pairs of the L2 distance and of ``1 - cosine`` of the
    flattened head weights. NULL when a step has fewer than two heads."""
    w = with_normalized(head_weights.select("step", "env", "w"), "w", "wn")
    per_step = w.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("env", "w", "wn"))).alias("heads"))
    per_step = per_step.select("step", F.transform("heads", lambda h: h["w"]).alias("ws"),
                               F.transform("heads", lambda h: h["wn"]).alias("ns"))
    return per_step.select(
        "step",
        pair_mean("ws", l2_distance).alias("l2_mean"),
        pair_mean("ns", lambda a, b: F.lit(1.0) - dot(a, b)).alias("cosine_mean"),
    )


HEADS_COLS = ["l2_mean", "cosine_mean", "js_mean", "disagree_mean"]


def heads_log(weight_div: DataFrame, pred_div: DataFrame) -> DataFrame:
    """The heads log as the reference writes it: per step, a weights row and a predictions row,
    each with the other half empty (K7)."""
    a = weight_div.select("step", "l2_mean", "cosine_mean", F.lit(None).cast("double").alias("js_mean"),
                          F.lit(None).cast("double").alias("disagree_mean"))
    b = pred_div.select("step", F.lit(None).cast("double").alias("l2_mean"), F.lit(None).cast("double").alias("cosine_mean"),
                        "js_mean", "disagree_mean")
    return a.unionByName(b)


def compact_heads_log(log: DataFrame) -> DataFrame:
    """One row per step from the half-empty rows (partial + final aggregate on ``step``)."""
    return log.groupBy("step").agg(*[F.max(c).alias(c) for c in HEADS_COLS])


def step_logits(head_weights: DataFrame, n_examples: int = 8) -> DataFrame:
    """Per-step head outputs read off the weight snapshots: head ``env`` at ``step`` gives example
    ``k`` the logits ``w[k*C : (k+1)*C]`` with ``C = len(w) / n_examples`` (fixture for the
    per-step prediction half of the heads log)."""
    c = F.floor(F.size("w") / n_examples).cast("int")
    x = head_weights.select("step", "env", "w", F.explode(F.sequence(F.lit(0), F.lit(n_examples - 1))).alias("example_id"))
    return x.select("step", "env", F.col("example_id").cast("long"), F.slice("w", F.col("example_id").cast("int") * c + 1, c).alias("logits"))
