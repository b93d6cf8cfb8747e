"""Evaluation metrics from head outputs.

The only pass over the examples is the ensemble + confusion aggregate (one shuffle on
``example_id`` to gather an example's heads, then a partial/final hash aggregate to at most
K x K cells). Everything after that runs on per-class tables of K rows, K = number of classes.
Every function takes ``by``: extra grouping columns (e.g. the training step of a snapshot), so
one job evaluates many snapshots at once.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlab.functions.probs import argmax, with_logsumexp


def heads_per_example(head_logits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., example_id, label, heads)``: the example's head logits ordered by environment name."""
    return head_logits.groupBy(*by, "example_id").agg(
        F.first("label").alias("label"),
        F.array_sort(F.collect_list(F.struct("env", "logits"))).alias("heads"),
    )


def ensemble(head_logits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Logits averaged over the environment heads (``0 + l_1/E + l_2/E + ...``), and the
    top-1 prediction (first maximum)."""
    x = heads_per_example(head_logits, by)
    e = F.size("heads")
    zeros = F.array_repeat(F.lit(0.0), F.size(F.col("heads")[0]["logits"]))
    avg = F.aggregate("heads", zeros, lambda acc, h: F.zip_with(acc, h["logits"], lambda a, b: a + b / e))
    one = F.col("heads")[0]["logits"]
    logits = F.when(e == 1, one).otherwise(avg)
    out = x.select(*by, "example_id", "label", logits.alias("logits"), e.alias("n_heads"))
    return out.withColumn("pred", argmax(F.col("logits")))


def confusion(pred: DataFrame, by: Sequence[str] = (), loss: bool = False) -> DataFrame:
    """``(by..., label, pred, n)`` plus the number of classes ``n_classes`` (length of the logits);
    with ``loss`` also each cell's sum of cross-entropies ``ce`` and their number ``n_ce``."""
    aggs = [F.count(F.lit(1)).alias("n"), F.max(F.size("logits")).alias("n_classes")]
    if loss:
        pred = with_logsumexp(pred, "logits", "_lse")
        aggs += [F.sum(_cross_entropy()).alias("ce"), F.count(_cross_entropy()).alias("n_ce")]
    return pred.groupBy(*by, "label", "pred").agg(*aggs)


def _cross_entropy() -> F.Column:
    return F.col("_lse") - F.element_at(F.col("logits"), F.col("label") + 1)


def per_class(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class 0..K-1: support, predicted, tp, precision, recall, F1 (0 when undefined).

    One aggregate over the confusion cells: each cell adds its count to its label's support, its
    prediction's count and (on the diagonal) the true positives, and lists the classes
    0..K-1 with zeros so classes never seen still get a row. Sums of cross-entropies that ``conf``
    holds are carried to their label's class."""
    by = list(by)
    z = F.lit(0).cast("long")
    n = F.col("n").cast("long")
    losses = [c for c in ("ce", "n_ce") if c in conf.columns]
    none = [F.lit(None).cast(conf.schema[c].dataType).alias(c) for c in losses]
    parts = F.array(
        F.struct(F.col("label").alias("c"), n.alias("s"), z.alias("p"), F.when(F.col("label") == F.col("pred"), n).otherwise(z).alias("t"), *losses),
        F.struct(F.col("pred").alias("c"), z.alias("s"), n.alias("p"), z.alias("t"), *none),
    )
    every = F.transform(F.sequence(F.lit(0), F.col("n_classes") - 1), lambda c: F.struct(c.alias("c"), z.alias("s"), z.alias("p"), z.alias("t"), *none))
    x = conf.select(*by, F.explode(F.concat(parts, every)).alias("_e"))
    t = x.groupBy(*by, F.col("_e.c").cast("int").alias("class")).agg(
        F.sum("_e.s").alias("support"), F.sum("_e.p").alias("predicted"), F.sum("_e.t").alias("tp"),
        *[F.sum(f"_e.{c}").alias(c) for c in losses],
    )
    t = t.select(*by, "class", *[F.col(c).cast("long").alias(c) for c in ("support", "predicted", "tp")], *losses)
    return t.select(
        "*",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("recall"),
        F.when(F.col("support") + F.col("predicted") > 0, 2.0 * F.col("tp") / (F.col("support") + F.col("predicted")))
        .otherwise(0.0)
        .alias("f1"),
    )


def _avg_rank(c: str, part: Sequence[str]) -> F.Column:
    """Average (fractional) 1-based rank of ``c`` inside ``part``; ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*part).orderBy(c)) + (
        F.count(F.lit(1)).over(Window.partitionBy(*part, c)) - 1
    ) / 2.0


def _pearson(x, y, n) -> F.Column:
    den = F.stddev_samp(x) * F.stddev_samp(y)
    return F.when((n >= 3) & (den > 0), F.covar_samp(x, y) / den)


REPORT_COLUMNS = [
    "accuracy", "f1_macro", "corr_support_f1_pearson_r", "corr_support_f1_spearman_rho", "f1_head", "f1_tail",
    "gap_head_tail",
]


def eval_report(pc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: accuracy, macro F1 (classes seen in labels or predictions), Pearson and Spearman
    correlation of support with per-class F1 (classes with support > 0; NULL under three classes
    or for constant input), mean F1 of the head and tail quarter of classes by support, and
    their gap (A12, A14, A16, A17, A18); and the mean cross-entropy ``loss`` if ``pc`` carries its
    sums. The windows here run over K-row class tables."""
    by = list(by)
    k = F.count(F.lit(1)).over(Window.partitionBy(*by))
    t = pc.select(
        "*",
        k.alias("_k"),
        F.greatest(F.lit(1), F.floor(k / 4)).alias("_q"),
        F.row_number().over(Window.partitionBy(*by).orderBy("support", "class")).alias("_pos"),
        (F.col("support") > 0).alias("_present"),
    )
    t = t.select("*", _avg_rank("support", by + ["_present"]).alias("_rs"), _avg_rank("f1", by + ["_present"]).alias("_rf"))
    p = F.col("_present")
    s = F.when(p, F.col("support").cast("double"))
    n_present = F.count_if(p)
    out = t.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when((F.col("support") > 0) | (F.col("predicted") > 0), F.col("f1"))).alias("f1_macro"),
        _pearson(s, F.when(p, F.col("f1")), n_present).alias("corr_support_f1_pearson_r"),
        _pearson(F.when(p, F.col("_rs")), F.when(p, F.col("_rf")), n_present).alias("corr_support_f1_spearman_rho"),
        F.avg(F.when(F.col("_pos") > F.col("_k") - F.col("_q"), F.col("f1"))).alias("f1_head"),
        F.avg(F.when(F.col("_pos") <= F.col("_q"), F.col("f1"))).alias("f1_tail"),
        *([(F.sum("ce") / F.nullif(F.sum("n_ce"), F.lit(0))).alias("loss")] if "ce" in pc.columns else []),
    )
    return out.withColumn("gap_head_tail", F.col("f1_head") - F.col("f1_tail"))


def eval_report_extended(pc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A15 (present but disabled in the reference): balanced accuracy, support-weighted precision,
    recall and F1, and the worst recall / F1 with their class, over classes seen in labels or
    predictions."""
    seen = pc.where((F.col("support") > 0) | (F.col("predicted") > 0))
    s = F.col("support").cast("double")
    return seen.groupBy(*by).agg(
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.col("precision") * s) / F.sum(s)).alias("precision_weighted"),
        (F.sum(F.col("recall") * s) / F.sum(s)).alias("recall_weighted"),
        (F.sum(F.col("f1") * s) / F.sum(s)).alias("f1_weighted"),
        F.min("recall").alias("worst_recall"),
        F.min_by("class", F.struct("recall", "class")).alias("worst_recall_cls"),
        F.min("f1").alias("worst_f1"),
        F.min_by("class", F.struct("f1", "class")).alias("worst_f1_cls"),
    )


def eval_loss(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy of the ensemble logits."""
    x = with_logsumexp(pred.select(*by, "logits", "label"), "logits", "_lse")
    return x.groupBy(*by).agg(F.avg(_cross_entropy()).alias("loss"), F.count(F.lit(1)).alias("n_examples"))


def evaluate(head_logits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C6 in one call: the trainer's evaluation metrics per group, with the ``eval_`` prefix the
    trainer gives them, in long form ``(by..., metric, value)`` (what P11 cleans up)."""
    # one pass over the heads: the loss comes with the confusion cells
    wide = eval_report(per_class(confusion(ensemble(head_logits, by), by, loss=True), by), by)
    cols = ["loss"] + REPORT_COLUMNS
    stack = F.explode(F.array(*[F.struct(F.lit("eval_" + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]))
    return wide.select(*by, stack.alias("_m")).select(*by, "_m.metric", "_m.value")


def custom_class_metric(pc: DataFrame, fn, schema: str, by: Sequence[str] = ()) -> DataFrame:
    """H3 open hook: a user metric over the per-class table (pandas in, pandas out), run with
    ``applyInPandas`` per group; the table has K rows per group, never the examples."""
    if by:
        return pc.groupBy(*by).applyInPandas(fn, schema)
    return pc.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: fn(pdf.drop(columns=["_all"])), schema)


# Fixed values of the reference: the evaluation metrics kept in the eval log, with their prefix.
EVAL_LOG_KEEP = (
    "eval_loss", "eval_accuracy", "eval_f1_macro", "eval_corr_support_f1_pearson_r",
    "eval_corr_support_f1_spearman_rho", "eval_f1_head", "eval_f1_tail", "eval_gap_head_tail",
)


def clean_eval_metrics(metrics: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """Keep the eight ``eval_*`` metrics, strip the prefix and pivot to the eval-log row
    shape ``(step, loss, accuracy, ...)``. The pivot values are fixed, so no extra pass."""
    names = [m[len("eval_"):] for m in EVAL_LOG_KEEP]
    x = metrics.where(F.col("metric").isin(*EVAL_LOG_KEEP)).withColumn("metric", F.regexp_replace("metric", "^eval_", ""))
    return x.groupBy(*by).pivot("metric", names).agg(F.first("value"))
