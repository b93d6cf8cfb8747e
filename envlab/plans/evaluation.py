"""C6 evaluation report and C7 head-divergence report over head outputs (D4) and weights."""
from __future__ import annotations

from pyspark.sql import DataFrame

from envlab.operators import heads as H
from envlab.operators import metrics as M


def predictions(head_logits: DataFrame) -> DataFrame:
    return M.ensemble(head_logits)


def evaluation_tables(head_logits: DataFrame) -> dict[str, DataFrame]:
    """All C6 outputs from one ensemble pass (persist the confusion table when several are used)."""
    pred = M.ensemble(head_logits)
    conf = M.confusion(pred)
    pc = M.per_class(conf)
    return {
        "predictions": pred,
        "confusion": conf,
        "per_class": pc,
        "report": M.eval_report(pc),
        "extended": M.eval_report_extended(pc),
        "loss": M.eval_loss(pred),
    }


def divergence_report(head_logits: DataFrame) -> DataFrame:
    """C7 for one evaluation: prediction divergence (weights have steps, see :func:`heads_report`)."""
    return H.prediction_divergence(head_logits)


def heads_report(head_weights: DataFrame, head_logits_by_step: DataFrame) -> DataFrame:
    """C7 over training: the compacted heads log, one row per step."""
    log = H.heads_log(H.weight_divergence(head_weights), H.prediction_divergence(head_logits_by_step, group="step"))
    return H.compact_heads_log(log)
