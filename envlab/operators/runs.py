"""Run-history aggregation (P9, P10, A8, A10, A11, A23, T3) and the experiment grid."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.functions.names import lr_number, parse_run_name
from envlab.operators.sums import exact_mean_std


PIVOT_MAX = 1000


def parse_runs(runs: DataFrame, name: str = "run_name") -> DataFrame:
    """One row per run: parsed (algo, lr, seed, model) and ``parsed`` = all four present (P9);
    other columns of ``runs`` are kept."""
    p = parse_run_name(F.col(name))
    x = runs.select("*", p.alias("_p")).select(*runs.columns, "_p.*")
    return x.withColumn(
        "parsed", F.col("algo").isNotNull() & F.col("lr").isNotNull() & F.col("seed").isNotNull() & F.col("model").isNotNull()
    )


def _run_keys(history: DataFrame) -> list[str]:
    """Runs are told apart by ``run_id`` when the history has one (names may repeat across runs)."""
    return ["run_id", "run_name"] if "run_id" in history.columns else ["run_name"]


def run_value(history: DataFrame, summary: DataFrame | None, metric: str, strategy: str = "last",
              summary_from_history: bool = False) -> DataFrame:
    """A11 (+ S7 fallback): per run the ``last`` logged value (largest step) or the ``min`` value
    (first minimum in step order), over non-missing values; when the history holds none, the
    summary's value and step. Runs whose value is still missing are dropped (P10).

    ``history``: ([run_id,] run_name, step, metric, value); ``summary``: (same keys, metric,
    summary_value, summary_step). With ``summary_from_history`` the summary is the last logged row
    of the history itself, taken in the same single aggregate pass.
    """
    if strategy not in ("last", "min"):
        raise ValueError("strategy is 'last' or 'min'")
    keys = _run_keys(history)
    h = history.where(F.col("metric") == metric)
    valid = F.col("value").isNotNull() & ~F.isnan("value")
    # a run that is only in the summary has no history row at all: joined from both sides below
    if strategy == "last":
        best = F.max(F.when(valid, F.struct("step", "value")))
    else:
        best = F.min(F.when(valid, F.struct("value", "step")))
    aggs = [best.alias("_b")]
    if summary_from_history:
        aggs.append(F.max(F.struct("step", "value")).alias("_s"))
    x = h.groupBy(*keys).agg(*aggs)
    hv, hs = F.col("_b.value"), F.col("_b.step")
    if summary_from_history:
        sv, ss = F.col("_s.value"), F.col("_s.step")
    elif summary is not None:
        s = summary.where(F.col("metric") == metric).select(*keys, "summary_value", "summary_step")
        x = x.join(s, keys, "full")
        sv, ss = F.col("summary_value"), F.col("summary_step")
    else:
        sv, ss = F.lit(None).cast("double"), F.lit(None).cast("long")
    value = F.when(hv.isNotNull(), hv).otherwise(sv)
    step = F.when(hv.isNotNull(), hs).otherwise(ss)
    return x.select(*keys, step.alias("step"), value.alias("value")).where(F.col("value").isNotNull())


def run_table(history: DataFrame, metric: str, strategy: str = "last") -> DataFrame:
    """C8 per-run table in one pass: parsed name attributes, ``parsed`` flag, and the run's value
    and step (NULL when missing) from a single aggregate over the history."""
    keys = _run_keys(history)
    mine = F.col("metric") == metric
    valid = mine & F.col("value").isNotNull() & ~F.isnan("value")
    best = F.max(F.when(valid, F.struct("step", "value"))) if strategy == "last" else F.min(F.when(valid, F.struct("value", "step")))
    # every run counts, also one without a row of the metric
    x = history.groupBy(*keys).agg(best.alias("_b"), F.max(F.when(mine, F.struct("step", "value"))).alias("_s"))
    hv = F.col("_b.value")
    x = x.select(
        *keys,
        F.when(hv.isNotNull(), F.col("_b.step")).otherwise(F.col("_s.step")).alias("step"),
        F.when(hv.isNotNull(), hv).otherwise(F.col("_s.value")).alias("value"),
    )
    return parse_runs(x).select(*keys, "algo", "lr", "seed", "model", "parsed", "step", "value")


def kept_runs(runs: DataFrame) -> DataFrame:
    """Parsed runs that have a value (P9 + P10). Written as one predicate over the value, so the
    optimizer keeps it above the per-run aggregate (a name-only predicate would be pushed below
    it and evaluated on every history row)."""
    return runs.where(F.when(F.col("parsed"), F.col("value")).isNotNull())


def seed_aggregate(values: DataFrame, keys: Sequence[str] = ("algo", "lr", "model"), value: str = "value",
                   prefix: str = "value") -> DataFrame:
    """Count, mean and sample standard deviation over seeds per (algo, lr, model); NaN values
    are skipped like pandas; the std of a single value is NULL. The sums are exact, whatever their
    order (:func:`exact_mean_std`)."""
    x = exact_mean_std(values, keys, {"_v": F.col(value)})
    return x.select(*keys, F.col("_v_n").alias("n_seeds"), F.col("_v_mean").alias(f"mean_{prefix}"), F.col("_v_std").alias(f"std_{prefix}"))


def sort_runs(agg: DataFrame) -> DataFrame:
    """By algo, numeric lr, model."""
    return agg.orderBy("algo", lr_number(F.col("lr")), "model")


def seed_pivot(agg: DataFrame, mean_col: str, lrs: Sequence[str] | None = None) -> DataFrame:
    """A10: model x lr matrix of the mean, one row per (algo, model) (the reference's model-only
    index is ambiguous when two algorithms share a model and lr). Columns are the lr labels in
    numeric order, labels that are no number last; when not given they are read from the aggregate,
    and more than PIVOT_MAX of them are an error: a column each is no table to look at."""
    if lrs is None:
        labels = agg.select("lr").distinct().where(F.col("lr").isNotNull())
        labels = labels.orderBy(lr_number(F.col("lr")).asc_nulls_last(), "lr").limit(PIVOT_MAX + 1).collect()
        if len(labels) > PIVOT_MAX:
            raise ValueError(f"more than {PIVOT_MAX} learning rates: name the columns with lrs")
        lrs = [r[0] for r in labels]
    return agg.groupBy("algo", "model").pivot("lr", list(lrs)).agg(F.first(mean_col))


def run_totals(runs: DataFrame) -> DataFrame:
    """A23 on a :func:`run_table`: runs seen, runs whose name parsed, runs kept with a value,
    runs not parsed."""
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if("parsed").alias("n_parsed"),
        F.count_if(F.col("parsed") & F.col("value").isNotNull()).alias("n_kept"),
        F.count_if(~F.col("parsed")).alias("n_unparsed"),
    )


# Fixed values of the reference's experiment grid.
GRID_GAPS = (0.10, 0.20, 0.30, 0.40)
GRID_LRS = ("0.001", "0.0005", "0.0001")
GRID_LRS_ALT = ("0.005", "5e-05")
# (algorithm, head updates K, freeze encoder)
GRID_VARIANTS = (("elm", None, None), ("ilmg", 1, True), ("ilmg", 15, False), ("ilmg", 30, False))


def experiment_grid(spark: SparkSession, gaps=GRID_GAPS, lrs=GRID_LRS, variants=GRID_VARIANTS, seed: int = 0,
                    steps: int = 10000) -> DataFrame:
    """J8 + F11: gaps x lrs x variants with their run names. A parameter table (tens of rows)."""
    from envlab.functions.names import grid_run_name

    rows = [(float(g), str(lr), a, k, f) for g in gaps for lr in lrs for (a, k, f) in variants]
    df = spark.createDataFrame(rows, "gap double, lr string, algo string, k int, freeze boolean")
    name = F.when(
        F.col("k").isNull(), grid_run_name("algo", "gap", F.col("lr"), F.lit(seed), F.lit(steps))
    ).otherwise(grid_run_name("algo", "gap", F.col("lr"), F.lit(seed), F.lit(steps), "k", "freeze"))
    return df.withColumn("run_name", name)
