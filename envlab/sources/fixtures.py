"""Stand-in views over the driver tables (see FIXTURES.md). All are lazy and deterministic."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from envlab.operators.ranking import rank_within
from envlab.session import materialize

# Fixed values of the run_history fixture (FIXTURES.md)
ALGOS = ["elm", "ilm", "ilmg"]
HISTORY_LRS = ["1e-3", "5e-4", "1e-4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus (D1): profession = source, gender = n_chars % 2, split from floor(doc_id / 20) % 10."""
    d = table(spark, sf_dir, "documents")
    bucket = F.pmod(F.floor(F.col("doc_id") / 20), F.lit(10))
    split = F.when(bucket < 7, "train").when(bucket == 7, "dev").otherwise("test")
    return d.select(
        F.col("doc_id").alias("example_id"),
        F.col("text"),
        F.col("source").alias("profession"),
        F.pmod(F.col("n_chars"), F.lit(2)).cast("int").alias("gender"),
        split.alias("split"),
    )


def bios_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bios`` joined to ``labels``, gender coded as strings from ``toxic``."""
    b = bios(spark, sf_dir).drop("gender")
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "female").otherwise("male").alias("gender")
    )
    return b.join(lab, b.example_id == lab.doc_id, "inner").drop("doc_id")


def head_logits(spark: SparkSession, sf_dir: str, n_envs: int = 3, n_classes: int = 10, binary: bool = False) -> DataFrame:
    """Head outputs (D4) from ``embeddings``: one row per (example, environment head)."""
    e = table(spark, sf_dir, "embeddings")
    label = (F.col("label") % 2) if binary else F.col("label")
    c_n = 2 if binary else n_classes
    envs = e.select("vec_id", "embedding", label.cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(n_envs - 1))).alias("e"))
    logits = F.expr(
        f"transform(sequence(0, {c_n - 1}), c -> 4.0D * CAST(embedding[pmod(3 * c + e, 64)] AS DOUBLE)"
        " + IF(c = label AND pmod(vec_id, 3) <> 0, 2.0D, 0.0D))"
    )
    return envs.select(
        F.col("vec_id").alias("example_id"),
        F.concat(F.lit("env_"), (F.col("e") + 1).cast("string")).alias("env"),
        logits.alias("logits"),
        F.col("label"),
    )


def head_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head weight snapshots (D5): step = vec_id div 3, env = env_{vec_id % 3 + 1}; the last step
    may have fewer heads."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 3).cast("long").alias("step"),
        F.concat(F.lit("env_"), (F.pmod(F.col("vec_id"), F.lit(3)) + 1).cast("string")).alias("env"),
        F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("w"),
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``step`` = 0-based position of the event in its user's (ts, event_id) order.

    Ranked with one-minute buckets, so one very active user is spread over many tasks.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(60_000_000)).cast("long")
    return rank_within(ev, ["user_id"], ["ts", "event_id"], bucket, name="step")


def run_name_expr() -> F.Column:
    """Run names of the run_history fixture, with the accepted and rejected spellings."""
    u = F.col("user_id")
    algo = F.element_at(F.array(*[F.lit(a) for a in ALGOS]), (F.pmod(u, F.lit(3)) + 1).cast("int"))
    lr = F.element_at(F.array(*[F.lit(x) for x in HISTORY_LRS]), (F.pmod(F.floor(u / 3), F.lit(3)) + 1).cast("int"))
    seed = F.pmod(u, F.lit(5)).cast("string")
    model = (F.lit(5000) * (F.pmod(u, F.lit(4)) + 1)).cast("long")
    seed_part = (
        F.when(F.pmod(u, F.lit(13)) == 5, F.concat(F.lit("-seed-"), seed))
        .when(F.pmod(u, F.lit(7)) == 3, F.concat(F.lit("-seed"), seed))
        .otherwise(F.concat(F.lit("-seed_"), seed))
    )
    model_part = F.when(
        F.pmod(u, F.lit(5)) == 2, F.concat(F.lit("-model "), F.floor(model / 1000).cast("string"), F.lit(" 000"))
    ).otherwise(F.concat(F.lit("-model-"), model.cast("string")))
    name = F.concat(F.lit("eval-"), algo, F.lit("-lr_"), lr, seed_part, model_part)
    return F.when(F.pmod(u, F.lit(17)) == 0, F.concat(F.lit("baseline-"), u.cast("string"))).otherwise(name)


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run history (D7) in long form: (run_id, run_name, step, metric, value); value NULL when
    event_id % 11 = 0. ``run_id`` is the user (the tracker's run id): names repeat across runs."""
    s = event_steps(spark, sf_dir)
    return s.select(
        F.col("user_id").alias("run_id"),
        run_name_expr().alias("run_name"),
        F.col("step"),
        F.lit("ood_perplexity").alias("metric"),
        F.when(F.pmod(F.col("event_id"), F.lit(11)) == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
    )


def run_summary(history: DataFrame) -> DataFrame:
    """Tracker summary per (run, metric): the last logged value (possibly NULL) and its step."""
    last = F.max_by(F.struct("value", "step"), F.col("step"))
    return history.groupBy("run_id", "run_name", "metric").agg(
        last.getField("value").alias("summary_value"), F.max("step").alias("summary_step")
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log rows (D6): run = user_id, step, train_loss = value."""
    s = event_steps(spark, sf_dir)
    return s.select(F.col("user_id").alias("run"), F.col("step"), F.col("value").alias("train_loss"))


__all__ = [
    "table",
    "bios",
    "bios_str",
    "head_logits",
    "head_weights",
    "event_steps",
    "run_history",
    "run_summary",
    "train_log",
]


# Fixed values of the eval-log fixture (FIXTURES.md "eval_logs")
EVAL_GAPS = [0.10, 0.20, 0.30, 0.40]
EVAL_LRS = ["0.001", "0.0005", "0.0001"]
EVAL_LR_OUTSIDE = "0.005"
EVAL_KS = [1, 15, 30]


def eval_runs(events: DataFrame) -> DataFrame:
    """Per user of ``events``: algo, gap, lr label, seed, K and freeze of a simulated run.
    User 1 gets a learning rate outside the target set."""
    u = F.col("user_id")
    users = events.select("user_id").distinct()
    algo = F.element_at(F.array(*[F.lit(a) for a in ALGOS]), (F.pmod(u, F.lit(3)) + 1).cast("int"))
    gap = F.element_at(F.array(*[F.lit(g) for g in EVAL_GAPS]), (F.pmod(F.floor(u / 3), F.lit(4)) + 1).cast("int"))
    lr = F.when(u == 1, F.lit(EVAL_LR_OUTSIDE)).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in EVAL_LRS]), (F.pmod(F.floor(u / 12), F.lit(3)) + 1).cast("int"))
    )
    k = F.when(algo == "ilmg", F.element_at(F.array(*[F.lit(x) for x in EVAL_KS]), (F.pmod(F.floor(u / 36), F.lit(3)) + 1).cast("int")))
    return users.select(
        "user_id", algo.alias("algo"), gap.alias("gap"), lr.alias("lr"), F.pmod(u, F.lit(5)).cast("int").alias("seed"),
        k.alias("k"), F.when(k.isNotNull(), k == 1).alias("freeze"),
    )


def eval_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eval-log rows per simulated run (one run per user): step = 250 x event position; metrics
    from the event value. Metric cells are strings as a CSV writer would put them: user 2's first
    accuracy is ``nan``; user 4's last row is written twice (a duplicate step); runs of odd users
    have no ``loss`` column (NULL here)."""
    s = materialize(event_steps(spark, sf_dir), "event-steps")
    runs = eval_runs(s)
    x = s.join(runs, "user_id")
    run_dir = F.concat(
        F.col("algo"), F.lit("_gap"), F.format_string("%03d", F.round(F.col("gap") * 100).cast("int")),
        F.lit("_lr"), F.col("lr"), F.lit("_seed"), F.col("seed").cast("string"),
    )
    v = F.col("value")
    acc = F.when((F.col("user_id") == 2) & (F.col("step") == 0), F.lit("nan")).otherwise((v / 500.0).cast("string"))
    head, tail = v / 400.0, v / 800.0
    rows = x.select(
        "user_id",
        run_dir.alias("run_dir"),
        (F.col("step") * 250).alias("step"),
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, (F.lit(1000.0) / (v + 1.0)).cast("string")).alias("loss"),
        acc.alias("accuracy"),
        (v / 600.0).cast("string").alias("f1_macro"),
        F.lit(None).cast("string").alias("corr_support_f1_pearson_r"),
        F.lit(None).cast("string").alias("corr_support_f1_spearman_rho"),
        head.cast("string").alias("f1_head"),
        tail.cast("string").alias("f1_tail"),
        (head - tail).cast("string").alias("gap_head_tail"),
    )
    last4 = rows.where(F.col("user_id") == 4).orderBy(F.col("step").desc()).limit(1)
    return rows.unionByName(last4)


def write_eval_logs(spark: SparkSession, sf_dir: str, base: str, appends: int = 2) -> None:
    """Write the eval-log fixture below ``base`` as one committed log, ``csv_logs/eval.csv``, in two
    appends (or the first only): runs with a ``loss`` column and runs without it have different headers
    (ragged logs)."""
    from envlab.sinks.files import write_metric_logs_by_run
    from envlab.sources.logs import EVAL_COLUMNS

    rows = materialize(eval_log_rows(spark, sf_dir), "eval-rows")
    with_loss = rows.where(F.pmod(F.col("user_id"), F.lit(2)) == 0)
    without = rows.where(F.pmod(F.col("user_id"), F.lit(2)) == 1)
    write_metric_logs_by_run(with_loss, base, "run_dir", "eval", EVAL_COLUMNS, "with-loss")
    if appends > 1:
        write_metric_logs_by_run(without, base, "run_dir", "eval", [c for c in EVAL_COLUMNS if c != "loss"], "without-loss")
