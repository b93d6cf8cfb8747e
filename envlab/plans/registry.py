"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator family.

Every query reads the driver tables (through the fixture views of FIXTURES.md) and runs over the
whole tables. Column names equal those of the SQL twins in :mod:`envlab.checks.oracle`.
Floating-point results whose value depends on summation order are rounded to 9 digits.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.operators.balance import balance_by_gender, split_test_train
from envlab.plans.support_report import support_report, support_thresholds, support_top
from envlab.sources import fixtures as fx

SEED = 0
# Query parameters (fixed, the same in the SQL twins)
MIN_TRAIN, MIN_VAL = 40, 10
K_TEST = 10

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def r9(c):
    """Round half up to 9 decimals as ``floor(x * 1e9 + 0.5) / 1e9`` (identical in the SQL twins;
    ``round`` differs between engines on exact decimal ties). NaN and |x| >= 1e9 are left as they are."""
    return F.when(F.isnan(c) | (F.abs(c) >= 1e9), c).otherwise(F.floor(c * 1e9 + 0.5) / 1e9)


# ---------------------------------------------------------------- support report (C4)
@query("support_report")
def q_support_report(spark, d):
    return support_report(fx.bios(spark, d))


@query("support_thresholds")
def q_support_thresholds(spark, d):
    return support_thresholds(fx.bios(spark, d), MIN_TRAIN, MIN_VAL)


@query("support_top10")
def q_support_top10(spark, d):
    return support_top(fx.bios(spark, d), 10, descending=True)


@query("support_bottom10")
def q_support_bottom10(spark, d):
    return support_top(fx.bios(spark, d), 10, descending=False)


# ---------------------------------------------------------------- balancing and splitting
@query("balanced_sample")
def q_balanced_sample(spark, d):
    b = fx.bios(spark, d).where(F.col("split").isin("train", "dev"))
    return balance_by_gender(b, seed=SEED).select("example_id", "profession", "gender")


@query("balanced_sample_strgender")
def q_balanced_sample_str(spark, d):
    from envlab.sources.corpus import gender_code

    raw = fx.bios_str(spark, d)
    b = raw.withColumn("gender", gender_code(raw))
    return balance_by_gender(b, seed=SEED).select("example_id", "profession", "gender")


def _pool_split(spark, d):
    pool = balance_by_gender(fx.bios(spark, d), seed=SEED)
    return split_test_train(pool, K_TEST, seed=SEED)


@query("split_test")
def q_split_test(spark, d):
    test, _ = _pool_split(spark, d)
    return test.select("example_id", "profession", "gender")


@query("split_train")
def q_split_train(spark, d):
    _, train = _pool_split(spark, d)
    return train.select("example_id", "profession", "gender")


# ---------------------------------------------------------------- classes, environments, corpora
from envlab.functions.text import PREFIX_GROUP0, PREFIX_GROUP1, count_prefix  # noqa: E402
from envlab.operators.envs import assign_contiguous, assign_round_robin, class_ids, env_grid, env_grid_legacy, shuffle_positions  # noqa: E402
from envlab.plans.corpus import build_corpus_a, build_corpus_b  # noqa: E402

# Builder parameters (FIXTURES.md "Literals")
GAP, M, MEAN, VAL_COLOR = 0.4, 2, 0.2, 0.9
GAP_CLAMPED, M_CLAMPED = 0.8, 3
LEGACY_P1, LEGACY_P2, LEGACY_VAL = 0.9, 0.8, 0.05


def _train_a(spark, d):
    return balance_by_gender(fx.bios(spark, d).where(F.col("split").isin("train", "dev")), seed=SEED)


@query("class_ids")
def q_class_ids(spark, d):
    return class_ids(_train_a(spark, d))


def _grid_with_counts(grid, envs):
    n = envs.groupBy("env").agg(F.count(F.lit(1)).alias("n_rows"))
    return grid.join(n, "env", "left").select(
        "env", r9(F.col("p_color")).alias("p_color"), r9(F.col("p_align")).alias("p_align"),
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
    )


@query("env_grid")
def q_env_grid(spark, d):
    """F5 grid with the number of builder-B training rows sent to each environment."""
    _, train = _pool_split(spark, d)
    envs = assign_round_robin(train, M, SEED)
    return _grid_with_counts(env_grid(spark, GAP, M, MEAN, VAL_COLOR), envs)


@query("env_grid_clamped")
def q_env_grid_clamped(spark, d):
    _, train = _pool_split(spark, d)
    envs = assign_round_robin(train, M_CLAMPED, SEED)
    return _grid_with_counts(env_grid(spark, GAP_CLAMPED, M_CLAMPED, MEAN, VAL_COLOR), envs)


@query("env_grid_legacy")
def q_env_grid_legacy(spark, d):
    envs = assign_contiguous(_train_a(spark, d), 2, SEED)
    return _grid_with_counts(env_grid_legacy(spark, LEGACY_P1, LEGACY_P2, LEGACY_VAL), envs)


@query("envs_contiguous")
def q_envs_contiguous(spark, d):
    t = _train_a(spark, d)
    pos = shuffle_positions(t, SEED).select("example_id", "shuffle_pos")
    return assign_contiguous(t, M, SEED).join(pos, "example_id").select("example_id", "profession", "env", "shuffle_pos")


@query("envs_round_robin")
def q_envs_round_robin(spark, d):
    _, train = _pool_split(spark, d)
    return assign_round_robin(train, M, SEED).select("example_id", "profession", "env")


def _corpus_b(spark, d):
    return build_corpus_b(spark, fx.bios(spark, d), GAP, M, MEAN, VAL_COLOR, K_TEST, SEED)


def _lines(c):
    return c.lines.select("env", "example_id", "labels", F.md5("text").alias("text_md5"))


@query("corpus_a")
def q_corpus_a(spark, d):
    return _lines(build_corpus_a(spark, fx.bios(spark, d), GAP, M, MEAN, VAL_COLOR, seed=SEED))


@query("corpus_a_legacy")
def q_corpus_a_legacy(spark, d):
    c = build_corpus_a(spark, fx.bios(spark, d), p1=LEGACY_P1, p2=LEGACY_P2, val_p=LEGACY_VAL, seed=SEED)
    return _lines(c)


@query("corpus_b")
def q_corpus_b(spark, d):
    return _lines(_corpus_b(spark, d))


@query("corpus_b_pooled")
def q_corpus_b_pooled(spark, d):
    p = _corpus_b(spark, d).pooled
    return p.select("erm_pos", "example_id", "labels", F.md5("text").alias("text_md5"))


@query("inject_tokens")
def q_inject_tokens(spark, d):
    """Prefix counts per environment and class in builder B's output."""
    rows = _corpus_b(spark, d).lines
    return rows.groupBy("env", "labels").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(count_prefix("text", PREFIX_GROUP0)).cast("long").alias("n_aaa"),
        F.sum(count_prefix("text", PREFIX_GROUP1)).cast("long").alias("n_bbb"),
    )


# ---------------------------------------------------------------- evaluation (C6) and head divergence
from envlab.operators import heads as HD  # noqa: E402
from envlab.operators import metrics as MT  # noqa: E402


def _pc(hl):
    return MT.per_class(MT.confusion(MT.ensemble(hl)))


def _round_all(df, skip=()):
    return df.select(*[r9(F.col(c)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query("ensemble_pred")
def q_ensemble_pred(spark, d):
    p = MT.ensemble(fx.head_logits(spark, d))
    return p.select("example_id", "label", "pred", "n_heads", F.transform("logits", r9).alias("logits"))


@query("confusion")
def q_confusion(spark, d):
    return MT.confusion(MT.ensemble(fx.head_logits(spark, d))).select("label", "pred", "n")


@query("per_class_f1")
def q_per_class(spark, d):
    return _round_all(_pc(fx.head_logits(spark, d)))


@query("eval_report")
def q_eval_report(spark, d):
    return _round_all(MT.eval_report(_pc(fx.head_logits(spark, d))))


@query("eval_report_binary")
def q_eval_report_binary(spark, d):
    """Two classes: the support/F1 correlations are undefined (NULL)."""
    return _round_all(MT.eval_report(_pc(fx.head_logits(spark, d, binary=True))))


@query("eval_report_single_head")
def q_eval_report_single(spark, d):
    return _round_all(MT.eval_report(_pc(fx.head_logits(spark, d, n_envs=1))))


@query("eval_report_extended")
def q_eval_report_extended(spark, d):
    return _round_all(MT.eval_report_extended(_pc(fx.head_logits(spark, d))))


@query("eval_loss")
def q_eval_loss(spark, d):
    return _round_all(MT.eval_loss(MT.ensemble(fx.head_logits(spark, d))))


@query("head_js")
def q_head_js(spark, d):
    return _round_all(HD.prediction_divergence(fx.head_logits(spark, d)))


@query("head_js_single_head")
def q_head_js_single(spark, d):
    return _round_all(HD.prediction_divergence(fx.head_logits(spark, d, n_envs=1)))


EVAL_BATCHES = 3


@query("head_js_first_batches")
def q_head_js_first_batches(spark, d):
    """The divergence over the first EVAL_BATCHES evaluation batches."""
    return _round_all(HD.prediction_divergence(fx.head_logits(spark, d), max_batches=EVAL_BATCHES))


@query("custom_metric")
def q_custom_metric(spark, d):
    """H3: a metric of the caller's own, the F2 score per class, over the per-class table."""
    def f2(pdf):
        p, r = pdf["precision"], pdf["recall"]
        below = 4 * p + r
        return pdf[["class"]].assign(f2=(5 * p * r / below.where(below > 0, 1.0)).where(below > 0, 0.0))

    return _round_all(MT.custom_class_metric(_pc(fx.head_logits(spark, d)), f2, "class int, f2 double"))


@query("head_weight_divergence")
def q_head_weight_div(spark, d):
    return _round_all(HD.weight_divergence(fx.head_weights(spark, d)))


@query("heads_compact")
def q_heads_compact(spark, d):
    w = fx.head_weights(spark, d)
    log = HD.heads_log(HD.weight_divergence(w), HD.prediction_divergence(HD.step_logits(w), group="step"))
    return _round_all(HD.compact_heads_log(log))


# ---------------------------------------------------------------- run histories (C8) and the run grid
from envlab.functions.names import grid_run_name, run_tags  # noqa: E402
from envlab.operators import runs as RN  # noqa: E402

METRIC = "ood_perplexity"
PIVOT_LRS = ["1e-4", "5e-4", "1e-3"]


def _history(spark, d):
    return fx.run_history(spark, d)


def _parsed(spark, d):
    return RN.parse_runs(_history(spark, d).select("run_id", "run_name").distinct())


def _values(spark, d, strategy):
    r = RN.run_table(_history(spark, d), METRIC, strategy)
    return RN.kept_runs(r).select("run_id", "run_name", "algo", "lr", "seed", "model", "step", "value")


@query("parse_runs")
def q_parse_runs(spark, d):
    return _parsed(spark, d)


@query("unparsed_runs")
def q_unparsed_runs(spark, d):
    """All names that do not parse, by name (a display limit is the caller's)."""
    return _parsed(spark, d).where(~F.col("parsed")).select("run_id", "run_name").orderBy("run_name", "run_id")


@query("run_last")
def q_run_last(spark, d):
    return _values(spark, d, "last")


@query("run_min")
def q_run_min(spark, d):
    return _values(spark, d, "min")


@query("run_totals")
def q_run_totals(spark, d):
    return RN.run_totals(RN.run_table(_history(spark, d), METRIC, "last"))


@query("run_last_summary")
def q_run_last_summary(spark, d):
    """Runs with a tracker summary table: some runs have no history at all, only a summary."""
    h = _history(spark, d)
    v = RN.run_value(h.where(F.pmod("run_id", F.lit(7)) != 2), fx.run_summary(h), METRIC, "last")
    return v.select("run_id", "run_name", "step", "value")


@query("run_totals_summary")
def q_run_totals_summary(spark, d):
    """Totals over all runs, also those without a row of the metric."""
    h = _history(spark, d)
    other = F.when(F.pmod("run_id", F.lit(7)) == 2, F.lit("loss")).otherwise(F.col("metric"))
    return RN.run_totals(RN.run_table(h.withColumn("metric", other), METRIC, "last"))


def _seed_agg(spark, d):
    a = RN.seed_aggregate(_values(spark, d, "last"), prefix=METRIC)
    return a.select("algo", "lr", "model", "n_seeds", r9(F.col(f"mean_{METRIC}")).alias(f"mean_{METRIC}"),
                    r9(F.col(f"std_{METRIC}")).alias(f"std_{METRIC}"))


@query("seed_aggregate")
def q_seed_aggregate(spark, d):
    return RN.sort_runs(_seed_agg(spark, d))


@query("seed_pivot")
def q_seed_pivot(spark, d):
    return RN.seed_pivot(_seed_agg(spark, d), f"mean_{METRIC}", PIVOT_LRS)


def _eval_runs(spark, d):
    """Experiment runs derived from ``events``: one per user, attributes from the user id."""
    return fx.eval_runs(fx.table(spark, d, "events"))


@query("run_grid")
def q_run_grid(spark, d):
    """F11 run names of the per-user runs (steps = 250 x events of the user) and their F12 tags."""
    ev = fx.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    r = _eval_runs(spark, d).join(ev, "user_id")
    steps = F.col("n_events") * 250
    name = F.when(F.col("k").isNull(), grid_run_name("algo", "gap", F.col("lr"), "seed", steps)).otherwise(
        grid_run_name("algo", "gap", F.col("lr"), "seed", steps, "k", "freeze")
    )
    x = r.select("user_id", name.alias("run_name"))
    t = run_tags(F.col("run_name"))
    return x.select("user_id", "run_name", t["algo"].alias("tag_algo"), t["group"].alias("tag_group"), t["k"].alias("tag_k"), t["freeze"].alias("tag_freeze"))


# ---------------------------------------------------------------- learning curves
from envlab.operators import curves as CV  # noqa: E402
from envlab.session import materialize, scratch_path  # noqa: E402
from envlab.sinks.appendlog import merge, write_attempt  # noqa: E402
from envlab.sinks.files import log_root, write_metric_logs_by_run  # noqa: E402
from envlab.sources.logs import (  # noqa: E402
    EVAL_COLUMNS, TRAINING_COLUMNS, available_columns, discover_logs, parse_ragged, read_eval_logs, read_metric_log, refresh_logs,
)

CURVE_METRICS = ["accuracy", "f1_macro", "f1_head", "f1_tail", "gap_head_tail", "loss"]


def _eval_logs_dir(spark, d):
    base = scratch_path(spark, "evallogs")
    fx.write_eval_logs(spark, d, base)
    return base


@query("curve_summary")
def q_curve_summary(spark, d):
    """Eval logs written per run (ragged headers), discovered, lr from the path, target lrs
    kept, mean/std per (lr, step) for every requested metric present."""
    base = _eval_logs_dir(spark, d)
    lines = discover_logs(spark, base, "eval")
    rows = CV.keep_target_lrs(read_eval_logs(spark, base, lines=lines))
    metrics = CV.select_metrics(CURVE_METRICS, available_columns(lines))
    s = CV.curve_summary(rows, metrics)
    return s.select("lr", "step", *[r9(F.col(c)).alias(c) for c in s.columns if c not in ("lr", "step")])


@query("curve_summary_refreshed")
def q_curve_summary_refreshed(spark, d):
    """S5 + C9 from remembered rows: the logs are read when half of the runs are there and again when all
    are; the second time only new files are opened."""
    base, state = scratch_path(spark, "evallogs"), scratch_path(spark, "seen")
    fx.write_eval_logs(spark, d, base, appends=1)
    refresh_logs(spark, base, state)
    fx.write_eval_logs(spark, d, base)
    rows, _ = refresh_logs(spark, base, state)
    s = CV.curve_summary(CV.keep_target_lrs(rows), CURVE_METRICS)
    return s.select("lr", "step", *[r9(F.col(c)).alias(c) for c in s.columns if c not in ("lr", "step")])


@query("curve_csv")
def q_curve_csv(spark, d):
    """C9 as a job: K6 + T5, one CSV per metric, sorted by (lr, step), read back."""
    base, out = _eval_logs_dir(spark, d), scratch_path(spark, "plots")
    curve_job(spark, base, out)
    rows = None
    for m in CV.DEFAULT_METRICS:
        back = spark.read.schema("lr double, step long, mean double, std double").option("header", True).csv(f"{out}/summary_{m}")
        x = back.select(F.lit(m).alias("metric"), "lr", "step", r9(F.col("mean")).alias("mean"), r9(F.col("std")).alias("std"))
        rows = x if rows is None else rows.unionByName(x)
    return rows


@query("seed_csv")
def q_seed_csv(spark, d):
    """C8 as a job: K5, the sorted seed aggregate as CSV, read back."""
    out = scratch_path(spark, "seeds")
    seed_job(_history(spark, d), METRIC, out)
    schema = f"algo string, lr string, model long, n_seeds long, mean_{METRIC} double, std_{METRIC} double"
    back = spark.read.schema(schema).option("header", True).csv(out)
    return back.select("algo", "lr", "model", "n_seeds", *[r9(F.col(c)).alias(c) for c in back.columns[4:]])


@query("ragged_logs")
def q_ragged_logs(spark, d):
    """S5 + S6: all discovered eval rows by column name, lr from the path, NaN as missing."""
    base = _eval_logs_dir(spark, d)
    rows = read_eval_logs(spark, base)
    keep = ["accuracy", "f1_macro", "f1_head", "f1_tail", "gap_head_tail", "loss"]
    return rows.select(F.col("run_dir").alias("run"), "lr", "step",
                       *[r9(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in keep])


# ---------------------------------------------------------------- load, encode, batch
from envlab.operators import encode as EN  # noqa: E402
from envlab.sinks.files import write_env_tsv  # noqa: E402
from envlab.sources.tsv import drop_blank, read_envs  # noqa: E402

BATCH, ACCUM, EPOCHS = 64, 4, 3
FIXED_LENGTH = 128


def _lines_b(spark, d):
    return _corpus_b(spark, d).lines


@query("tsv_roundtrip")
def q_tsv_roundtrip(spark, d):
    """K1 + S3: builder B's lines written as raw TSV per environment and read back in one scan."""
    path = scratch_path(spark, "envs")
    write_env_tsv(_lines_b(spark, d), path)
    back = read_envs(spark, path)
    return back.select("env", "labels", F.md5("text").alias("text_md5"))


def _stored_lines(spark, d):
    """Builder B's lines as the encoding job finds them: written once, then read (with their key)."""
    return materialize(_lines_b(spark, d), "lines")


def _vocab(spark, lines):
    return EN.build_vocab(lines.where(F.col("env") != "val"))


@query("vocab")
def q_vocab(spark, d):
    return _vocab(spark, _corpus_b(spark, d).train)


def _encoded(spark, d, lines=None):
    lines = _stored_lines(spark, d) if lines is None else lines
    return EN.encode(drop_blank(lines), materialize(_vocab(spark, lines), "vocab"))


@query("encoded")
def q_encoded(spark, d):
    return _encoded(spark, d).select("env", "example_id", "labels", "input_ids", "attention_mask")


@query("encoded_repeated_ids")
def q_encoded_repeated_ids(spark, d):
    """Encoding of lines whose ids repeat across environments: no row is lost or merged."""
    lines = _stored_lines(spark, d).where(F.col("env") != "val")
    both = lines.unionByName(lines.withColumn("env", F.concat(F.lit("again_"), "env")).withColumn("text", F.reverse("text")))
    enc = EN.encode(drop_blank(both), materialize(_vocab(spark, lines), "vocab"))
    return enc.select("env", "example_id", "labels", "input_ids", "attention_mask")


def _train_encoded(spark, d, lines=None):
    """K8: the encoded set is stored (as the encoding job does) and read back."""
    return materialize(_encoded(spark, d, lines), "encoded").where(F.col("env") != "val")


def _batches(spark, d, lines=None):
    return EN.batch_plan(_train_encoded(spark, d, lines).select("env", "example_id"), BATCH, SEED)


@query("batches")
def q_batches(spark, d):
    """Every example's place in its environment's permutation and its batch."""
    return _batches(spark, d).select("env", "example_id", "rank", "batch_id")


@query("padded")
def q_padded(spark, d):
    """W8 + F17: batches padded to their longest sequence."""
    p = EN.padded_batches(_train_encoded(spark, d), BATCH, SEED)
    return p.select("env", "batch_id", "example_id", "input_ids", "attention_mask")


@query("padded_fixed")
def q_padded_fixed(spark, d):
    """F17 with a fixed length: shorter rows padded, longer ones truncated."""
    p = EN.padded_batches(_train_encoded(spark, d), BATCH, SEED, fixed_length=FIXED_LENGTH)
    return p.select("env", "batch_id", "example_id", "input_ids", "attention_mask")


def _plan(lines):
    train = drop_blank(lines.where(F.col("env") != "val"))
    return EN.epoch_plan(train, BATCH, ACCUM, None, EPOCHS)


@query("epoch_plan")
def q_epoch_plan(spark, d):
    return _plan(_lines_b(spark, d))


@query("step_schedule")
def q_step_schedule(spark, d):
    lines = _stored_lines(spark, d)
    max_steps = _plan(lines).select("max_steps").first()[0]
    return EN.step_schedule(spark, max_steps, _batches(spark, d, lines))


# ---------------------------------------------------------------- training-log streams
from envlab.operators.moving import BLOCK, moving_average  # noqa: E402
from envlab.streaming import logs as ST  # noqa: E402

LOG_APPENDS = 8
CADENCE = 10


@query("loss_moving_avg")
def q_loss_moving_avg(spark, d):
    """W5 in batch: moving average of the last 20 losses per run."""
    t = fx.train_log(spark, d)
    m = moving_average(t, "run", "step", "train_loss", "train_loss_moving_avg")
    return m.select("run", "step", "train_loss", r9(F.col("train_loss_moving_avg")).alias("train_loss_moving_avg"))


def _chunked(df, step_col):
    """``_chunk``: the steps cut into LOG_APPENDS ranges."""
    n = (df.agg(F.max(step_col)).first()[0] or 0) + 1
    return df.withColumn("_chunk", F.floor(F.col(step_col) * LOG_APPENDS / n).cast("long"))


def _ma_stream(spark, d, every=None):
    src, sink, ck = scratch_path(spark, "trainlog"), scratch_path(spark, "ma"), scratch_path(spark, "ma-ckpt")
    log = materialize(fx.train_log(spark, d), "trainlog-all")
    ST.write_log_chunks(_chunked(log, "step"), src, "_chunk", LOG_APPENDS, key="run")
    ST.run_moving_average_stream(spark, src, sink, ck, every=every, files_per_trigger=8)
    out = spark.read.parquet(sink)
    return out.select("run", "step", "train_loss", r9(F.col("train_loss_moving_avg")).alias("train_loss_moving_avg"))


@query("loss_moving_avg_stream")
def q_loss_moving_avg_stream(spark, d):
    """X1 + X2: the training log arrives as successive appends; the moving average is carried
    across micro-batches in per-run state. Equal to the batch result."""
    return _ma_stream(spark, d)


@query("loss_moving_avg_disordered")
def q_loss_moving_avg_disordered(spark, d):
    """X2 with rows of every step range in every append: held until their predecessors have come. Every append is
    processed before the next one comes, and all rows go out, however long the runs."""
    src, sink, ck = scratch_path(spark, "trainlog"), scratch_path(spark, "ma"), scratch_path(spark, "ma-ckpt")
    log = materialize(fx.train_log(spark, d), "trainlog-all").withColumn("_chunk", F.pmod(F.xxhash64("run", "step"), F.lit(LOG_APPENDS)))
    for c in range(LOG_APPENDS):
        ST.write_log_chunks(log.where(F.col("_chunk") == c).withColumn("_chunk", F.lit(0)), src, "_chunk", 1, key="run")
        ST.run_moving_average_stream(spark, src, sink, ck, files_per_trigger=None, block=BLOCK)
    out = spark.read.parquet(sink)
    return out.select("run", "step", "train_loss", r9(F.col("train_loss_moving_avg")).alias("train_loss_moving_avg"))


@query("log_appends")
def q_log_appends(spark, d):
    """K7: the training logs of all runs appended in two halves, the second one replayed, a third append
    killed before its commit, the log merged and appended to once more; every row is read back once."""
    log = fx.train_log(spark, d).withColumn("name", F.concat(F.lit("run "), F.col("run").cast("string")))
    log = materialize(log.withColumn("round", F.floor(F.col("step") / 50)), "trainlog-all")
    base, cols = scratch_path(spark, "runs"), list(TRAINING_COLUMNS)
    part = [log.where(F.pmod("step", F.lit(3)) == k) for k in range(3)]
    root = log_root(base, "training")
    for epoch in (0, 1, 1):
        write_metric_logs_by_run(part[epoch], base, "name", "training", cols, epoch)
    write_attempt(part[0], root, 2, cols, "name")
    merge(spark, root, "merge-1", "step long, train_loss double, train_loss_moving_avg double, round long", cols, runs=True)
    write_metric_logs_by_run(part[2], base, "name", "training", cols, 2)
    back = read_metric_log(spark, base, "training", cols)
    return back.select("run", "step", r9(F.col("train_loss")).alias("train_loss"), "train_loss_moving_avg", "round")


@query("loss_cadence_stream")
def q_loss_cadence_stream(spark, d):
    """The streamed moving average, logged every CADENCE steps."""
    return _ma_stream(spark, d, CADENCE)


@query("heads_compact_stream")
def q_heads_compact_stream(spark, d):
    """X5 on a stream: the heads log (two half-empty rows per step) compacted while it grows."""
    w = fx.head_weights(spark, d)
    log = HD.heads_log(HD.weight_divergence(w), HD.prediction_divergence(HD.step_logits(w), group="step"))
    log = materialize(log, "headslog-all")
    src, sink, ck = scratch_path(spark, "headslog"), scratch_path(spark, "headsc"), scratch_path(spark, "headsc-ckpt")
    ST.write_log_chunks(_chunked(log, "step"), src, "_chunk", LOG_APPENDS)
    ST.run_heads_compaction_stream(spark, src, sink, ck, files_per_trigger=4)
    return _round_all(ST.read_compacted_heads(spark, sink))


# ---------------------------------------------------------------- linear heads (M1-M3): rows-only checks
from envlab.operators import fit as FT  # noqa: E402

FIT_ITERS, FIT_LR, FIT_ENVS = 25, 0.5, 2


def _fit_rows(spark, d):
    e = fx.table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("example_id"),
        F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("features"),
        F.col("label").cast("int").alias("label"),
        F.concat(F.lit("env_"), (F.pmod(F.col("vec_id"), F.lit(FIT_ENVS)) + 1).cast("string")).alias("env"),
    )


@query("fit_pooled")
def q_fit_pooled(spark, d):
    """M1: pooled logistic regression, predictions on every example."""
    rows = _fit_rows(spark, d)
    model = FT.fit_pooled(rows, max_iter=50)
    return FT.predict_pooled(model, rows).select("example_id", "label", "pred")


@query("fit_env_heads")
def q_fit_env_heads(spark, d):
    """M2 + M3 + A22: per-environment heads on frozen features, scored and ensembled."""
    rows = _fit_rows(spark, d)
    n_classes = rows.agg(F.max("label")).first()[0] + 1
    dim = rows.select(F.size("features")).first()[0]
    weights, _ = FT.fit_env_heads(spark, rows, n_classes, dim, FIT_ITERS, FIT_LR)
    envs = sorted(weights)
    hl = FT.score_heads(rows, FT.head_table(spark, weights), envs)
    return MT.ensemble(hl).select("example_id", "label", "pred", "n_heads")


TURN_STEPS, TURN_K = 16, 2


@query("fit_heads_turns")
def q_fit_heads_turns(spark, d):
    """M2 by turns: K updates of every head a round over dealt batches; scored and ensembled."""
    rows = _fit_rows(spark, d)
    n_classes = rows.agg(F.max("label")).first()[0] + 1
    dim = rows.select(F.size("features")).first()[0]
    path = scratch_path(spark, "batches")
    FT.store_batches(rows, path, BATCH, SEED)
    weights, _ = FT.fit_heads_in_turns(spark, path, n_classes, dim, TURN_STEPS, TURN_K, BATCH)
    hl = FT.score_heads(rows, FT.head_table(spark, weights), sorted(weights))
    return MT.ensemble(hl).select("example_id", "label", "pred", "n_heads")


# ---------------------------------------------------------------- evaluation every n steps on a stream
from envlab.sources.logs import parse_ragged  # noqa: E402,F811

EVAL_STEPS = 5


def _snapshots(spark, d):
    """Per-step head outputs from the weight snapshots, labelled ``example_id % C``."""
    sl = HD.step_logits(fx.head_weights(spark, d))
    return sl.withColumn("label", F.pmod(F.col("example_id"), F.size("logits")).cast("int"))


@query("eval_by_step")
def q_eval_by_step(spark, d):
    """C6 for every snapshot step at once (grouped metrics), cleaned to the eval-log shape."""
    snap = _snapshots(spark, d).where(F.pmod(F.col("step"), F.lit(EVAL_STEPS)) == 0)
    return _round_all(MT.clean_eval_metrics(MT.evaluate(snap, ["step"])))


@query("eval_stream")
def q_eval_stream(spark, d):
    """Snapshots streamed in two rounds (the second restarts from the checkpoint); each
    micro-batch evaluates its eval steps and appends to the run's eval log, read back here."""
    snap = materialize(_snapshots(spark, d), "snapshots")
    src, run, ck = scratch_path(spark, "snap"), scratch_path(spark, "run"), scratch_path(spark, "snap-ckpt")
    half = snap.agg(F.max("step")).first()[0] // 2
    snap.where(F.col("step") <= half).write.mode("append").parquet(src)
    ST.run_eval_stream(spark, src, run, ck, EVAL_STEPS)
    snap.where(F.col("step") > half).write.mode("append").parquet(src)
    ST.run_eval_stream(spark, src, run, ck, EVAL_STEPS)
    rows = parse_ragged(discover_logs(spark, run, "eval"), EVAL_COLUMNS)
    return _round_all(rows.select(*EVAL_COLUMNS))


@query("eval_stream_parts")
def q_eval_stream_parts(spark, d):
    """X4 with every snapshot's rows dealt over three appends: evaluated once, when whole."""
    snap = materialize(_snapshots(spark, d).withColumn("_part", F.pmod(F.xxhash64("step", "example_id", "env"), F.lit(3))), "snapshots")
    rows = snap.groupBy("step").count().agg(F.max("count")).first()[0]
    src, run, ck = scratch_path(spark, "snap"), scratch_path(spark, "run"), scratch_path(spark, "snap-ckpt")
    for part in range(3):
        snap.where(F.col("_part") == part).drop("_part").write.mode("append").parquet(src)
        ST.run_eval_stream(spark, src, run, ck, EVAL_STEPS, snapshot_rows=rows)
    return _round_all(read_metric_log(spark, run, "eval", EVAL_COLUMNS).select(*EVAL_COLUMNS))


# ---------------------------------------------------------------- sinks and the corpus reader, written and read back
from envlab.plans.jobs import curve_job, map_batches, seed_job  # noqa: E402
from envlab.sinks.files import write_csv_report, write_encoded, write_head_snapshots, write_pooled_tsv, write_val_tsv  # noqa: E402
from envlab.sources.corpus import at_positions, read_corpus  # noqa: E402
from envlab.sources.tsv import read_pooled  # noqa: E402


@query("corpus_read")
def q_corpus_read(spark, d):
    """S1 + P1 + U1: one dataset per split, its text column found by exclusion, stacked again."""
    b = fx.bios(spark, d).select("example_id", "profession", F.col("text").alias("hard_text"), "gender", "split")
    base = scratch_path(spark, "splits")
    b.write.partitionBy("split").parquet(base)
    c = read_corpus(spark, {s: f"{base}/split={s}" for s in ("train", "dev", "test")})
    return c.select("example_id", "profession", "gender", "split", F.md5("text").alias("text_md5"))


def _positional(spark, d):
    """The bios corpus as Parquet splits of several files without ids, read by position."""
    b = fx.bios(spark, d).withColumnRenamed("text", "hard_text")
    base = scratch_path(spark, "splits")
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for s in ("train", "dev", "test"):
        rows = b.where(F.col("split") == s).repartitionByRange(files, "example_id").sortWithinPartitions("example_id")
        rows.select("hard_text", "profession", "gender").write.parquet(f"{base}/{s}")
    return read_corpus(spark, {s: f"{base}/{s}" for s in ("train", "dev", "test")})


@query("corpus_positions")
def q_corpus_positions(spark, d):
    """S1 + H2: rows without ids get their positions; those at every seventh one are left out."""
    c = _positional(spark, d)
    left = at_positions(c, c.where(F.pmod("example_id", F.lit(7)) == 0), keep=False)
    return left.select("example_id", "profession", "gender", "split", F.md5("text").alias("text_md5"))


@query("corpus_a_positions")
def q_corpus_a_positions(spark, d):
    """C1 on a corpus without ids."""
    return _lines(build_corpus_a(spark, _positional(spark, d), GAP, M, MEAN, VAL_COLOR, seed=SEED))


@query("corpus_b_positions")
def q_corpus_b_positions(spark, d):
    """C2 on a corpus without ids."""
    return _lines(build_corpus_b(spark, _positional(spark, d), GAP, M, MEAN, VAL_COLOR, K_TEST, SEED))


@query("support_report_positions")
def q_support_report_positions(spark, d):
    """C4 on a corpus without ids."""
    return support_report(_positional(spark, d))


@query("encoded_content")
def q_encoded_content(spark, d):
    """F15 by the encoder's rule for the text column: ``content``, wherever it stands."""
    lines = _stored_lines(spark, d)
    named = drop_blank(lines).select("labels", F.col("text").alias("content"), "env", "example_id")
    enc = EN.encode(named, materialize(_vocab(spark, lines), "vocab"), text_col=None)
    return enc.select("env", "example_id", "labels", "input_ids", "attention_mask")


@query("support_csv")
def q_support_csv(spark, d):
    """K4: the support report as CSV, read back."""
    path = scratch_path(spark, "support")
    write_csv_report(support_report(fx.bios(spark, d)), path, order=["profession"])
    return spark.read.schema("profession string, train_count long, val_count long").option("header", True).csv(path)


@query("pooled_tsv")
def q_pooled_tsv(spark, d):
    """K2 + S4 + T4: the pooled lines written in their shuffle order and read back."""
    path = scratch_path(spark, "pooled")
    write_pooled_tsv(_corpus_b(spark, d).pooled_sorted(), path)
    return read_pooled(spark, path).select("env", "labels", F.md5("text").alias("text_md5"))


@query("val_tsv")
def q_val_tsv(spark, d):
    """K3 + S4 + T6: the validation lines written in their original order and read back."""
    path = scratch_path(spark, "val")
    write_val_tsv(_corpus_b(spark, d).val.orderBy("example_id"), path)
    return read_pooled(spark, path, env="val").select("env", "labels", F.md5("text").alias("text_md5"))


@query("encoded_stored")
def q_encoded_stored(spark, d):
    """K8: the encoded set as Parquet per environment, read back."""
    path = scratch_path(spark, "encoded-out")
    write_encoded(_encoded(spark, d).select("env", "example_id", "labels", "input_ids", "attention_mask"), path)
    return spark.read.parquet(path).select("env", "example_id", "labels", "input_ids", "attention_mask")


@query("head_snapshots")
def q_head_snapshots(spark, d):
    """K9: head weights appended in two halves by step, read back for the weight divergence."""
    w = fx.head_weights(spark, d)
    path = scratch_path(spark, "heads")
    # a folder per range of steps, so that folders do not grow with the steps
    for part in (0, 1):
        write_head_snapshots(w.where(F.pmod("step", F.lit(2)) == part), path, steps_per_folder=1000)
    return _round_all(HD.weight_divergence(spark.read.parquet(path)))


@query("map_batches")
def q_map_batches(spark, d):
    """H1: a user's batched map over every text (its number of characters and of lines)."""
    docs = fx.bios(spark, d).select("example_id", F.coalesce("text", F.lit("")).alias("text"))

    def measure(frames):
        for f in frames:
            yield f.assign(n_chars=f["text"].str.len(), n_lines=f["text"].str.count("\n") + 1)[["example_id", "n_chars", "n_lines"]]

    return map_batches(docs, measure, "example_id long, n_chars long, n_lines long")
