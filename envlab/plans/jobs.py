"""End-to-end jobs with their outputs written (the reference's scripts, as functions).

Every job reads with :mod:`envlab.sources`, computes with the lazy plans of this package and writes
with :mod:`envlab.sinks`; each write is one distributed job. Paths may be any Hadoop-compatible
location.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.operators import curves as CV
from envlab.operators import encode as EN
from envlab.operators import runs as RN
from envlab.plans.corpus import Corpus, build_corpus_a, build_corpus_b, build_toy
from envlab.plans.support_report import support_report
from envlab.session import is_dir, materialize
from envlab.sinks.files import write_csv_report, write_encoded, write_env_tsv, write_pooled_tsv, write_val_tsv
from envlab.sources.corpus import read_corpus
from envlab.sources.logs import available_columns, discover_logs, read_eval_logs
from envlab.sources.tsv import drop_blank, read_envs, read_pooled


def write_corpus(corpus: Corpus, out_dir: str) -> None:
    """K1 + K2 + K3: ``envs/env=env_k/``, ``train_erm/`` (seeded shuffle order) and
    ``val_test/`` (rows in their original order, T6)."""
    out = out_dir.rstrip("/")
    write_env_tsv(corpus.train, f"{out}/envs")
    write_pooled_tsv(corpus.pooled_sorted(), f"{out}/train_erm")
    write_val_tsv(corpus.val.orderBy("example_id"), f"{out}/val_test")


def corpus_a_job(spark: SparkSession, splits: Mapping[str, str], out_dir: str, **kw) -> Corpus:
    """C1 (separately balanced splits): splits ``train``, ``dev``, ``test`` -> environment files."""
    c = build_corpus_a(spark, read_corpus(spark, splits), **kw)
    write_corpus(c, out_dir)
    return c


def corpus_b_job(spark: SparkSession, splits: Mapping[str, str], out_dir: str, **kw) -> Corpus:
    """C2 (pooled builder with K test rows per class)."""
    c = build_corpus_b(spark, read_corpus(spark, splits), **kw)
    write_corpus(c, out_dir)
    return c


def toy_job(spark: SparkSession, out_dir: str, gap: float, **kw) -> Corpus:
    """C3 (toy letters)."""
    c = build_toy(spark, gap, **kw)
    out = out_dir.rstrip("/")
    write_env_tsv(c.train, f"{out}/envs")
    write_pooled_tsv(c.pooled_sorted(), f"{out}/train_erm")
    write_val_tsv(c.val.orderBy("pos"), f"{out}/val_test")
    return c


def support_job(spark: SparkSession, splits: Mapping[str, str], out_path: str) -> DataFrame:
    """C4: ``profession,train_count,val_count`` sorted by class."""
    rep = support_report(read_corpus(spark, splits))
    write_csv_report(rep, out_path, order=["profession"])
    return rep


def encode_job(spark: SparkSession, train_dir: str, validation_file: str, out_path: str, vocab_size: int | None = None,
               max_seq_length: int | None = None) -> DataFrame:
    """Environment files (or one pooled file) + validation file -> encoded Parquet per env."""
    envs = read_envs(spark, train_dir) if is_dir(spark, train_dir) else read_pooled(spark, train_dir)
    val = read_pooled(spark, validation_file, env="validation")
    lines = drop_blank(envs.unionByName(val))
    # a line's id follows from the line: equal lines of an environment are numbered by copies
    copies = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("_n"))
    lines = materialize(
        copies.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(
            *lines.columns, F.concat_ws("-", F.md5(F.concat_ws("\t", F.col("labels").cast("string"), "text")), "_c").alias("example_id")
        ),
        "encode-lines",
    )
    vocab = EN.build_vocab(lines.where(F.col("env") != "validation"), vocab_size)
    enc = EN.encode(lines, materialize(vocab, "encode-vocab"), EN.max_seq_length(max_seq_length))
    write_encoded(enc, out_path)
    return enc


def seed_job(history: DataFrame, metric: str, out_path: str, strategy: str = "last",
             summary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-run value -> mean/std over seeds by (algo, lr, model), sorted; plus the pivot."""
    if summary is None:
        runs = RN.run_table(history, metric, strategy)
    else:
        v = RN.run_value(history, summary, metric, strategy)
        runs = RN.parse_runs(v)
    kept = RN.kept_runs(runs)
    agg = RN.seed_aggregate(kept, prefix=metric)
    write_csv_report(RN.sort_runs(agg), out_path)
    return agg, RN.seed_pivot(agg, f"mean_{metric}")


def curve_job(spark: SparkSession, base_dir: str, out_dir: str, metrics: Sequence[str] = CV.DEFAULT_METRICS,
              lrs: Sequence[float] = CV.TARGET_LRS) -> DataFrame:
    """Discover eval logs, keep target learning rates, mean/std per (lr, step); one CSV per
    metric ``summary_<metric>`` (K6)."""
    lines = discover_logs(spark, base_dir, "eval")
    chosen = CV.select_metrics(metrics, available_columns(lines))
    rows = CV.keep_target_lrs(read_eval_logs(spark, base_dir, lines=lines), lrs)
    summary = CV.curve_summary(rows, chosen)
    for m in chosen:
        write_csv_report(CV.per_metric(summary, m), f"{out_dir.rstrip('/')}/summary_{m}", order=["lr", "step"])
    return summary


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """H1 open hook: a batched map over Arrow record batches (pandas in, pandas out)."""
    return df.mapInPandas(fn, schema)
