"""Environment text files, reports, metric logs, encoded datasets and head snapshots (K1-K9)."""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlab.sinks.appendlog import append


def write_env_tsv(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: raw ``text<TAB>label`` lines (no quoting), one directory per environment
    (``env=env_1/``, ...)."""
    out = lines.select("env", F.concat_ws("\t", F.col("text"), F.col("labels").cast("string")).alias("value"))
    out.write.mode(mode).partitionBy("env").text(path)


def write_pooled_tsv(pooled_sorted: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: the pooled ("ERM") lines, already sorted in their seeded shuffle order
    (``Corpus.pooled_sorted``); the order survives the write (one part file per sorted range)."""
    out = pooled_sorted.select(F.concat_ws("\t", F.col("text"), F.col("labels").cast("string")).alias("value"))
    out.write.mode(mode).text(path)


def write_val_tsv(val: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: the validation lines."""
    val.select(F.concat_ws("\t", F.col("text"), F.col("labels").cast("string")).alias("value")).write.mode(mode).text(path)


def write_csv_report(df: DataFrame, path: str, order: Sequence[str] = (), single_file: bool = True) -> None:
    """K4-K6: a CSV with header. Reports are small (one row per class / group), so one file."""
    out = df.orderBy(*order) if order else df
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)


def log_root(run_dir: str, name: str, fmt: str = "csv") -> str:
    return f"{run_dir.rstrip('/')}/csv_logs/{name}.{fmt}"


def write_metric_log(rows: DataFrame, run_dir: str, name: str, columns: Sequence[str], fmt: str = "csv",
                     batch: int | str | None = None) -> bool:
    """K7: append rows to the committed log ``<run_dir>/csv_logs/<name>.csv`` (see ``sinks.appendlog``);
    every column of ``columns`` is present, missing values are empty cells; each data file carries the
    header. ``fmt='parquet'`` writes ``<name>.parquet`` instead. ``batch`` (a micro-batch's number, or any
    name) is appended once: a replay of it does nothing and returns False."""
    return append(rows, log_root(run_dir, name, fmt), uuid.uuid4().hex if batch is None else batch, columns, fmt=fmt)


def write_metric_logs_by_run(rows: DataFrame, base: str, run_col: str, name: str, columns: Sequence[str],
                             batch: int | str | None = None, fmt: str = "csv") -> bool:
    """K7 for many runs in one distributed write: one append to the log ``<base>/csv_logs/<name>.csv``,
    whose files hold many runs each. No file or folder is made, moved or listed per run."""
    return append(rows, log_root(base, name, fmt), uuid.uuid4().hex if batch is None else batch, columns, run_col, fmt)


def write_encoded(encoded: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K8: encoded examples as Parquet, one folder per environment."""
    encoded.write.mode(mode).partitionBy("env").parquet(path)


def write_head_snapshots(weights: DataFrame, path: str, steps_per_folder: int = 1) -> None:
    """K9: head weights (step, env, w) appended as Parquet, a folder per step or per range of steps."""
    if steps_per_folder == 1:
        weights.write.mode("append").partitionBy("step").parquet(path)
    else:
        part = F.floor(F.col("step") / int(steps_per_folder))
        weights.withColumn("steps_from", part * int(steps_per_folder)).write.mode("append").partitionBy("steps_from").parquet(path)
