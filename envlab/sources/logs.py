"""Metric-log discovery and header-aware reading.

The reference keeps one ``csv_logs/eval.csv`` per run directory, and files may differ in their
header (``loss`` can be missing). Spark's CSV reader maps every file by position onto one schema,
which puts columns in the wrong place for such files. Here every file is read as text lines in
one distributed scan; each file's header line is paired with its data lines through the file
path, so each value lands under its own column name. ``eval.csv`` may be a file or a directory of
part files (what a Spark writer makes).
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.functions.names import lr_from_path
from envlab.session import materialize
from envlab.sinks.appendlog import COMMITS, RUNS, append, commit, commit_names, committed, read_log, read_paths, write_attempt
from envlab.sinks.files import log_root

# The columns of the three logs, as their writers name them.
EVAL_COLUMNS = [
    "step", "loss", "accuracy", "f1_macro", "corr_support_f1_pearson_r", "corr_support_f1_spearman_rho",
    "f1_head", "f1_tail", "gap_head_tail",
]
TRAINING_COLUMNS = ["step", "train_loss", "train_loss_moving_avg", "round"]
HEADS_COLUMNS = ["step", "l2_mean", "cosine_mean", "js_mean", "disagree_mean"]


def _qualified(spark: SparkSession, base: str) -> str:
    """Path part of ``base`` as Spark reports it (decoded, without a scheme)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(fs.makeQualified(p).toUri().getPath()).rstrip("/")


def discover_logs(spark: SparkSession, base: str, name: str = "eval", only: Sequence[str] | None = None) -> DataFrame:
    """Lines of every ``**/csv_logs/<name>.csv`` below ``base``: a file, a folder of part files, or a
    committed log (``sinks.appendlog``), of which only the files that its commits name count:
    (path, run_dir, rel_path, line, and a line's ``_start`` and ``_at`` for :func:`parse_ragged`). ``run_dir`` is the run of a log of many runs, else the folder that
    holds ``csv_logs``. The path filter is applied to the file listing, so other logs are never opened, nor
    files that are not in ``only`` (``_metadata.file_path`` values), if given."""
    log = rf"/csv_logs/{re.escape(name)}\.csv"
    data, commits = rf"{log}(/attempt(=|%3D)[^/]+(/run(=|%3D)[^/]*|/{RUNS})?)?(/[^/]+)?$", rf"{log}/{COMMITS}/[^/]+$"
    encoded = F.col("_metadata.file_path")
    chosen = (F.lit(True) if only is None else encoded.isin(list(only))) & encoded.rlike(data) & ~encoded.rlike(commits)
    texts = spark.read.option("recursiveFileLookup", "true").text(base)
    named = committed(texts.where(encoded.rlike(commits)).select(read_paths(encoded).alias("path"), F.col("value").alias("line")))
    # what a path says is found once per file, from the listing
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(chosen)
    files = listed.select(encoded.alias("_of"), read_paths(encoded).alias("path"))
    appended = F.col("path").rlike(rf"{log}/attempt=")
    one = files.where(appended).join(named.select(F.concat_ws("/", "root", "file").alias("_file")), F.col("path") == F.col("_file"), "left_semi")
    root = _qualified(spark, base)
    files = files.where(~appended).unionByName(one).withColumn("_local", F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:(//[^/]*)?", ""))
    local = F.col("_local")
    files = files.select(
        "_of", "path", F.when(F.startswith(local, F.lit(root)), local.substr(F.lit(len(root) + 1), F.length(local))).otherwise(local).alias("rel_path"),
        read_paths(F.regexp_extract("path", rf"{log}/attempt=[^/]+/run=([^/]*)/", 1)).alias("_run"),
        F.regexp_extract("path", rf"([^/]+){log}(/|$)", 1).alias("_folder"), F.col("path").rlike(rf"{log}/attempt=[^/]+/{RUNS}/[^/]+$").alias("_packed"),
    )
    files = files.select(
        "_of", "path", "rel_path", F.coalesce(F.nullif("_run", F.lit("")), "_folder").alias("run_dir"), "_packed",
        F.regexp_extract("rel_path", rf"^(.*/){RUNS}/[^/]+$", 1).alias("_before"), F.regexp_extract("rel_path", r"(/[^/]+)$", 1).alias("_after"),
    )
    files = materialize(files, "log-paths")
    if files.isEmpty():
        raise FileNotFoundError(f"no csv_logs/{name}.csv below {base}")
    # a line's place in its file, numbered before any shuffle
    found = texts.where(chosen).select(
        encoded.alias("_file"), F.col("value").alias("_text"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")
    )
    lines = found.join(files, F.col("_file") == F.col("_of")).withColumn("_cell", F.when(F.col("_packed"), F.substring_index("_text", ",", 1)))
    # files of many runs: the first cell, free of quotes and commas, is the run, which goes into the path below the log
    return lines.select(
        "path", F.coalesce(F.url_decode("_cell"), "run_dir").alias("run_dir"),
        F.when(F.col("_packed"), F.concat("_before", F.lit("run="), "_cell", "_after")).otherwise(F.col("rel_path")).alias("rel_path"),
        F.when(F.col("_packed"), F.substring("_text", F.char_length("_cell") + 2, F.char_length("_text"))).otherwise(F.col("_text")).alias("line"), "_start", "_at",
    )


def _cells(line) -> F.Column:
    """Cells of a CSV line: split at commas outside quotes, blanks and quotes taken off. Most lines have no
    quotes and are split at their commas."""
    cells = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    quoted = F.transform(cells, lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"')))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.transform(F.split(line, ",", -1), lambda c: F.trim(c)))


def _headers(lines: DataFrame, key_col: str) -> DataFrame:
    """(path, _line, _header) of every file: its first line. A file's first split is read in order,
    so the first line has the smallest running id there. Fails on a file without ``key_col``."""
    start = lines.where(F.col("_start") == 0) if "_start" in lines.columns else lines
    numbered = start.where(F.length(F.trim("line")) > 0)
    if "_at" not in lines.columns:
        numbered = numbered.withColumn("_at", F.monotonically_increasing_id())
    h = numbered.groupBy("path").agg(F.min_by("line", "_at").alias("_line")).withColumn("_header", _cells(F.col("_line")))
    bad = h.where(~F.array_contains("_header", key_col)).select("path").head(1)
    if bad:
        raise ValueError(f"no column {key_col!r} in the header of {bad[0][0]}")
    return h


def parse_ragged(lines: DataFrame, keep: Sequence[str], key_col: str = "step") -> DataFrame:
    """Typed rows from header-carrying CSV lines of many files with different headers.

    A file's first line is its header, in any column order; cells may be quoted; missing columns
    and empty cells are NULL; ``nan`` cells are NaN (see :func:`missing_as_null`); a key written as
    a decimal (``250.0``) counts as its whole number.
    """
    names = [key_col, *(c for c in keep if c != key_col)]
    # where a file has each column is looked up once per file
    headers = _headers(lines, key_col)
    twice = F.size(F.array_distinct("_header")) < F.size("_header")
    header = F.when(twice, F.raise_error(F.concat(F.lit("a column name comes twice in the header of "), "path"))).otherwise(F.col("_header"))
    places = [F.array_position(header, F.lit(c)).cast("int").alias(f"_at{i}") for i, c in enumerate(names)]
    headers = headers.select(F.col("path").alias("_path"), "_line", *places)
    data = lines.where(F.length(F.trim("line")) > 0).join(headers, F.col("path") == F.col("_path"))
    j = data.where(F.col("line") != F.col("_line")).withColumn("_cells", _cells(F.col("line")))
    cell = [F.get("_cells", F.col(f"_at{i}") - 1) for i in range(len(names))]
    cols = [cell[0].try_cast("double").try_cast("long").alias(key_col)]
    cols += [F.nullif(x, F.lit("")).try_cast("double").alias(c) for x, c in zip(cell[1:], names[1:])]
    other = [c for c in lines.columns if c not in ("line", "_start", "_at")]
    return j.select(*other, *cols)


def available_columns(lines: DataFrame, key_col: str = "step") -> list[str]:
    """Columns found in at least one header (P12). Reads only the distinct headers."""
    h = _headers(lines, key_col).select(F.explode("_header").alias("c")).distinct()
    return [r[0] for r in h.collect()]


def missing_as_null(c: str):
    """Q3: NaN counts as missing (pandas skips it in mean/std/count)."""
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def read_eval_logs(spark: SparkSession, base: str, keep: Sequence[str] = tuple(EVAL_COLUMNS),
                   lines: DataFrame | None = None) -> DataFrame:
    """S5 + S6 + F9: every run's eval rows with ``lr`` parsed from the path below ``base``; runs
    without a learning rate in their path are dropped. ``lines`` are already discovered lines."""
    lines = discover_logs(spark, base, "eval") if lines is None else lines
    rows = parse_ragged(lines, keep)
    return rows.withColumn("lr", lr_from_path(F.col("rel_path"))).where(F.col("lr").isNotNull())


LOG_TYPES = {"step": "long", "round": "long"}


def read_metric_log(spark: SparkSession, base: str, name: str, columns: Sequence[str], fmt: str = "csv") -> DataFrame:
    """The committed rows of the log ``<base>/csv_logs/<name>.csv``: ``run`` (NULL if it is one run's) and
    ``columns`` (a step and a round are whole numbers, all else doubles; empty cells are NULL)."""
    schema = ", ".join(f"`{c}` {LOG_TYPES.get(c, 'double')}" for c in columns)
    return read_log(spark, log_root(base, name, fmt), schema, fmt).select("run", *columns)


def _listed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """(file, size, changed) of the log files below ``base`` that count (plain ones, and of committed logs
    those that a commit names), from their listing: only commits are opened."""
    log = rf"/csv_logs/{re.escape(name)}\.csv"
    encoded = F.col("_metadata.file_path")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(encoded.rlike(rf"{log}(/.*)?$"))
    files = listed.select(encoded.alias("file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("changed"))
    files = files.where(~F.col("file").rlike(rf"{log}/{COMMITS}/"))
    texts = spark.read.option("recursiveFileLookup", "true").text(base).where(encoded.rlike(rf"{log}/{COMMITS}/[^/]+$"))
    named = committed(texts.select(read_paths(encoded).alias("path"), F.col("value").alias("line")))
    appended = read_paths(F.col("file")).rlike(rf"{log}/attempt=")
    one = files.where(appended).join(named.select(F.concat_ws("/", "root", F.col("file")).alias("_file")), read_paths(files["file"]) == F.col("_file"), "left_semi")
    return files.where(~appended).unionByName(one)


def refresh_logs(spark: SparkSession, base: str, state: str, name: str = "eval",
                 keep: Sequence[str] = tuple(EVAL_COLUMNS)) -> tuple[DataFrame, int]:
    """S5 again and again: the rows of :func:`read_eval_logs`, and the number of files opened for them.

    ``state`` (a folder of its own) remembers every file's size, time of change and rows, in committed logs
    (``sinks.appendlog``). Only files that are new or have changed since the last call are opened, whole,
    and their rows replace the remembered ones; files that are gone no longer count. A call that dies
    leaves the state as it was. The result equals a full read. One call at a time."""
    seen_root, rows_root, call = f"{state.rstrip('/')}/files", f"{state.rstrip('/')}/rows", uuid.uuid4().hex
    columns = ["path", "run_dir", "rel_path", *keep, "lr", "call"]
    types = {"path": "string", "run_dir": "string", "rel_path": "string", "call": "string", **LOG_TYPES}
    schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in columns)
    before = commit_names(spark, seen_root)
    now = materialize(_listed(spark, base, name), "log-files")
    seen = read_log(spark, seen_root, "file string, size long, changed long, call string", "parquet", before).drop("run")
    same = ["file", "size", "changed"]
    fresh = now.join(seen, same, "left_anti")
    opened = [r[0] for r in fresh.select("file").collect()]  # as many as changed since the last call
    if opened:
        rows = read_eval_logs(spark, base, keep, discover_logs(spark, base, name, opened)).withColumn("call", F.lit(call))
        append(rows, rows_root, call, columns, fmt="parquet")
    files = materialize(now.join(seen, same).unionByName(fresh.withColumn("call", F.lit(call))), "log-files")
    commit(spark, seen_root, call, write_attempt(files, seen_root, call, [*same, "call"], fmt="parquet"), before)
    # a file's rows are those of the call that read it as it is now
    current = files.select(read_paths(F.col("file")).alias("path"), "call")
    return read_log(spark, rows_root, schema, "parquet").drop("run").join(current, ["path", "call"], "left_semi").drop("call"), len(opened)
