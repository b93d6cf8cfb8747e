"""Environment example files.

Lines are ``text<TAB>label`` written raw. They are read as plain text and split at the last tab,
which keeps texts with quote characters intact (a quoting CSV reader swallows the following
lines after a leading ``"``, trap Q1).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.functions.text import non_blank

LINE_RE = r"^(.*)\t([^\t]*)$"


def parse_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``(text, labels)`` from raw lines; a line without a tab has NULL label and the whole line as text."""
    has_tab = F.col(line_col).contains("\t")
    text = F.when(has_tab, F.regexp_extract(line_col, LINE_RE, 1)).otherwise(F.col(line_col))
    label = F.when(has_tab, F.trim(F.regexp_extract(line_col, LINE_RE, 2)).try_cast("int"))
    others = [c for c in lines.columns if c != line_col]
    return lines.select(*others, text.alias("text"), label.alias("labels"))


def read_envs(spark: SparkSession, path: str) -> DataFrame:
    """S3: every environment in one scan, as ``(env, text, labels)``.

    Accepts the reference layout (``<dir>/env_1.txt``, ...: env = file name before the first
    dot) and the layout :func:`envlab.sinks.files.write_env_tsv` makes (``<dir>/env=env_1/``).
    """
    raw = spark.read.text(path)
    if "env" in raw.columns:
        lines = raw.select(F.col("env").cast("string"), "value")
    else:
        lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select(
            F.split(F.col("_metadata.file_name"), r"\.").getItem(0).alias("env"), "value"
        )
    return parse_lines(lines)


def read_pooled(spark: SparkSession, path: str, env: str = "erm") -> DataFrame:
    """One pooled file (or folder of parts) as a single environment."""
    return parse_lines(spark.read.text(path).select(F.lit(env).alias("env"), "value"))


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Drop empty or whitespace-only texts together with their labels."""
    return df.where(non_blank(text_col))
