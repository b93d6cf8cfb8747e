"""Labelled corpora in named splits (S1) with text-column and gender-coding detection."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envlab.session import join_small

RESERVED = ("profession", "gender", "example_id", "split", "_file")

# Fixed values of the reference: the two string codes of gender, in (0, 1) order.
GENDER_STRINGS = ("male", "female")


def detect_text_col(df: DataFrame) -> str:
    """First column that is neither ``profession`` nor ``gender`` (nor our own key / split columns)."""
    for c in df.columns:
        if c not in RESERVED:
            return c
    raise ValueError("no text column found")


def encoder_text_col(df: DataFrame) -> str:
    """The column that the encoder takes as text: ``content`` if there is one, else the first."""
    return "content" if "content" in df.columns else df.columns[0]


def gender_code(df: DataFrame, col: str = "gender"):
    """0/1 gender code decided by the column's *type*: integers are taken as they are, strings map
    'male' -> 0 and 'female' -> 1. Anything else becomes NULL and is excluded from both sides."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)):
        c = c.cast("int")
        return F.when(c.isin(0, 1), c)
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s == GENDER_STRINGS[0], F.lit(0)).when(s == GENDER_STRINGS[1], F.lit(1))


def normalise_corpus(df: DataFrame, split: str | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Project a raw corpus onto ``(example_id, text, profession, gender, split)`` and ``extra`` columns."""
    text_col = detect_text_col(df)
    cols = [
        F.col("example_id").cast("long").alias("example_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col("profession").cast("string").alias("profession"),
        gender_code(df).alias("gender"),
    ]
    cols.append(F.lit(split).alias("split") if split is not None else F.col("split").cast("string").alias("split"))
    return df.select(*cols, *extra)


def read_corpus(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Read one dataset per split and stack them (S1 + U1): ``{"train": path, "dev": path, ...}``.

    Rows are told apart by ``example_id``. Parquet data without such a column gets its positions as ids,
    counted through the splits in the order given (:func:`positions`); other formats need the column."""
    if not paths:
        raise ValueError("no splits given")
    raw = {split: spark.read.format(fmt).load(path) for split, path in paths.items()}
    without = [split for split, df in raw.items() if "example_id" not in df.columns]
    if without:
        if len(without) < len(raw):
            raise ValueError(f"splits {without} have no example_id, others have")
        if fmt != "parquet":
            raise ValueError(f"{fmt} data needs an example_id column: only Parquet rows have a position")
        return positions(raw)
    out = None
    for split, df in raw.items():
        x = normalise_corpus(df, split)
        out = x if out is None else out.unionByName(x)
    return out


def positions(raw: Mapping[str, DataFrame]) -> DataFrame:
    """The corpus of Parquet splits with every row's position as ``example_id``: files in the order of their
    paths, rows in their order in the file, split after split. The same for every read of the same files,
    however they are cut into tasks: a row's index in its file is added to the rows of the files before,
    which are summed over a table of one row per file."""
    out = files = None
    for number, (split, df) in enumerate(raw.items()):
        file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        x = normalise_corpus(df.select(*[F.col(f"`{c}`") for c in df.columns], file.alias("_file"), row.alias("example_id")), split, ["_file"])
        n = df.select(file.alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
        n = n.select(F.lit(number).alias("_split"), "_file", "n")
        x = x.withColumn("_split", F.lit(number))
        out, files = (x, n) if out is None else (out.unionByName(x), files.unionByName(n))
    before = Window.orderBy("_split", "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_split", "_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    j = join_small(out, starts, ["_split", "_file"])
    return j.withColumn("example_id", F.col("example_id") + F.col("_start")).drop("_split", "_file", "_start")


def at_positions(corpus: DataFrame, chosen: DataFrame, keep: bool = True) -> DataFrame:
    """H2: the rows of ``corpus`` at the positions (``example_id``) of ``chosen``, or all others."""
    return corpus.join(chosen.select("example_id"), "example_id", "left_semi" if keep else "left_anti")
