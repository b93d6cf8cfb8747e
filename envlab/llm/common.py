"""Helpers shared by the operators: the shared folder, stored intermediates and word columns.

Every intermediate that is read more than once is written below ``spark.checkpoint.dir`` (which
all executors see) and read back, so a lost executor costs a re-read and never a recomputation.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.session import ensure_checkpoint_dir, ship_package

# Rows of one key that a join leaves together, and the most keys whose rows it spreads.
SPREAD_ROWS = 1000
SPREAD_KEYS = 100_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> None:
    """Make the shared folder and the package available (idempotent)."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as a fully qualified URI (not created)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = str(fs.makeQualified(path).toString()).rstrip("/")
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/"):].lstrip("/")
    return f"{uri}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts the lineage)."""
    path = shared_uri(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the built-in ``lower`` (the same there)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words_of(text: Column, separators: str) -> Column:
    """Words of the lower-cased (A-Z) text: the maximal runs of characters outside the class
    ``separators``. NULL and empty texts have no words."""
    lowered = lower_ascii(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, f"[{separators}]+"), "")


def column(name: str) -> Column:
    """The column of this very name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def join_first(rows: DataFrame, first: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``first``, a stored table of one row per key (columns ``on``, not NULL) with
    ``n``, the number of the key's rows. A key of many rows is dealt over several tasks by ``spread``, a
    column that differs among them, and its row of ``first`` is repeated for each. Such keys are looked
    up in a broadcast table of at most SPREAD_KEYS rows: they hold SPREAD_ROWS rows or more, and more than
    one in SPREAD_KEYS of all."""
    total = first.agg(F.sum("n")).first()[0] or 0
    most = max(SPREAD_ROWS, -(-total // SPREAD_KEYS))
    shares = F.ceil(F.col("n") / most).cast("int")
    hot = first.where(F.col("n") > most).select(*[F.col(c).alias(f"hot_{c}") for c in on], shares.alias("hot_shares"))
    same = [F.col(c) == F.col(f"hot_{c}") for c in on]
    dealt = rows.join(F.broadcast(hot), same, "left").withColumn(
        "share", F.when(F.col("hot_shares").isNotNull(), F.pmod(F.xxhash64(spread), F.col("hot_shares"))).otherwise(F.lit(0)).cast("int")
    ).drop("hot_shares", *[f"hot_{c}" for c in on])
    copies = F.when(F.col("n") > most, shares).otherwise(F.lit(1))
    each = first.withColumn("share", F.explode(F.sequence(F.lit(0), copies - 1))).drop("n")
    return dealt.join(each, [*on, "share"], how).drop("share")
