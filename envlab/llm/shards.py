"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from one range-partitioned, sorted copy of the rows in the shared folder: a row's
number is its place in its file plus the rows of all files before it. Equal sort keys are spread
over partitions too, so a key that holds a third of the rows does not meet in one task. The
permuted number p gives shard p % n and slot p // n: shard sizes differ by one row at most, slots
have no gaps, and ``locate`` computes both for any row number without reading data.

Only DataFrame functions are used.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from envlab.llm.common import column, shared_uri

SEED = 20240917
ROUNDS = 6
# Cycle walking leaves a domain of a*a >= n numbers, a = ceil(sqrt(n)). At most a*a - n <= 2a steps
# lie outside; for n over MAX_WALK**2 each further step is needed with a chance below 2 / sqrt(n).
MAX_WALK = 64


def _walk_steps(n: int, a: int) -> int:
    return min(a * a - n, MAX_WALK)


def permute(number: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The permuted place in [0, n) of a row number in [0, n): a Feistel network over the digit
    pairs (l, r) in base a, walked on until the value falls below n. Raises if the walk is not over
    after the bounded number of steps (possible only for n above MAX_WALK**2, and there with a
    chance below (2 / sqrt(n)) ** MAX_WALK)."""
    if n <= 0:
        return number.cast("long")
    a = max(1, math.isqrt(n - 1) + 1)

    def feistel(x: Column) -> Column:
        step = lambda s, k: F.struct(
            s["r"].alias("l"),
            F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k, F.lit(seed)), F.lit(a)), F.lit(a)).cast("long").alias("r"),
        )
        start = F.struct(F.floor(x / a).cast("long").alias("l"), F.pmod(x, F.lit(a)).cast("long").alias("r"))
        return F.aggregate(F.array(*[F.lit(k) for k in range(rounds)]), start, step, lambda s: s["l"] * F.lit(a) + s["r"])

    first = feistel(number.cast("long"))
    steps = _walk_steps(n, a)
    if steps:
        first = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), first, lambda x, _: F.when(x < n, x).otherwise(feistel(x))
        )
    return F.when(first < n, first).otherwise(F.raise_error(F.lit("cycle walk not finished")).cast("long"))


def locate(number: Column, n: int, shards: int, seed: int = SEED) -> tuple[Column, Column]:
    """Shard and slot of a row number."""
    p = permute(number, n, seed)
    return F.pmod(p, F.lit(shards)).cast("int"), F.floor(p / shards).cast("long")


def number_rows(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with its global row number (from 0) in the order of ``keys`` (NULLs first), and the
    number of rows. Rows equal in all keys get consecutive numbers in no particular order."""
    spark = df.sparkSession
    path = shared_uri(spark, "numbered")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = "__tie"
    cols = [F.col(k) for k in keys]
    (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(parts, *cols, F.col(tie))
        .sortWithinPartitions(*cols, F.col(tie))
        .drop(tie)
        .write.parquet(path)
    )
    stored = spark.read.schema(df.schema).parquet(path)
    # one row per written file, so as many as partitions
    files = stored.groupBy(F.col("_metadata.file_name").alias("__file")).agg(F.count(F.lit(1)).alias("__n"))
    total = files.agg(F.sum("__n")).first()[0] or 0
    before = files.select(
        "__file",
        (F.sum("__n").over(Window.orderBy("__file")) - F.col("__n")).alias("__before"),
    )
    numbered = (
        stored.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        .join(F.broadcast(before), "__file")
        .withColumn(name, (F.col("__before") + F.col("__at")).cast("long"))
        .drop("__file", "__at", "__before")
    )
    return numbered, total


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """Documents with ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``row_number``, ``shard`` and
    ``slot``.

    Row numbers follow (doc_id, text_crc32, size), so the result depends on the rows alone. A NULL
    text counts as empty, NULL ids come first, repeated rows take one slot each, an empty table
    gives no rows, and input columns with the names above are replaced; others stay, whatever their
    names."""
    made = ["size", "text_crc32", "row_number", "shard", "slot"]
    kept = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct(*[column(c) for c in kept]).alias("row")).select(
        "row", F.col("row.doc_id").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["id", "text_crc32", "size"])
    shard, slot = locate(F.col("row_number"), n, shards, seed)
    return numbered.select("row.*", "size", "text_crc32", "row_number", shard.alias("shard"), slot.alias("slot"))
