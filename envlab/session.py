"""Session helpers: building a session, the shared scratch folder and size-checked joins."""
from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables of at most so many rows, and bytes as Parquet, are broadcast; larger ones take a shuffle join.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one with settings suited to these jobs.

    On a cluster the session already exists (spark-submit); only local runs build one here.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName("envlab")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting is always used when present. Only a local-mode session without one
    (tests, a laptop) gets a fresh folder of its own; on a cluster a missing setting is an error,
    because a machine-local folder would not be visible to the other executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
        return str(d)
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) for this job")
    d = tempfile.mkdtemp(prefix="envlab-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> None:
    """Make ``envlab`` importable in Python workers (what ``--py-files`` does): the package is
    zipped once on the driver and handed to ``addPyFile``; Spark serves it to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_envlab_shipped", False):
        return
    import os
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="envlab-pkg-"), "envlab.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    sc._envlab_shipped = True


def is_dir(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a directory, on any Hadoop-compatible file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder path below the shared checkpoint folder (not created)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("file:"):
        base = base[len("file:"):]
    return f"{base}/envlab-{name}-{uuid.uuid4().hex}"


def join_small(
    big: DataFrame,
    small: DataFrame,
    on,
    how: str = "inner",
    max_rows: int = BROADCAST_MAX_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Join ``big`` with a table expected to be small, broadcasting it only within a checked size.

    ``rows`` is a bound already known on the driver (a parameter table, a vocabulary of a given
    size, a table with one row per group whose groups were counted). Without it ``small`` is
    materialised and measured (one cheap job). Up to ``max_rows`` rows and BROADCAST_MAX_BYTES bytes it
    is broadcast; beyond that the planner's shuffle join is used, so a table that turns out large never
    lands whole in every executor.
    """
    size = 0
    if rows is None:
        small, rows, size = measure(small)
    side = F.broadcast(small) if rows <= max_rows and size <= BROADCAST_MAX_BYTES else small
    return big.join(side, on, how)


# Small derived tables up to this many rows of short values are brought to the driver and re-created as
# local relations; larger ones are stored in the shared folder instead.
LOCAL_MAX_ROWS = 100_000
LOCAL_MAX_CHARS = 256  # of a text; arrays may hold a quarter of it


def _shortened(field: T.StructField) -> tuple[Column, Column] | None:
    """A column cut to a bounded size, and whether it was longer; None for types without such a cut."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.substring(c, 1, LOCAL_MAX_CHARS), F.coalesce(F.octet_length(c) > LOCAL_MAX_CHARS, F.lit(False))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        most = LOCAL_MAX_CHARS // 4
        return F.slice(c, 1, most), F.coalesce(F.size(c) > most, F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return None
    return c, F.lit(False)


def measure(df: DataFrame, local_max: int = LOCAL_MAX_ROWS) -> tuple[DataFrame, int, int]:
    """Materialise a small derived table (per-class cut-offs, class ids, ...) and return it with
    its rows and bytes, which is the size check before any broadcast.

    One job reads at most ``local_max + 1`` rows, every value cut to a bounded size. If nothing was cut off,
    the rows become a local relation: no lineage to recompute, nothing cached, nothing lost with an
    executor (its bytes are bounded by that and given as 0). Else the table is stored in the shared folder,
    and counted and measured there."""
    spark = df.sparkSession
    cuts = [_shortened(f) for f in df.schema]
    if all(cuts):
        longer = reduce(lambda a, b: a | b, [x for _, x in cuts], F.lit(False))
        rows = df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cuts)], longer.alias("longer")).limit(local_max + 1).collect()
        if len(rows) <= local_max and not any(r["longer"] for r in rows):
            return spark.createDataFrame([tuple(r)[:-1] for r in rows], df.schema), len(rows), 0
    path = scratch_path(spark, "measured")
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return stored, stored.count(), fs.getContentSummary(folder).getLength()


def count_small(df: DataFrame, local_max: int = LOCAL_MAX_ROWS) -> tuple[DataFrame, int]:
    """:func:`measure` without the bytes."""
    return measure(df, local_max)[:2]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as Parquet below the shared checkpoint folder and read it
    back: the stage boundary a multi-step job would have between its steps."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
