"""Committed append logs.

A log is a folder. An append writes its rows to a data folder of its own, ``attempt=<epoch>-<unique>``,
and then one small file ``commits/<epoch>.txt`` that names the data files of the append and their number.
The commit file is written last and under its name at once, so readers, which take only files that a
complete commit names, see an append whole or not at all: what a killed append left behind is never read.
An epoch (a micro-batch's number, a step, any name) is committed once; appending it again does nothing, so
a replay doubles no row. A merge rewrites the rows of many commits as one and names the commits that it
stands for, so a long log is read from few folders.

Rows of many runs go into one log, in one distributed write for all of them: the data folder then has a folder
``runs`` of files that hold many runs each, sorted by run, with the run as their first column (percent-encoded). So
an append has as many files as its write has tasks, however many runs there are. Logs of older appends, with a
folder ``run=<run>`` per run, are read as well.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"
END = "end"  # the last line of a commit: "end <number of files>"
REPLACES = "replaces"  # a line of a merge's commit: "replaces <commit>"
RUNS = "runs"  # the folder of files that hold many runs
NO_RUN = "__HIVE_DEFAULT_PARTITION__"  # stands for a missing run


class _Store:
    """The log's folder on its file system (whatever Hadoop reads)."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self.jvm, self.path = jvm, jvm.org.apache.hadoop.fs.Path
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.path("/".join([str(self.root.toString()), *parts]))

    def files(self, folder: str) -> list[str]:
        """Names below the log of the data files of an append: as many as the write had tasks."""
        base = str(self.fs.makeQualified(self.root).toString()).rstrip("/") + "/"
        found, it = [], self.fs.listFiles(self.at(folder), True)
        while it.hasNext():
            p = it.next().getPath()
            if not p.getName().startswith(("_", ".")):
                found.append(str(p.toString())[len(base):])
        return sorted(found)

    def put(self, name: str, text: str) -> bool:
        """Write a small file under its name at once; False if it is there already."""
        target, temp = self.at(COMMITS, name), self.at(COMMITS, f".{uuid.uuid4().hex}")
        if self.fs.exists(target):
            return False
        out = self.fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.rename(temp, target):
            return True
        self.fs.delete(temp, False)
        if self.fs.exists(target):
            return False
        raise OSError(f"cannot commit {target.toString()}")


def _commit_name(epoch) -> str:
    name = str(epoch)
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", name):
        raise ValueError(f"not a name for an epoch: {name!r}")
    return f"{name}.txt"


def write_attempt(rows: DataFrame, root: str, epoch, columns: Sequence[str], run_col: str | None = None, fmt: str = "csv") -> str:
    """Write the rows of an append to a data folder of its own and return the folder's name. Until
    :func:`commit`, no reader sees it. Every column of ``columns`` is written, missing ones empty."""
    _commit_name(epoch)
    folder = f"attempt={epoch}-{uuid.uuid4().hex}"
    cols = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    path = f"{root.rstrip('/')}/{folder}"
    if run_col is None:
        out = rows.select(*cols).write
    else:
        # a run's rows in few files, without a large run in one task
        run = F.coalesce(F.url_encode(F.nullif(F.col(run_col).cast("string"), F.lit(""))), F.lit(NO_RUN))
        order = ["_run", "step"] if "step" in columns else ["_run"]
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = rows.select(run.alias("_run"), *cols).repartitionByRange(parts, *order).sortWithinPartitions(*order).write
        path = f"{path}/{RUNS}"
    if fmt == "csv":
        out.option("header", True).csv(path)
    else:
        out.parquet(path)
    return folder


def commit(spark: SparkSession, root: str, epoch, folder: str, replaces: Sequence[str] = ()) -> bool:
    """Make the data files of ``folder`` part of the log; False if the epoch is committed already."""
    store = _Store(spark, root)
    names = store.files(folder)
    lines = [*(f"{REPLACES} {c}" for c in replaces), *names, f"{END} {len(names)}"]
    return store.put(_commit_name(epoch), "\n".join(lines) + "\n")


def has_commits(spark: SparkSession, root: str) -> bool:
    store = _Store(spark, root)
    return bool(store.fs.exists(store.at(COMMITS)))


def is_committed(spark: SparkSession, root: str, epoch) -> bool:
    store = _Store(spark, root)
    return bool(store.fs.exists(store.at(COMMITS, _commit_name(epoch))))


def append(rows: DataFrame, root: str, epoch, columns: Sequence[str], run_col: str | None = None, fmt: str = "csv") -> bool:
    """K7: append ``rows`` to the log as ``epoch``; False (and nothing written) if that is committed."""
    spark = rows.sparkSession
    if is_committed(spark, root, epoch):
        return False
    return commit(spark, root, epoch, write_attempt(rows, root, epoch, columns, run_col, fmt))


def committed(lines: DataFrame) -> DataFrame:
    """(root, commit, file) of the data files that complete and unreplaced commits name, from the lines
    (path, line) of the commit files of any number of logs."""
    c = lines.select(
        F.regexp_extract("path", rf"^(.*)/{COMMITS}/[^/]+$", 1).alias("root"), F.regexp_extract("path", r"([^/]+)$", 1).alias("commit"), "line"
    )
    ends, replaced = F.startswith("line", F.lit(f"{END} ")), F.startswith("line", F.lit(f"{REPLACES} "))
    whole = c.groupBy("root", "commit").agg(
        F.count_if(~ends & ~replaced).alias("n"), F.max(F.when(ends, F.substring("line", len(END) + 2, 20).try_cast("long"))).alias("said")
    ).where("n = said").select("root", "commit")
    c = c.join(whole, ["root", "commit"], "left_semi")
    gone = c.where(replaced).select("root", F.substring(F.col("line"), len(REPLACES) + 2, 10_000).alias("commit")).distinct()
    return c.where(~ends & ~replaced).join(gone, ["root", "commit"], "left_anti").select("root", "commit", F.col("line").alias("file"))


def read_paths(path) -> F.Column:
    """A ``_metadata.file_path`` as it is named (percent signs decoded)."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """:func:`committed` of one log."""
    lines = spark.read.text(f"{root.rstrip('/')}/{COMMITS}").select(read_paths(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("line"))
    return committed(lines)


def read_log(spark: SparkSession, root: str, schema: str, fmt: str = "csv", commits: Sequence[str] | None = None) -> DataFrame:
    """The committed rows of a log (of some ``commits`` only, if named): the columns of ``schema`` and
    ``run`` (NULL for a log without runs). Only data folders that a commit names are opened, and in them
    only the named files."""
    base = root.rstrip("/")
    if not has_commits(spark, base):
        return spark.createDataFrame([], f"{schema}, run string")
    files = read_commits(spark, base)
    if commits is not None:
        files = files.where(F.col("commit").isin(list(commits)))
    # a folder per append since the last merge
    folders = sorted(r[0] for r in files.select(F.regexp_extract("file", rf"^([^/]+(?:/{RUNS}(?=/))?)/", 1).alias("f")).distinct().collect())
    if not folders:
        return spark.createDataFrame([], f"{schema}, run string")
    packed = [f"{base}/{f}" for f in folders if f.endswith(f"/{RUNS}")]
    single = [f"{base}/{f}" for f in folders if not f.endswith(f"/{RUNS}")]

    def load(paths: list[str], columns: str) -> DataFrame:
        reader = spark.read.schema(columns).option("recursiveFileLookup", "true")
        rows = reader.option("header", True).csv(paths) if fmt == "csv" else reader.parquet(*paths)
        return rows.withColumn("_path", F.col("_metadata.file_path"))

    parts = []
    if single:
        # older appends have a folder per run, named as Spark escapes it
        escaped = F.url_decode(F.replace(F.regexp_extract("_path", r"/run=([^/]*)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
        parts.append(load(single, schema).withColumn("_run", F.nullif(F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B"))), F.lit(""))))
    if packed:
        parts.append(load(packed, f"_run string, {schema}").withColumn("_run", F.url_decode("_run")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # names are compared as they stand below the log
    name = F.regexp_extract("_path", rf"/(attempt=[^/]+/(?:run=[^/]*/|{RUNS}/)?[^/]+)$", 1)
    named = files.select(F.col("file").alias("_file"))
    kept = rows.withColumn("_name", read_paths(name)).join(named, F.col("_name") == F.col("_file"), "left_semi")
    return kept.withColumn("run", F.when(F.col("_run") != NO_RUN, F.col("_run"))).drop("_path", "_name", "_run")


def commit_names(spark: SparkSession, root: str) -> list[str]:
    """The commits that are read: complete and not replaced, as many as appends since the last merge."""
    if not has_commits(spark, root):
        return []
    return sorted(r[0] for r in read_commits(spark, root).select("commit").distinct().collect())


def merge(spark: SparkSession, root: str, epoch, schema: str, columns: Sequence[str], runs: bool = False, fmt: str = "csv",
          combine: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Rewrite all committed rows (put through ``combine``, if given) as one append, ``epoch``, that stands
    for the commits read. Commits that come meanwhile stay as they are. The old files are left for
    :func:`vacuum`."""
    names = commit_names(spark, root)
    if not names or is_committed(spark, root, epoch):
        return False
    rows = read_log(spark, root, schema, fmt, names)
    folder = write_attempt(combine(rows) if combine else rows, root, epoch, columns, "run" if runs else None, fmt)
    return commit(spark, root, epoch, folder, names)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete data folders that no unreplaced commit names (of killed, replayed or merged appends) and
    return their number. Only while nothing is appended or read."""
    store = _Store(spark, root)
    folder = F.regexp_extract("file", r"^([^/]+)/", 1)
    held = {r[0] for r in read_commits(spark, root).select(folder).distinct().collect()}
    gone = 0
    for st in store.fs.listStatus(store.root):
        name = st.getPath().getName()
        if name.startswith("attempt=") and name not in held:
            gone += bool(store.fs.delete(st.getPath(), True))
    return gone
