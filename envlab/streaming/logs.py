"""Growing metric logs as streams.

X1  append-only log: a file-source stream into an append-mode file sink with a checkpoint; logs that a
    micro-batch writes itself are committed logs (``sinks.appendlog``).
X2  running moving average of the last 20 losses per run in the order of steps, state carried across
    micro-batches with ``applyInPandasWithState`` (a ``rowsBetween`` window is not allowed on a stream).
X3  log cadence: keep every n-th step after the moving average.
X4  evaluation of snapshots every n steps, each once and whole.
X5  heads-log compaction: the two half-empty rows of a step merged into one, in a committed log that is
    merged as it grows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from envlab.operators.heads import HEADS_COLS
from envlab.operators.moving import WINDOW
from envlab.session import join_small, materialize
from envlab.sinks import appendlog as AL
from envlab.sources.logs import HEADS_COLUMNS

TRAIN_SCHEMA = "run long, step long, train_loss double"
MA_SCHEMA = "run long, step long, train_loss double, train_loss_moving_avg double, n_late long"
# of the runs of a group, by place
MA_STATE = (
    "runs array<long>, buf array<array<double>>, last array<long>, seen array<long>, steps array<array<long>>,"
    " losses array<array<double>>, late array<long>"
)
MA_BLOCK_STATE = f"{MA_STATE}, blocks array<long>"
STATE_GROUPS = 1024  # states that the runs of a stream share
LATENESS = 10_000  # steps that a row may come after later ones


SLICE = 1 << 16


def window_means(values: np.ndarray, window: int) -> np.ndarray:
    """Mean of the non-missing values among each value and the ``window - 1`` before it (NaN where
    there is none). Every window is summed on its own, a slice of rows at a time."""
    padded = np.concatenate([np.full(window - 1, np.nan), values])
    out = np.empty(len(values))
    for at in range(0, len(values), SLICE):
        part = np.lib.stride_tricks.sliding_window_view(padded[at:at + SLICE + window - 1], window)
        n = (~np.isnan(part)).sum(axis=1)
        out[at:at + SLICE] = np.where(n > 0, np.nansum(part, axis=1) / np.maximum(n, 1), np.nan)
    return out


def in_order(steps: np.ndarray, losses: np.ndarray, last: int | None, seen: int | None, lateness: int, stride: int):
    """What can go out of the rows held and come: (rows to emit, rows to hold, rows that are too late), as
    places, and the last step emitted and the greatest seen. A row goes out when its predecessor, the step
    ``stride`` before it, has, or when a step ``lateness`` or more beyond it was seen, so that no row it
    waits for may come any more; a row at or before the last one emitted is too late."""
    order = np.lexsort((losses, steps))
    late = [] if last is None else order[steps[order] <= last].tolist()
    rest = order if last is None else order[steps[order] > last]
    seen = max([*([] if seen is None else [seen]), *steps.tolist()])
    out = []
    for k, at in enumerate(rest.tolist()):
        step = int(steps[at])
        if step <= (0 if last is None else last + stride) or step + lateness <= seen:
            out.append(at)
            last = step
        else:
            return out, rest[k:].tolist(), late, last, seen
    return out, [], late, last, seen


def _moving_avg_state(window: int, lateness: int, stride: int, block: int | None = None):
    def one(held: tuple, new_steps: np.ndarray, new_losses: np.ndarray, start: int):
        """A run's new state and what it emits: steps, losses, means and numbers of late rows. Of a block, which
        begins at step ``start``, the rows before it only fill the first windows."""
        buf, last, seen, steps, losses, late = held
        steps = np.concatenate([np.array(steps, dtype="int64"), new_steps])
        losses = np.concatenate([np.array(losses, dtype="float64"), new_losses])
        out, wait, missed, last, seen = in_order(steps, losses, last, seen, lateness, stride)
        full = np.concatenate([np.asarray(list(buf), dtype="float64"), losses[out]])
        means = window_means(full, window)[len(buf):]
        keep = full[-(window - 1):].tolist() if window > 1 else []
        if start:
            before = int((steps[out] < start).sum())
            out, means, missed = out[before:], means[before:], [at for at in missed if steps[at] >= start]
        rows = [*out, *missed]
        numbers = np.concatenate([np.zeros(len(out), dtype="int64"), late + 1 + np.arange(len(missed), dtype="int64")])
        after = (keep, last, seen, steps[wait].tolist(), losses[wait].tolist(), late + len(missed))
        return after, steps[rows], losses[rows], np.concatenate([means, np.full(len(missed), np.nan)]), numbers

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [p for p in pdfs if len(p)]
        if not parts:
            return
        runs = {}
        if state.exists:
            names, *fields = state.get
            places = fields.pop() if block else [0] * len(names)
            runs = dict(zip(zip(names, places), zip(*fields)))
        pdf = pd.concat(parts)
        run, none, place = pdf["run"].to_numpy(dtype="int64"), pdf["none"].to_numpy(dtype=bool), pdf["block"].to_numpy(dtype="int64")
        order = np.lexsort((place, run, none))
        run, none, place = run[order], none[order], place[order]
        steps, losses = pdf["step"].to_numpy(dtype="int64")[order], pdf["train_loss"].to_numpy(dtype="float64")[order]
        change = (run[1:] != run[:-1]) | (none[1:] != none[:-1]) | (place[1:] != place[:-1])
        edges = np.flatnonzero(np.concatenate([[True], change, [True]]))
        done = []
        for a, b in zip(edges[:-1], edges[1:]):
            name = (None if none[a] else int(run[a]), int(place[a]))
            start = name[1] * (block or 0) * stride
            held = runs.get(name, ([], start - window * stride if start else None, None, [], [], 0))
            runs[name], *emitted = one(held, steps[a:b], losses[a:b], start)
            done.append((a, *emitted))
        names, places = zip(*runs)
        state.update((list(names), *map(list, zip(*runs.values())), *([list(places)] if block else [])))
        of = np.repeat([d[0] for d in done], [len(d[1]) for d in done])
        yield pd.DataFrame({
            "run": pd.arrays.IntegerArray(run[of], none[of]), "step": np.concatenate([d[1] for d in done]),
            "train_loss": np.concatenate([d[2] for d in done]),
            "train_loss_moving_avg": np.concatenate([d[3] for d in done]), "n_late": np.concatenate([d[4] for d in done]),
        })

    return fn


def moving_average_stream(source: DataFrame, window: int = WINDOW, lateness: int = LATENESS, stride: int = 1,
                          groups: int = STATE_GROUPS, block: int | None = None) -> DataFrame:
    """X2 on a streaming DataFrame of (run, step, train_loss): ``train_loss_moving_avg`` over the last
    ``window`` rows in the order of steps, whatever order they come in.

    A run starts at step 0 and goes on by ``stride``; a row is held in the run's state until its predecessor
    has gone out, or until a step ``lateness`` beyond it was seen (steps are missing then). So the result
    equals the batch's for any order of arrival within ``lateness``. A row that comes after its successors
    have gone out has no average (NULL) and ``n_late``, its number among the run's late rows; rows in time
    have ``n_late`` 0. A run's state holds the last ``window - 1`` losses and the rows of less than
    ``lateness`` steps that wait. Runs share ``groups`` states by their hash, so a micro-batch calls Python
    once per group and not once per run.

    With ``block`` (for runs whose steps all come) a row waits for its predecessors however late they come, and
    ``lateness`` does not count. As up to a whole run may wait then, a run is cut into blocks of ``block`` steps
    that wait on their own, each with copies of the ``window - 1`` rows before it, and the blocks of all runs share
    the states: no state holds a long run. ``n_late`` numbers the rows of a block that come again."""
    if block and block < window:
        raise ValueError("block must be at least the window")
    none = F.col("run").isNull()
    place, unit = F.lit(0).cast("long"), ["run"]
    if block:
        # a row goes to its own block, and a block's last rows to the next block as well
        span = int(block) * stride
        own, in_tail = F.floor(F.col("step") / span).cast("long"), F.pmod(F.col("step"), F.lit(span)) >= span - (window - 1) * stride
        place, unit = F.explode(F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))), ["run", "block"]
        lateness = span + window * stride
    rows = source.select("run", "step", "train_loss", place.alias("block")).select(
        F.pmod(F.xxhash64(*unit), F.lit(int(groups))).alias("grp"), F.coalesce("run", F.lit(0)).alias("run"), none.alias("none"), "block", "step", "train_loss",
    )
    return rows.groupBy("grp").applyInPandasWithState(
        _moving_avg_state(window, lateness, stride, block), MA_SCHEMA, MA_BLOCK_STATE if block else MA_STATE, "append", GroupStateTimeout.NoTimeout
    )


def run_moving_average_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                              window: int = WINDOW, every: int | None = None, files_per_trigger: int | None = 1,
                              lateness: int = LATENESS, stride: int = 1, block: int | None = None) -> None:
    """X1 + X2 (+ X3): process every log file available under ``source_dir`` (Parquet parts of
    ``TRAIN_SCHEMA``) in micro-batches (one, if ``files_per_trigger`` is None), appending rows with their moving
    average to ``sink_dir``, also where steps arrive out of order (:func:`moving_average_stream`, also for
    ``block``). Restartable from ``checkpoint_dir``."""
    src = spark.readStream.schema(TRAIN_SCHEMA)
    if files_per_trigger:
        src = src.option("maxFilesPerTrigger", files_per_trigger)
    out = moving_average_stream(src.parquet(source_dir), window, lateness, stride, block=block)
    if every:
        out = out.where(F.pmod(F.col("step"), F.lit(int(every))) == 0)
    q = (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


HEADS_SCHEMA = "step long, l2_mean double, cosine_mean double, js_mean double, disagree_mean double"


MERGE_EVERY = 20


def _heads_of_steps(rows: DataFrame) -> DataFrame:
    return rows.groupBy("step").agg(*[F.max(c).alias(c) for c in HEADS_COLS])


def run_heads_compaction_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                                files_per_trigger: int = 1, merge_every: int = MERGE_EVERY) -> None:
    """The heads log compacted per step while it grows. Every micro-batch appends the steps it holds,
    compacted, to a committed log (``sinks.appendlog``) under its number, so a replay doubles nothing; the
    stream keeps no state. After ``merge_every`` appends the log is merged to one row per step, so however
    long it runs, a reader opens at most so many folders. Read with :func:`read_compacted_heads`."""
    src = spark.readStream.schema(HEADS_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)

    def write(batch: DataFrame, epoch_id: int) -> None:
        AL.append(_heads_of_steps(batch), sink_dir, epoch_id, HEADS_COLUMNS, fmt="parquet")
        if len(AL.commit_names(spark, sink_dir)) >= merge_every:
            AL.merge(spark, sink_dir, f"merge-{epoch_id}", HEADS_SCHEMA, HEADS_COLUMNS, fmt="parquet", combine=_heads_of_steps)

    q = src.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()


def read_compacted_heads(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The compacted heads log, one row per step. A step's halves may lie in several appends; the maximum
    merges them, in any order."""
    return _heads_of_steps(AL.read_log(spark, sink_dir, HEADS_SCHEMA, "parquet"))


def write_log_chunks(df: DataFrame, path: str, chunk_col: str, n_chunks: int, key: str | None = None) -> None:
    """Write a log as ``n_chunks`` successive appends (oldest rows first), the way a growing log
    reaches its folder. The file source takes files oldest first; with ``key`` an append keeps a
    run's rows in one file, so a micro-batch never holds a step older than one already processed
    for the same run. Every append reads the log once: keep the number of chunks fixed."""
    for c in range(int(n_chunks)):
        rows = df.where(F.col(chunk_col) == c).drop(chunk_col)
        (rows.repartition(key) if key else rows).write.mode("append").parquet(path)


HEAD_OUTPUT_SCHEMA = "step long, example_id long, env string, logits array<double>, label int"


def run_eval_stream(spark: SparkSession, source_dir: str, run_dir: str, checkpoint_dir: str, eval_steps: int,
                    snapshot_rows: int | None = None, files_per_trigger: int | None = None) -> None:
    """Head-output snapshots arrive per training step; every snapshot whose step is a multiple of
    ``eval_steps`` is evaluated (C6 per step, in one job), its metric names are cleaned (P11) and its row is
    appended to the committed log ``<run_dir>/csv_logs/eval.csv`` (K7) under the micro-batch's number, so that
    a replayed batch doubles nothing.

    A snapshot is whole when it has ``snapshot_rows`` rows (examples times heads). Until then its rows wait
    in a committed log below the checkpoint, which each micro-batch replaces by what still waits, and it is
    evaluated once, when the last of them has come, in however many batches. Without ``snapshot_rows`` a
    snapshot must arrive in one append."""
    from envlab.operators.metrics import clean_eval_metrics, evaluate
    from envlab.sinks.files import write_metric_log
    from envlab.sources.logs import EVAL_COLUMNS

    src = spark.readStream.schema(HEAD_OUTPUT_SCHEMA)
    if files_per_trigger:
        src = src.option("maxFilesPerTrigger", files_per_trigger)
    waiting = f"{checkpoint_dir.rstrip('/')}/waiting"
    columns = [c.split(" ")[0] for c in HEAD_OUTPUT_SCHEMA.split(", ")]

    def fn(batch: DataFrame, epoch_id: int) -> None:
        snap = batch.where(F.pmod(F.col("step"), F.lit(int(eval_steps))) == 0)
        if snapshot_rows is None:
            write_metric_log(clean_eval_metrics(evaluate(snap, ["step"])), run_dir, "eval", EVAL_COLUMNS, batch=epoch_id)
            return
        if AL.is_committed(spark, waiting, epoch_id):
            return  # a replay of a batch that was done
        names = AL.commit_names(spark, waiting)
        rows = materialize(AL.read_log(spark, waiting, HEAD_OUTPUT_SCHEMA, "parquet", names).drop("run").unionByName(snap), "snapshots")
        # one row per step that is not evaluated yet
        steps = rows.groupBy("step").agg((F.count(F.lit(1)) >= int(snapshot_rows)).alias("whole"))
        rows = join_small(rows, steps, "step")
        write_metric_log(clean_eval_metrics(evaluate(rows.where("whole"), ["step"])), run_dir, "eval", EVAL_COLUMNS, batch=epoch_id)
        folder = AL.write_attempt(rows.where(~F.col("whole")), waiting, epoch_id, columns, fmt="parquet")
        AL.commit(spark, waiting, epoch_id, folder, names)

    q = src.parquet(source_dir).writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()
