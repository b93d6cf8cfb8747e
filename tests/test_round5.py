"""Cases of the round's finding: runs of more steps than LATENESS, their rows in any order over appends."""
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from envlab.checks.compare import compare, duck
from envlab.checks.oracle import SQL
from envlab.plans import registry as R
from envlab.session import scratch_path
from envlab.streaming import logs as ST

NAME = "loss_moving_avg_disordered"


def _events(folder, runs, steps):
    """A table of events: ``runs`` users, one of them NULL, with ``steps`` events each."""
    ids = range(runs * steps)
    pq.write_table(pa.table({
        "event_id": pa.array(ids, pa.int64()),
        "ts": pa.array([(1_700_000_000 + i) * 1_000_000 for i in ids], pa.timestamp("us")),
        "user_id": pa.array([i % runs or None for i in ids], pa.int64()),
        "value": pa.array([i * 37 % 1009 / 8 if i % 101 else None for i in ids], pa.float64()),
    }), folder / "events.parquet")


def _batches(monkeypatch):
    """The number of micro-batches so far, after each call of the stream."""
    seen, run = [], ST.run_moving_average_stream

    def counted(spark, src, sink, ck, *args, **kw):
        run(spark, src, sink, ck, *args, **kw)
        seen.append(len([f for f in os.listdir(f"{ck}/commits") if not f.startswith(".")]))

    monkeypatch.setattr(ST, "run_moving_average_stream", counted)
    return seen


def test_disordered_runs_of_any_length_come_out_whole(spark, tmp_path):
    _events(tmp_path, 6, 2 * ST.LATENESS + 3_000)
    # a file per task and so several files per append
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ok, msg = compare(R.QUERIES[NAME](spark, str(tmp_path)), duck(str(tmp_path)), SQL[NAME])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ok, msg


def test_every_append_is_processed_before_the_next(spark, tmp_path, monkeypatch):
    _events(tmp_path, 5, 40)
    seen = _batches(monkeypatch)
    ok, msg = compare(R.QUERIES[NAME](spark, str(tmp_path)), duck(str(tmp_path)), SQL[NAME])
    assert ok, msg
    assert seen == list(range(1, R.LOG_APPENDS + 1))


def test_blocks_wait_on_their_own(spark):
    window, steps, stride = 3, 43, 2
    src, sink, ck = (scratch_path(spark, x) for x in ("bs", "bo", "bc"))
    rows = [(run, s * stride, None if s == 9 else float(s * s)) for run in (0, 1, None) for s in range(steps)]
    random.Random(5).shuffle(rows)
    parts = [rows[k::4] for k in range(4)]
    parts.append([(1, 6 * stride, -1.0), (1, 40 * stride, -1.0)])  # come again; the first is also in the next block's start
    for part in parts:
        spark.createDataFrame(part, ST.TRAIN_SCHEMA).coalesce(2).write.mode("append").parquet(src)
        stream = ST.moving_average_stream(spark.readStream.schema(ST.TRAIN_SCHEMA).parquet(src), window, 1, stride, groups=2, block=8)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    def mean(s):
        held = [float(x * x) for x in range(max(0, s - window + 1), s + 1) if x != 9]
        return sum(held) / len(held)

    back = spark.read.parquet(sink).collect()
    assert {(r.run, r.step): r.train_loss_moving_avg for r in back if r.n_late == 0} == {(run, s * stride): mean(s) for run in (0, 1, None) for s in range(steps)}
    assert sorted((r.run, r.step, r.train_loss, r.train_loss_moving_avg, r.n_late) for r in back if r.n_late) == [(1, 12, -1.0, None, 1), (1, 80, -1.0, None, 1)]
    assert len(back) == 3 * steps + 2
