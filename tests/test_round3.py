"""Cases of the round's findings: files of many runs, states of many runs, slices of a batch, files of a corpus."""
import pyarrow as pa
from pyspark.sql import functions as F

from envlab.operators import encode as EN
from envlab.session import scratch_path
from envlab.sinks import appendlog as AL
from envlab.sinks.files import log_root, write_metric_logs_by_run
from envlab.sources.logs import TRAINING_COLUMNS, discover_logs, parse_ragged, read_metric_log
from envlab.streaming import logs as ST


def test_an_append_has_no_file_per_run(spark):
    base = scratch_path(spark, "many")
    rows = spark.range(300).select(F.concat(F.lit("r,\""), F.col("id").cast("string")).alias("name"), F.col("id").alias("step"), (F.col("id") / 8).alias("train_loss"))
    write_metric_logs_by_run(rows, base, "name", "training", TRAINING_COLUMNS, 0)
    files = AL.read_commits(spark, log_root(base, "training")).count()
    assert files <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r.run, r.step, r.train_loss) for r in read_metric_log(spark, base, "training", TRAINING_COLUMNS).collect())
    assert got == sorted((f'r,"{i}', i, i / 8) for i in range(300))
    lines = parse_ragged(discover_logs(spark, base, "training"), TRAINING_COLUMNS)
    assert sorted((r.run_dir, r.step, r.train_loss) for r in lines.collect()) == got


def test_older_logs_with_a_folder_per_run_are_read(spark):
    base = scratch_path(spark, "older")
    root = log_root(base, "training")
    rows = spark.createDataFrame([("a b_lr0.5", 1, 0.5), ("p/q", 2, 1.0)], "run string, step long, train_loss double")
    rows.write.partitionBy("run").option("header", True).csv(f"{root}/attempt=0-x")
    assert AL.commit(spark, root, 0, "attempt=0-x")
    write_metric_logs_by_run(rows.where("step = 2").withColumn("step", F.col("step") + 1), base, "run", "training", ["step", "train_loss"], 1)
    want = [("a b_lr0.5", 1, 0.5), ("p/q", 2, 1.0), ("p/q", 3, 1.0)]
    assert sorted(tuple(r) for r in read_metric_log(spark, base, "training", ["step", "train_loss"]).collect()) == want
    lines = parse_ragged(discover_logs(spark, base, "training"), ["step", "train_loss"])
    assert sorted((r.run_dir, r.step, r.train_loss) for r in lines.collect()) == want


def test_runs_that_share_a_state(spark):
    src, sink, ck = (scratch_path(spark, x) for x in ("ss", "so", "sc"))
    for part in (0, 1):
        rows = [(run, s, float(s)) for run in (0, 1, 2, None) for s in range(6) if s % 2 == (part + (run == 1)) % 2]
        spark.createDataFrame(rows, ST.TRAIN_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = ST.moving_average_stream(spark.readStream.schema(ST.TRAIN_SCHEMA).parquet(src), window=3, groups=1)
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    want = {(run, s): sum(range(max(0, s - 2), s + 1)) / min(3, s + 1) for run in (0, 1, 2, None) for s in range(6)}
    back = spark.read.parquet(sink).collect()
    assert len(back) == 24 and {(r.run, r.step): r.train_loss_moving_avg for r in back} == want
    assert {r.n_late for r in back} == {0}


def test_batches_are_coded_in_slices():
    words = [["a"] * n for n in (3, 0, 5, 1, 1, 9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(words, pa.list_(pa.string()))], names=["i", "_words"])
    parts = list(EN._slices(batch.slice(1), 5))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2], [3, 4], [5]]
    assert [w for p in parts for w in p.column(1).to_pylist()] == words[1:]


def test_groups_are_compared_in_slices(monkeypatch):
    from envlab.llm import spelling

    field = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    groups = [[("lettern", 5), ("letterm", 2)], [("abcdefg", 3), ("abcdefh", 4), ("abcdefi", 1)], [("xbcdefg", 3), ("ybcdefg", 9)]]
    arrays = [pa.array(x, pa.int32()) for x in ([7, 7, 7], [3, 3, 0], [7, 7, 3])]
    lists = pa.array([[{"word": w, "n": n} for w, n in g] for g in groups], field)
    batch = pa.RecordBatch.from_arrays([*arrays, lists], names=["m", "lo", "hi", "words"])

    def rows():
        return sorted(tuple(r.values()) for b in spelling._compare(iter([batch])) for r in b.to_pylist())

    whole = rows()
    monkeypatch.setattr(spelling, "SLICE_WORDS", 3)
    assert len(list(spelling._compare(iter([batch])))) == 3 and rows() == whole and len(whole) == 7


def test_positional_splits_have_more_files_for_more_tasks(spark):
    from tests.conftest import SF0001

    from envlab.plans import registry as R

    c = R._positional(spark, SF0001)
    assert c.select("split", F.input_file_name().alias("f")).distinct().groupBy("split").count().agg(F.max("count")).first()[0] > 3


def test_schedule_from_one_set_of_lines(spark, monkeypatch):
    from tests.conftest import SF001

    from envlab.plans import registry as R

    built, real = [], R._lines_b
    monkeypatch.setattr(R, "_lines_b", lambda *a: built.append(1) or real(*a))
    assert R.q_step_schedule(spark, SF001).count() >= 0 and len(built) == 1
