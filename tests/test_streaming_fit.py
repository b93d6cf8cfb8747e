"""Stream = batch for the incremental jobs, restart from a checkpoint, and the fitted heads."""
import math

from pyspark.sql import functions as F

from envlab.operators import fit as FT
from envlab.operators import metrics as MT
from envlab.operators.moving import moving_average
from envlab.session import scratch_path
from envlab.sinks import appendlog as AL
from envlab.sources import fixtures as fx
from envlab.streaming import logs as ST

from .conftest import SF001


def _log(spark):
    return fx.train_log(spark, SF001)


def test_stream_moving_average_equals_batch_and_restarts(spark):
    log = _log(spark).withColumn("_chunk", F.floor(F.col("step") / 20).cast("long"))
    n = log.agg(F.max("_chunk")).first()[0] + 1
    src, sink, ck = scratch_path(spark, "s"), scratch_path(spark, "o"), scratch_path(spark, "c")
    # first half of the log, run, then the rest arrives and the query restarts from its checkpoint
    half = n // 2
    ST.write_log_chunks(log.where(F.col("_chunk") < half), src, "_chunk", half)
    ST.run_moving_average_stream(spark, src, sink, ck)
    ST.write_log_chunks(log.where(F.col("_chunk") >= half).withColumn("_chunk", F.col("_chunk") - half), src, "_chunk", n - half)
    ST.run_moving_average_stream(spark, src, sink, ck)
    got = {(r.run, r.step): r.train_loss_moving_avg for r in spark.read.parquet(sink).collect()}
    ref = {(r.run, r.step): r.ma for r in moving_average(_log(spark), "run", "step", "train_loss", "ma").collect()}
    assert got.keys() == ref.keys()
    assert all(math.isclose(got[k], ref[k], rel_tol=1e-9) for k in ref)


def test_fit_env_heads_learns(spark):
    e = fx.table(spark, SF001, "embeddings")
    rows = e.select(F.col("vec_id").alias("example_id"), F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("features"),
                    F.col("label").cast("int").alias("label"),
                    F.concat(F.lit("env_"), (F.col("vec_id") % 2 + 1).cast("string")).alias("env"))
    w, hist = FT.fit_env_heads(spark, rows, 10, 64, iterations=15, lr=0.5)
    first = [h["loss"] for h in hist if h["iteration"] == 0]
    last = [h["loss"] for h in hist if h["iteration"] == 14]
    assert sum(last) < sum(first)
    hl = FT.score_heads(rows, FT.head_table(spark, w), sorted(w))
    acc = MT.eval_report(MT.per_class(MT.confusion(MT.ensemble(hl)))).first().accuracy
    assert acc > 0.1


def test_fit_pooled_beats_chance(spark):
    e = fx.table(spark, SF001, "embeddings")
    rows = e.select(F.col("vec_id").alias("example_id"), F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("features"),
                    F.col("label").cast("int").alias("label"))
    m = FT.fit_pooled(rows, max_iter=30)
    p = FT.predict_pooled(m, rows)
    acc = p.where(F.col("pred") == F.col("label")).count() / p.count()
    assert acc > 0.1


def test_stream_log_cadence_and_head_snapshots(spark):
    from envlab.operators.moving import log_cadence
    from envlab.sinks.files import write_head_snapshots

    log = _log(spark).where(F.col("run") < 20).withColumn("_chunk", F.floor(F.col("step") / 30).cast("long"))
    n = log.agg(F.max("_chunk")).first()[0] + 1
    src, sink, ck = scratch_path(spark, "s"), scratch_path(spark, "o"), scratch_path(spark, "c")
    ST.write_log_chunks(log, src, "_chunk", n)
    ST.run_moving_average_stream(spark, src, sink, ck, every=10)
    got = {(r.run, r.step): r.train_loss_moving_avg for r in spark.read.parquet(sink).collect()}
    ref = log_cadence(moving_average(_log(spark).where(F.col("run") < 20), "run", "step", "train_loss", "ma"), every=10)
    ref = {(r.run, r.step): r.ma for r in ref.collect()}
    assert got.keys() == ref.keys() and all(math.isclose(got[k], ref[k], rel_tol=1e-9) for k in ref)

    snaps = scratch_path(spark, "heads")
    w = fx.head_weights(spark, SF001).where(F.col("step") < 4)
    write_head_snapshots(w, snaps)
    write_head_snapshots(fx.head_weights(spark, SF001).where(F.col("step") == 4), snaps)
    back = spark.read.parquet(snaps)
    assert back.count() == 15 and sorted(r.step for r in back.select("step").distinct().collect()) == [0, 1, 2, 3, 4]


def test_replayed_batches_double_nothing(spark):
    from envlab.sinks.files import write_metric_log
    from envlab.sources.logs import discover_logs, parse_ragged

    run = scratch_path(spark, "replay")
    first = spark.createDataFrame([(5, 0.5), (10, 0.25)], "step long, loss double")
    second = spark.createDataFrame([(15, 0.125)], "step long, loss double")
    for rows, batch in ((first, 0), (second, 1), (second, 1), (first, 0)):
        write_metric_log(rows, run, "eval", ["step", "loss"], batch=batch)
    got = parse_ragged(discover_logs(spark, run, "eval"), ["step", "loss"])
    assert sorted((r.step, r.loss) for r in got.collect()) == [(5, 0.5), (10, 0.25), (15, 0.125)]
    assert {r.run_dir for r in got.select("run_dir").distinct().collect()} == {run.rsplit("/", 1)[1]}


def test_heads_compaction_over_restarts(spark):
    """A step whose halves come in different micro-batches is one row; a batch written again changes nothing."""
    src, sink, ck = scratch_path(spark, "h"), scratch_path(spark, "hs"), scratch_path(spark, "hc")
    a = spark.createDataFrame([(1, 1.0, 2.0, None, None), (2, 3.0, 4.0, 5.0, 6.0)], ST.HEADS_SCHEMA)
    b = spark.createDataFrame([(1, None, None, 7.0, 8.0)], ST.HEADS_SCHEMA)
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(src)
        ST.run_heads_compaction_stream(spark, src, sink, ck)
    want = [(1, 1.0, 2.0, 7.0, 8.0), (2, 3.0, 4.0, 5.0, 6.0)]
    assert sorted(tuple(r) for r in ST.read_compacted_heads(spark, sink).collect()) == want
    assert not AL.append(b, sink, 0, ST.HEADS_COLUMNS, fmt="parquet")
    for k in range(3, 8):  # merged as it grows
        spark.createDataFrame([(k, 1.0, 1.0, 1.0, 1.0)], ST.HEADS_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ST.run_heads_compaction_stream(spark, src, sink, ck, merge_every=3)
        assert len(AL.commit_names(spark, sink)) < 3
        want.append((k, 1.0, 1.0, 1.0, 1.0))
    assert AL.vacuum(spark, sink) > 0
    assert sorted(tuple(r) for r in ST.read_compacted_heads(spark, sink).collect()) == want


def test_appends_of_many_runs_are_read_once(spark):
    """Two appends, a replay, one killed before its commit, one killed while committing."""
    from envlab.sinks.files import log_root, write_metric_logs_by_run
    from envlab.sources.logs import TRAINING_COLUMNS, discover_logs, parse_ragged, read_metric_log

    base = scratch_path(spark, "runs")
    runs = ["a_lr0.001", "b c", "x+y%20z", "p/q=r", "é"]
    rows = spark.createDataFrame([(r, s, s / 8) for r in runs for s in range(9)], "name string, step long, train_loss double").repartition(4)
    root = log_root(base, "training")
    for epoch in (0, 1, 1, 0):
        write_metric_logs_by_run(rows.where(F.col("step") % 3 == epoch), base, "name", "training", TRAINING_COLUMNS, epoch)
    AL.write_attempt(rows, root, 2, TRAINING_COLUMNS, "name")
    folder = AL.write_attempt(rows, root, 3, TRAINING_COLUMNS, "name")
    store = AL._Store(spark, root)
    store.put("3.txt", "\n".join(store.files(folder)[:2]) + "\n")  # cut off
    want = sorted((r, s, s / 8) for r in runs for s in range(9) if s % 3 < 2)

    def got():
        log = read_metric_log(spark, base, "training", TRAINING_COLUMNS)
        lines = parse_ragged(discover_logs(spark, base, "training"), TRAINING_COLUMNS)
        a = sorted((r.run, r.step, r.train_loss) for r in log.collect())
        assert sorted((r.run_dir, r.step, r.train_loss) for r in lines.collect()) == a
        return a

    assert got() == want
    write_metric_logs_by_run(rows.where(F.col("step") % 3 == 2), base, "name", "training", TRAINING_COLUMNS, 2)
    want = sorted((r, s, s / 8) for r in runs for s in range(9))
    assert got() == want
    schema = "step long, train_loss double, train_loss_moving_avg double, round long"
    assert AL.merge(spark, root, "merge", schema, TRAINING_COLUMNS, runs=True) and not AL.merge(spark, root, "merge", schema, TRAINING_COLUMNS, runs=True)
    assert AL.commit_names(spark, root) == ["merge.txt"] and got() == want
    assert AL.vacuum(spark, root) == 5 and got() == want


def test_steps_wait_for_their_predecessors():
    import numpy as np

    def feed(batches, lateness, window=3):
        buf, last, seen, steps, losses, out, late = [], None, None, [], [], {}, []
        for b in batches:
            steps, losses = np.array([*steps, *b]), np.array([*losses, *map(float, b)])
            go, held, missed, last, seen = ST.in_order(steps, losses, last, seen, lateness, 1)
            full = np.array([*buf, *losses[go]])
            out |= dict(zip(steps[go].tolist(), ST.window_means(full, window)[len(buf):].tolist()))
            late += steps[missed].tolist()
            buf, steps, losses = full[-(window - 1):].tolist(), steps[held], losses[held]
        return out, late, steps.tolist()

    batch = {s: sum(range(max(0, s - 2), s + 1)) / min(3, s + 1) for s in range(7)}
    assert feed([[0, 1, 2, 5], [3, 4, 6]], 10) == (batch, [], [])
    assert feed([[6, 5], [4, 3, 2], [1], [0]], 10) == (batch, [], [])
    # 3 and 4 do not come while 5 steps are seen beyond them; then they are too late
    out, late, held = feed([[0, 1, 2, 5, 6], [10], [3, 4]], 5)
    assert out == {0: 0.0, 1: 0.5, 2: 1.0, 5: 8 / 3, 6: 13 / 3} and sorted(late) == [3, 4] and held == [10]


def test_snapshot_in_parts_is_evaluated_once(spark):
    from envlab.sources.logs import EVAL_COLUMNS, read_metric_log

    rows = [(s, i, f"env_{h}", [float((i + s) % 3 == c) + 0.1 * h for c in range(3)], i % 3) for s in (5, 10) for i in range(30) for h in range(2)]
    df = spark.createDataFrame(rows, ST.HEAD_OUTPUT_SCHEMA)
    src, run, ck = (scratch_path(spark, x) for x in ("ps", "pr", "pc"))
    seen = []
    for part in range(3):
        df.where(F.pmod(F.xxhash64("step", "example_id", "env"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(src)
        ST.run_eval_stream(spark, src, run, ck, 5, snapshot_rows=60)
        seen.append(read_metric_log(spark, run, "eval", EVAL_COLUMNS).count())
    assert seen == [0, 0, 2]
    want = {r.step: r.accuracy for r in MT.clean_eval_metrics(MT.evaluate(df, ["step"])).collect()}
    got = {r.step: r.accuracy for r in read_metric_log(spark, run, "eval", EVAL_COLUMNS).collect()}
    assert got == want


def test_refreshed_logs_open_changed_files_only(spark, tmp_path):
    from envlab.sinks.files import log_root, write_metric_logs_by_run
    from envlab.sources.logs import EVAL_COLUMNS, read_eval_logs, refresh_logs

    base, state = tmp_path / "runs", scratch_path(spark, "seen")

    def put(run, text):
        (base / run / "csv_logs").mkdir(parents=True, exist_ok=True)
        (base / run / "csv_logs" / "eval.csv").write_text(text)

    def same():
        rows, opened = refresh_logs(spark, str(base), state)
        full = read_eval_logs(spark, str(base))
        cols = ["run_dir", "rel_path", "lr", "step", "accuracy", "loss"]
        assert sorted(rows.select(cols).collect(), key=str) == sorted(full.select(cols).collect(), key=str)
        return opened

    put("a_lr0.001", "step,accuracy\n1,0.5\n")
    put("b 100%_lr0.01", "step,loss,accuracy\n1,2.0,0.25\n")
    assert same() == 2 and same() == 0
    put("a_lr0.001", "step,accuracy\n1,0.5\n2,0.75\n")
    assert same() == 1
    rows = spark.createDataFrame([("c_lr0.5", 3, 0.125), ("d_lr0.5", 4, 1.0)], "name string, step long, accuracy double").coalesce(1)
    root = log_root(str(base), "eval")
    folder = AL.write_attempt(rows, root, 0, EVAL_COLUMNS, "name")
    assert same() == 0  # nothing is committed yet
    AL.commit(spark, root, 0, folder)
    assert same() == 2
    write_metric_logs_by_run(rows, str(base), "name", "eval", EVAL_COLUMNS, 1)
    (base / "b 100%_lr0.01" / "csv_logs" / "eval.csv").unlink()
    assert same() == 2 and same() == 0


def numpy_turns(batches, weights, max_steps, k, grad_accum, lr, clip):
    import numpy as np

    envs, taken, held, step, rounds, log = sorted(weights), dict.fromkeys(weights, 0), {e: 0.0 for e in weights}, 0, 0, []
    count = dict.fromkeys(weights, 0)
    while step < max_steps:
        for _ in range(k):
            for e in envs:
                x, y = batches[e][taken[e] % len(batches[e])]
                taken[e] += 1
                z = np.mean([x @ weights[v].T for v in envs], axis=0)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                loss = -np.log(p[np.arange(len(y)), y]).mean() / grad_accum
                p[np.arange(len(y)), y] -= 1
                held[e] = held[e] + p.T @ x / len(y) / len(envs) / grad_accum
                count[e] += 1
                log.append((step, e, rounds, loss))
                if count[e] == grad_accum:
                    norm = np.sqrt((held[e] ** 2).sum())
                    g = held[e] * min(1.0, clip / (norm + 1e-6)) if clip and norm > clip else held[e]
                    weights[e] = weights[e] - lr * g
                    held[e], count[e] = 0.0, 0
                    step += 1
        rounds += 1
    return weights, log


def test_heads_in_turns_equal_a_plain_loop(spark):
    import numpy as np

    from envlab.operators.encode import batch_plan

    e = fx.table(spark, "/root/testdata/sf0.001", "embeddings")
    rows = e.select(F.col("vec_id").alias("example_id"), F.expr("transform(embedding, x -> CAST(x AS DOUBLE))").alias("features"),
                    F.col("label").cast("int").alias("label"),
                    F.concat(F.lit("env_"), (F.col("vec_id") % 2 + 1).cast("string")).alias("env"))
    plan = {(r["env"], r["example_id"]): (r["batch_id"], r["rank"]) for r in batch_plan(rows.select("env", "example_id"), 64, 3).collect()}
    dealt = {}
    for r in sorted(rows.collect(), key=lambda r: plan[r["env"], r["example_id"]][1]):
        dealt.setdefault(r["env"], {}).setdefault(plan[r["env"], r["example_id"]][0], []).append(r)
    batches = {v: [(np.array([r["features"] for r in b[i]]), np.array([r["label"] for r in b[i]])) for i in range(len(b))] for v, b in dealt.items()}
    rng = np.random.default_rng(0)
    start = {v: rng.normal(0.0, 0.01, size=(10, 64)) for v in sorted(batches)}
    want, log = numpy_turns(batches, start, 9, 2, 2, 0.5, 0.05)
    got = []
    for parts in (1, 7):
        path = scratch_path(spark, "turns")
        FT.store_batches(rows.repartition(parts), path, 64, 3)
        if parts == 7:  # rows of a batch over several files, in another order
            scattered = scratch_path(spark, "turns")
            spark.read.parquet(path).repartition(5).write.partitionBy("env", "folder").parquet(scattered)
            path = scattered
        got.append(FT.fit_heads_in_turns(spark, path, 10, 64, 9, k=2, batch_size=64, grad_accum=2, max_grad_norm=0.05))
    (w1, l1), (w2, l2) = got
    assert all((w1[v] == w2[v]).all() for v in w1) and l1 == l2  # bit for bit
    assert all(np.abs(w1[v] - want[v]).max() < 1e-9 for v in want)
    assert [(r["step"], r["env"], r["round"]) for r in l1] == [x[:3] for x in log]
    assert max(abs(r["train_loss"] - x[3]) for r, x in zip(l1, log)) < 1e-9
    assert abs(l1[4]["train_loss_moving_avg"] - np.mean([x[3] for x in log[:5]])) < 1e-9


def test_gradients_and_scores_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(6, 4)), rng.integers(0, 3, 6)
    w = {"a": rng.normal(size=(3, 4)), "b": rng.normal(size=(3, 4))}

    def loss(heads):
        z = np.mean([x @ heads[e].T for e in sorted(heads)], axis=0)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(6), y]).sum())

    g, nll = FT.head_gradient(x, y, w)
    assert abs(nll.sum() - loss(w)) < 1e-9
    pdf = next(FT._grad_fn(w, ["a", "b"])(iter([__import__("pandas").DataFrame({"env": ["a"] * 6, "features": list(x), "label": y})])))
    for i in range(3):
        for j in range(4):
            up, down = ({"a": w["a"].copy(), "b": w["b"]} for _ in range(2))
            up["a"][i, j] += 1e-6
            down["a"][i, j] -= 1e-6
            slope = (loss(up) - loss(down)) / 2e-6
            assert abs(g.sum(axis=0)[i, j] - slope) < 1e-6 and abs(np.reshape(pdf["g"][0], (3, 4))[i, j] - slope) < 1e-6
    rows = spark.createDataFrame([(k, [float(v) for v in x[k]], int(y[k])) for k in range(6)], "example_id long, features array<double>, label int")
    for r in FT.score_heads(rows, FT.head_table(spark, w), ["a", "b"]).collect():
        assert np.allclose(r["logits"], w[r["env"]] @ x[r["example_id"]], atol=1e-12)
    # the pooled model is where the gradient of the pooled loss vanishes
    many = spark.createDataFrame([(k, [float(v) for v in rng.normal(size=3)], int(k % 2)) for k in range(200)], "example_id long, features array<double>, label int")
    model = FT.fit_pooled(many, max_iter=200, reg=0.01)
    m, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    fx_, fy = np.array([r["features"] for r in many.collect()]), np.array([r["label"] for r in many.collect()])
    z = fx_ @ m.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(200), fy] -= 1
    assert np.abs(p.mean(axis=0)).max() < 1e-3
