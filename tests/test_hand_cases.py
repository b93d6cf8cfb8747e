import math
import os

import pytest
from pyspark.sql import functions as F

from envlab.functions.names import gap_suffix, grid_run_name, lr_from_path, parse_run_name, run_tags
from envlab.operators import heads as HD
from envlab.operators import metrics as MT
from envlab.operators.balance import balance_by_gender
from envlab.operators.envs import attach_classes
from envlab.operators.runs import experiment_grid, run_value, seed_aggregate
from envlab.operators.curves import curve_summary
from envlab.session import scratch_path
from envlab.sinks.files import write_env_tsv
from envlab.sources.logs import available_columns, discover_logs, read_eval_logs
from envlab.sources.tsv import read_envs


def _pred(spark, pairs, k):
    rows = [(i, y, p, [1.0 if c == p else 0.0 for c in range(k)]) for i, (y, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "example_id long, label int, pred int, logits array<double>")


def test_macro_f1_uses_classes_seen_only(spark):
    # classes 0..3, class 3 never appears in labels or predictions
    pairs = [(0, 0), (0, 1), (1, 1), (2, 2), (2, 0)]
    pc = MT.per_class(MT.confusion(_pred(spark, pairs, 4)))
    f1 = {r["class"]: r.f1 for r in pc.collect()}
    assert f1[3] == 0.0
    rep = MT.eval_report(pc).first()
    assert math.isclose(rep.f1_macro, (f1[0] + f1[1] + f1[2]) / 3)
    assert math.isclose(rep.accuracy, 3 / 5)


def test_correlations_null_under_three_classes(spark):
    rep = MT.eval_report(MT.per_class(MT.confusion(_pred(spark, [(0, 0), (1, 0), (1, 1)], 2)))).first()
    assert rep.corr_support_f1_pearson_r is None and rep.corr_support_f1_spearman_rho is None


def test_pearson_null_on_constant_support(spark):
    pairs = [(0, 0), (1, 1), (2, 0), (3, 3)]
    rep = MT.eval_report(MT.per_class(MT.confusion(_pred(spark, pairs, 4)))).first()
    assert rep.corr_support_f1_pearson_r is None


def test_head_tail_quarters(spark):
    pairs = [(0, 0)] * 5 + [(1, 1)] * 3 + [(2, 0)] * 2 + [(3, 3)]
    rep = MT.eval_report(MT.per_class(MT.confusion(_pred(spark, pairs, 4)))).first()
    # q = 1: tail = class 3 (support 1), head = class 0 (support 5)
    assert math.isclose(rep.f1_tail, 1.0)
    assert math.isclose(rep.f1_head, 2 * 5 / (5 + 7))
    assert math.isclose(rep.gap_head_tail, rep.f1_head - rep.f1_tail)


def test_single_head_divergence_is_null(spark):
    hl = spark.createDataFrame([(1, "env_1", [0.1, 0.9], 1)], "example_id long, env string, logits array<double>, label int")
    r = HD.prediction_divergence(hl).first()
    assert r.js_mean is None and r.disagree_mean is None


def test_js_bounds_and_identical_heads(spark):
    rows = [(i, e, [float(i % 3), 1.0, -float(i % 5)] if e == "a" else [float(i % 3), 1.0, -float(i % 5)], 0)
            for i in range(100) for e in ("a", "b")]
    hl = spark.createDataFrame(rows, "example_id long, env string, logits array<double>, label int")
    r = HD.prediction_divergence(hl).first()
    assert abs(r.js_mean) < 1e-12 and r.disagree_mean == 0.0
    rows = [(i, e, [10.0, -10.0] if e == "a" else [-10.0, 10.0], 0) for i in range(10) for e in ("a", "b")]
    r = HD.prediction_divergence(spark.createDataFrame(rows, "example_id long, env string, logits array<double>, label int")).first()
    assert 0.0 <= r.js_mean <= math.log(2) + 1e-12 and r.disagree_mean == 1.0


def test_k0_class_vanishes_and_string_gender(spark):
    rows = [(1, "t", "a", "male"), (2, "t", "a", "female"), (3, "t", "b", "male"), (4, "t", "b", "other")]
    df = spark.createDataFrame(rows, "example_id long, text string, profession string, gender string")
    from envlab.sources.corpus import gender_code

    b = balance_by_gender(df.withColumn("gender", gender_code(df)))
    assert sorted(r.example_id for r in b.collect()) == [1, 2]


def test_missing_class_raises(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "example_id long, profession string")
    classes = spark.createDataFrame([("x", 0, 0)], "profession string, label int, grp int")
    with pytest.raises(Exception, match="no id"):
        attach_classes(df, classes).collect()
    assert attach_classes(df, classes, on_missing="drop").count() == 1


def test_run_name_parser(spark):
    names = ["eval-erm-lr_5e-5-seed_3-model-25000", "eval-ilm-lr_1e-3-seed3-model 25 000", "eval-ilm-lr_1e-3-seed-3-model-5000",
             "EVAL_irm_5e-4_seed_1_model_100", "baseline-17", "eval-x-lr_1e-3-seed_2-model- _"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", parse_run_name(F.col("n")).alias("p"))
    got = {r.n: (r.p.algo, r.p.lr, r.p.seed, r.p.model) for r in df.collect()}
    assert got[names[0]] == ("erm", "5e-5", 3, 25000)
    assert got[names[1]] == ("ilm", "1e-3", 3, 25000)
    assert got[names[2]][2] is None
    assert got[names[3]] == ("irm", "5e-4", 1, 100)
    assert got[names[4]] == (None, None, None, None)
    assert got[names[5]][3] is None


def test_path_and_grid_names(spark):
    paths = ["runs/elm_gap010_lr0.001_seed0/csv_logs/eval.csv", "x/LR5e-05_y/eval.csv", "none/eval.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.lr for r in df.select(lr_from_path("p").alias("lr")).collect()] == [0.001, 5e-05, None]
    g = spark.createDataFrame([(0.29,), (0.1,)], "g double").select(gap_suffix("g").alias("s")).collect()
    assert [r.s for r in g] == ["029", "010"]
    grid = experiment_grid(spark)
    assert grid.count() == 48
    names = {r.run_name for r in grid.collect()}
    assert "elm_gap010_lr0.001_seed0_steps10000" in names
    assert "ilmg_gap040_lr0.0001_seed0_steps10000_K1_freeze1" in names
    t = spark.createDataFrame([("ilmg_gap040_lr0.1",), ("elm_lr0.1",)], "n string").select(run_tags("n").alias("t")).collect()
    assert [(r.t.algo, r.t.group) for r in t] == [("ilmg", "gap040"), ("elm", "gapNA")]


def test_run_value_strategies_and_summary_fallback(spark):
    h = spark.createDataFrame(
        [("a", 0, "m", 3.0), ("a", 1, "m", 1.0), ("a", 2, "m", 1.0), ("a", 3, "m", 2.0), ("b", 0, "m", None),
         ("c", 0, "m", float("nan"))],
        "run_name string, step long, metric string, value double")
    s = spark.createDataFrame([("b", "m", 9.0, 7), ("c", "m", None, 0)], "run_name string, metric string, summary_value double, summary_step long")
    last = {r.run_name: (r.step, r.value) for r in run_value(h, s, "m", "last").collect()}
    mn = {r.run_name: (r.step, r.value) for r in run_value(h, s, "m", "min").collect()}
    assert last == {"a": (3, 2.0), "b": (7, 9.0)}
    assert mn == {"a": (1, 1.0), "b": (7, 9.0)}


def test_seed_aggregate_nan_and_single(spark):
    v = spark.createDataFrame([("x", "1e-3", 1, 2.0), ("x", "1e-3", 1, float("nan")), ("y", "1e-3", 1, 5.0)],
                              "algo string, lr string, model long, value double")
    got = {r.algo: (r.n_seeds, r.mean_value, r.std_value) for r in seed_aggregate(v).collect()}
    assert got["x"] == (1, 2.0, None) and got["y"] == (1, 5.0, None)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_ragged_headers_by_name(spark):
    base = scratch_path(spark, "ragged")
    _write(f"{base}/a_lr0.001_seed0/csv_logs/eval.csv", "step,loss,accuracy\n0,2.5,0.1\n250,2.0,0.3\n")
    _write(f"{base}/b_lr0.001_seed1/csv_logs/eval.csv", "step,accuracy\n0,0.5\n250,nan\n")
    _write(f"{base}/c_lr0.7_seed1/csv_logs/eval.csv", "step,accuracy\n0,0.9\n")
    _write(f"{base}/d_noLR/csv_logs/eval.csv", "step,accuracy\n0,0.9\n")
    _write(f"{base}/a_lr0.001_seed0/csv_logs/training.csv", "step,train_loss\n0,1\n")
    rows = read_eval_logs(spark, base, ["step", "loss", "accuracy"])
    got = sorted((r.run_dir, r.step, r.loss, r.accuracy) for r in rows.collect())
    assert ("a_lr0.001_seed0", 0, 2.5, 0.1) in got
    assert ("b_lr0.001_seed1", 0, None, 0.5) in got
    assert not any(g[0] == "d_noLR" for g in got)
    assert sorted(available_columns(discover_logs(spark, base))) == ["accuracy", "loss", "step"]
    s = {(r.lr, r.step): r for r in curve_summary(rows, ["accuracy", "loss"]).collect()}
    assert math.isclose(s[(0.001, 0)].accuracy, 0.3)
    assert s[(0.001, 250)].accuracy == 0.3 and s[(0.001, 250)].accuracy_std is None
    assert s[(0.7, 0)].loss is None


def test_quoted_text_roundtrip(spark):
    lines = spark.createDataFrame(
        [("env_1", 1, '"hello world', 0), ("env_1", 2, 'foo" bar', 1), ("env_2", 3, "plain", 2)],
        "env string, example_id long, text string, labels int")
    path = scratch_path(spark, "quoted")
    write_env_tsv(lines, path)
    back = sorted((r.env, r.text, r.labels) for r in read_envs(spark, path).collect())
    assert back == [("env_1", '"hello world', 0), ("env_1", 'foo" bar', 1), ("env_2", "plain", 2)]


def test_reference_layout_env_files(spark):
    d = scratch_path(spark, "envfiles")
    _write(f"{d}/env_1.txt", "a b\t0\n\"q\t1\n")
    _write(f"{d}/env_2.txt", "c\t2\n")
    back = sorted((r.env, r.text, r.labels) for r in read_envs(spark, d).collect())
    assert back == [("env_1", '"q', 1), ("env_1", "a b", 0), ("env_2", "c", 2)]


def test_grid_run_name_formats_lr_string(spark):
    df = spark.createDataFrame([("elm", 0.1, "5e-05", 0, 100)], "a string, g double, lr string, s int, n int")
    assert df.select(grid_run_name("a", "g", F.col("lr"), "s", "n").alias("x")).first().x == "elm_gap010_lr5e-05_seed0_steps100"


def test_open_hooks(spark):
    import pandas as pd

    from envlab.plans.jobs import map_batches

    pc = MT.per_class(MT.confusion(_pred(spark, [(0, 0), (0, 1), (1, 1), (2, 2)], 3)))

    def worst(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(["f1", "class"]).iloc[0]
        return pd.DataFrame({"worst_class": [int(r["class"])], "worst_f1": [float(r["f1"])]})

    got = MT.custom_class_metric(pc, worst, "worst_class int, worst_f1 double").first()
    assert got.worst_class == 0 and math.isclose(got.worst_f1, 2 / 3)

    def double(it):
        for pdf in it:
            yield pdf.assign(y=pdf["id"] * 2)

    out = map_batches(spark.range(5), double, "id long, y long").collect()
    assert sorted(r.y for r in out) == [0, 2, 4, 6, 8]


def test_builder_b_vanished_class_raises(spark):
    from envlab.plans.corpus import build_corpus_b
    from envlab.sources import fixtures as fx

    # K = 250 at sf0.01: the smallest class puts all its rows into the test set
    c = build_corpus_b(spark, fx.bios(spark, "/root/testdata/sf0.01"), k_test_per_class=250)
    with pytest.raises(Exception, match="no id"):
        c.lines.count()
    d = build_corpus_b(spark, fx.bios(spark, "/root/testdata/sf0.01"), k_test_per_class=250, on_missing="drop")
    assert d.lines.count() < 904
