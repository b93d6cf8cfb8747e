"""Cases that once lost rows or gave wrong numbers."""
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from envlab.operators import curves as CV
from envlab.operators import encode as EN
from envlab.operators import runs as RN
from envlab.operators.ranking import rank_within
from envlab.operators.sums import exact_mean_std
from envlab.operators.balance import balance_by_gender
from envlab.operators.envs import class_ids
from envlab.plans.corpus import build_corpus_a, build_corpus_b
from envlab.plans.support_report import support_report
from envlab.sources.corpus import read_corpus
from envlab.sources.logs import available_columns, discover_logs, read_eval_logs
from envlab.streaming.logs import window_means


def test_rank_within_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a", 4)], "g string, v long")
    got = rank_within(df, ["g"], ["v"], F.floor(F.col("v") / 2).cast("long"), total="n").collect()
    assert sorted((str(r["g"]), r["v"], r["rank"], r["n"]) for r in got) == [("None", 2, 0, 2), ("None", 3, 1, 2), ("a", 1, 0, 2), ("a", 4, 1, 2)]


@pytest.mark.parametrize("held", [2, 100_000])
def test_encoding_keeps_whole_texts_and_repeated_ids(spark, monkeypatch, held):
    monkeypatch.setattr(EN, "DICTIONARY_WORDS", held)  # with two, most words leave the row for their ids
    long = " ".join(f"w{k}" for k in range(700))
    df = spark.createDataFrame([("env_1", 0, "a b a"), ("env_2", 0, "c d a"), ("env_2", 1, long), ("env_2", 2, "zzz")], "env string, example_id long, text string")
    vocab = EN.build_vocab(df.where("example_id < 2"))
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(len(ids))) and ids["a"] == 6 and len(ids) == 6 + 4 + 700
    got = {(r["env"], r["example_id"]): list(r["input_ids"]) for r in EN.encode(df, vocab).collect()}
    want = {k: [2, *(ids.get(w, 1) for w in t.split()), 3] for k, t in {("env_1", 0): "a b a", ("env_2", 0): "c d a", ("env_2", 1): long, ("env_2", 2): "zzz"}.items()}
    assert got == want
    assert EN.max_seq_length(None) is None and EN.max_seq_length(None, 2048) == 1024 and EN.max_seq_length(128, 512) == 128
    odd = spark.createDataFrame([(None, None, "a zzz b a"), ("e", 1, None), ("e", 2, ""), ("e", 3, "zzz c zzz d")], "env string, example_id long, text string")
    rows = {(r["env"], r["example_id"]): (list(r["input_ids"]), list(r["attention_mask"])) for r in EN.encode(odd, vocab).collect()}
    a, b, c, d = (ids[x] for x in "abcd")
    want = {(None, None): [2, a, 1, b, a, 3], ("e", 1): [2, 3], ("e", 2): [2, 3], ("e", 3): [2, 1, c, 1, d, 3]}
    assert rows == {k: (v, [1] * len(v)) for k, v in want.items()}
    cut = {r["example_id"]: len(r["input_ids"]) for r in EN.encode(df.where("env = 'env_2'"), vocab, 10).collect()}
    assert cut == {0: 5, 1: 10, 2: 3}


def test_vocabulary_ranks_are_the_global_order(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(" ".join(words[i:i + 30]),) for i in range(0, 3000, 30)], "text string")
    n = Counter(words)
    want = sorted(n, key=lambda w: (-n[w], w.encode()))
    got = {r["token"]: r["id"] for r in EN.build_vocab(df).collect()}
    assert [got[w] for w in want] == list(range(6, 6 + len(want)))


def test_ranks_over_levels_of_buckets(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["x", "y", None]), v) for v in rnd.sample(range(10**6), 4000)]
    df = spark.createDataFrame(rows, "g string, v long")
    levels = [F.floor(F.col("v") / k).cast("long") for k in (10, 1000, 100_000)]
    for keys in (["g"], []):
        got = rank_within(df, keys, ["v"], levels[0], total="n", coarser=levels[1:]).collect()
        for r in got:
            group = [v for g, v in rows if not keys or g == r["g"]]
            assert r["n"] == len(group)
        per = {}
        for r in got:
            per.setdefault(r["g"] if keys else "", []).append((r["v"], r["rank"]))
        assert all([x for _, x in sorted(p)] == list(range(len(p))) for p in per.values())


def test_batches_are_padded_in_one_join_as_in_two_steps(spark):
    rows = [("a" if i % 3 else "b", i, [2, *range(10, 10 + i % 7), 3], 1) for i in range(50)]
    df = spark.createDataFrame(rows, "env string, example_id long, input_ids array<int>, labels int").withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    key = lambda r: (r["env"], r["example_id"])
    for fixed in (None, 5):
        one = sorted(EN.padded_batches(df, 8, 7, fixed_length=fixed).collect(), key=key)
        two = sorted(EN.pad_batches(EN.assign_batches(df, 8, 7), fixed_length=fixed).collect(), key=key)
        assert one == two and len(one) == 50
        for r in one:
            assert len(r["input_ids"]) == len(r["attention_mask"]) and (fixed is None or len(r["input_ids"]) == 5)
            assert r["input_ids"][sum(r["attention_mask"]) - 1] == 3
    assert EN.assign_batches(df, 8, 7, drop_last=True).count() == 32 + 16


@pytest.mark.parametrize("folder", ["plain", "with blank", "it's + 100%"])
def test_log_headers_of_any_order_and_quoting(spark, tmp_path, folder):
    base = tmp_path / folder
    files = {
        "r1_lr0.001": "accuracy,step\n0.5,250.0\n0.6,500\n",
        "r2_lr0.001": '"step","loss","accuracy"\n"250","1.5",\n500,nan,"0.25"\n',
    }
    for run, text in files.items():
        p = base / run / "csv_logs"
        p.mkdir(parents=True)
        (p / "eval.csv").write_text(text)
        (p / "train.csv").write_text("other\n1\n")
    rows = sorted((r["run_dir"], r["step"], r["accuracy"], str(r["loss"]), r["lr"]) for r in read_eval_logs(spark, str(base)).where("accuracy is not null").collect())
    assert rows == [("r1_lr0.001", 250, 0.5, "None", 0.001), ("r1_lr0.001", 500, 0.6, "None", 0.001), ("r2_lr0.001", 500, 0.25, "nan", 0.001)]
    assert set(available_columns(discover_logs(spark, str(base)))) == {"accuracy", "step", "loss"}
    (base / "r3_lr0.001" / "csv_logs").mkdir(parents=True)
    (base / "r3_lr0.001" / "csv_logs" / "eval.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_eval_logs(spark, str(base))


def test_runs_with_only_a_summary(spark):
    h = spark.createDataFrame([(1, "a", 0, "m", 2.0), (3, "c", 0, "other", 1.0)], "run_id long, run_name string, step long, metric string, value double")
    s = spark.createDataFrame([(1, "a", "m", 9.0, 9), (2, "b", "m", 5.0, 7)], "run_id long, run_name string, metric string, summary_value double, summary_step long")
    got = sorted((r["run_id"], r["step"], r["value"]) for r in RN.run_value(h, s, "m").collect())
    assert got == [(1, 0, 2.0), (2, 7, 5.0)]
    assert RN.run_totals(RN.run_table(h, "m")).first()["n_runs"] == 2


def test_curve_numbers_do_not_saturate(spark):
    df = spark.createDataFrame([(1, 2e7), (1, 4e7), (2, math.inf), (2, 1.0), (3, 1.0), (3, 2.0), (None, 5.0), (4, None), (4, math.nan)], "k int, v double")
    got = {r["k"]: (r["v"], r["v_std"]) for r in CV.curve_summary(df, ["v"], ["k"]).collect()}
    assert got[1] == (3e7, 2e7 / math.sqrt(2)) and got[2] == (math.inf, None)
    assert got[3] == (1.5, math.sqrt(0.5)) and got[None] == (5.0, None) and got[4] == (None, None)
    for n in (1000, 1001):  # no size changes the numbers
        same = spark.range(n).select(F.lit(1).alias("k"), F.lit(0.1).alias("v"))
        assert tuple(CV.curve_summary(same, ["v"], ["k"]).first())[1:] == (0.1, 0.0)


def exact(values):
    v = [Fraction(x) for x in values]
    n, total = len(v), sum(v)
    var = (n * sum(x * x for x in v) - total * total) / (n * (n - 1))
    return float(total / n), math.sqrt(var) if var < 10**300 else None


def test_sums_are_exact_for_any_order_count_and_size(spark):
    rnd = random.Random(11)
    groups = {
        0: [rnd.uniform(-1, 1) for _ in range(3000)],
        1: [1e300, 1.0, -1e300, 3.0],
        2: [1e16 + 2 * k for k in range(500)],
        3: [rnd.choice([-1, 1]) * 2.0 ** rnd.randrange(-300, 300) * rnd.random() for _ in range(200)],
        4: [5e-324, 1e-310, -5e-324, 2.0**-1022],
        5: [0.0, -0.0, 0.0],
        6: [math.nextafter(2.0**k, 0) for k in range(-40, 40)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    want = None
    for parts in (1, 7):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
        got = {r["k"]: (r["v_n"], r["v_mean"], r["v_std"]) for r in exact_mean_std(df, ["k"], {"v": F.col("v")}).collect()}
        assert want is None or got == want  # bit for bit
        want = got
    for k, vs in groups.items():
        n, mean, std = want[k]
        m, s = exact(vs)
        assert n == len(vs) and mean == m
        assert std == pytest.approx(s, rel=1e-15) if s is not None else std > 0


def test_moving_average_skips_missing_losses_only(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=200)
    v[[7, 50, 51]] = np.nan
    want = pd.Series(v).rolling(20, min_periods=1).mean().to_numpy()
    assert np.allclose(window_means(v, 20), want, equal_nan=True)
    assert np.isnan(window_means(np.array([np.nan, np.nan]), 2)).all()


def test_nothing_balanced_raises(spark):
    df = spark.createDataFrame([(i, "t", "p", 0, "train") for i in range(4)], "example_id long, text string, profession string, gender int, split string")
    with pytest.raises(ValueError):
        support_report(df)
    with pytest.raises(ValueError):
        build_corpus_b(spark, df)


def test_every_balanced_set_must_hold_something(spark):
    schema = "example_id long, text string, profession string, gender int, split string"
    rows = [(i, "t", "p", i % 2, "train") for i in range(8)] + [(10 + i, "t", "p", 0, "test") for i in range(4)]
    one_sided = spark.createDataFrame(rows, schema)
    for job in (support_report, lambda c: build_corpus_a(spark, c, gap=0.2)):
        with pytest.raises(ValueError, match="in test"):
            job(one_sided)
        with pytest.raises(ValueError, match="in train"):
            job(one_sided.withColumn("split", F.when(F.col("split") == "test", "train").otherwise("test")))


def test_rows_without_a_class_never_count(spark):
    schema = "example_id long, text string, profession string, gender int, split string"
    rows = [(i, "t", None if i % 3 == 0 else "abc"[i % 2], (i // 2) % 2, "train" if i < 40 else "test") for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    assert {r["profession"] for r in balance_by_gender(df).collect()} == {"a", "b"}
    assert {r["profession"] for r in support_report(df).collect()} == {"a", "b"}
    assert sorted((r["profession"], r["label"]) for r in class_ids(df).collect()) == [("a", 0), ("b", 1)]
    assert build_corpus_a(spark, df, gap=0.2).lines.where("labels IS NULL").count() == 0
    assert build_corpus_b(spark, df, k_test_per_class=2).lines.where("labels IS NULL").count() == 0


def test_positions_follow_files_and_rows(spark, tmp_path):
    for split, n in (("train", 50), ("dev", 7), ("test", 20)):
        df = spark.range(n).select(F.concat(F.lit(split), F.col("id").cast("string")).alias("bio"), F.lit("p").alias("profession"), F.pmod("id", F.lit(2)).alias("gender"))
        df.repartitionByRange(3, "bio").sortWithinPartitions("bio").write.parquet(f"{tmp_path}/{split}")
    got = read_corpus(spark, {s: f"{tmp_path}/{s}" for s in ("train", "dev", "test")}).repartition(5).collect()
    want = [f"{s}{i}" for s, n in (("train", 50), ("dev", 7), ("test", 20)) for i in sorted(range(n), key=str)]
    assert [r["text"] for r in sorted(got, key=lambda r: r["example_id"])] == want
    assert sorted(r["example_id"] for r in got) == list(range(77))
    spark.range(3).select(F.col("id").alias("example_id"), F.lit("t").alias("t"), F.lit("p").alias("profession"), F.lit(0).alias("gender")).write.parquet(f"{tmp_path}/ids")
    with pytest.raises(ValueError):
        read_corpus(spark, {"train": f"{tmp_path}/ids", "test": f"{tmp_path}/test"})


def test_small_tables_are_measured_in_bytes(spark, monkeypatch):
    from envlab import session

    few = spark.createDataFrame([("a", 1, [1.0, 2.0]), (None, None, None)], "k string, n int, v array<double>")
    df, rows, size = session.measure(few)
    assert (rows, size) == (2, 0) and df.schema == few.schema and sorted(df.collect(), key=str) == sorted(few.collect(), key=str)
    for wide in (few.withColumn("k", F.repeat(F.lit("x"), 5000)), few.withColumn("v", F.array_repeat(F.lit(1.0), 999)), few.withColumn("s", F.struct("n"))):
        df, rows, size = session.measure(wide)
        assert rows == 2 and size > 0 and sorted(df.collect(), key=str) == sorted(wide.collect(), key=str)
    assert session.measure(spark.range(50), local_max=10)[1] == 50
    big = spark.range(100).withColumnRenamed("id", "n")
    monkeypatch.setattr(session, "BROADCAST_MAX_BYTES", 10)
    wide = few.where("n = 1").withColumn("k", F.repeat(F.lit("x"), 5000))
    joined = session.join_small(big, wide, "n")
    assert joined.count() == 1 and "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
