"""The end-to-end jobs write what the reference's scripts write."""
import os

from pyspark.sql import functions as F

from envlab.plans import jobs
from envlab.session import scratch_path
from envlab.sources import fixtures as fx
from envlab.sources.tsv import read_envs

from .conftest import SF001


def _splits(spark):
    base = scratch_path(spark, "splits")
    b = fx.bios(spark, SF001)
    paths = {}
    for s in ("train", "dev", "test"):
        p = f"{base}/{s}"
        b.where(F.col("split") == s).drop("split").write.parquet(p)
        paths[s] = p
    return paths


def test_corpus_b_job_files(spark):
    out = scratch_path(spark, "corpusb")
    c = jobs.corpus_b_job(spark, _splits(spark), out, gap=0.4, m=2, k_test_per_class=10)
    envs = read_envs(spark, f"{out}/envs")
    assert envs.count() == c.train.count()
    assert sorted(r.env for r in envs.select("env").distinct().collect()) == ["env_1", "env_2"]
    erm = spark.read.text(f"{out}/train_erm")
    assert erm.count() == c.train.count()
    val = spark.read.text(f"{out}/val_test")
    assert val.count() == 200


def test_toy_job(spark):
    out = scratch_path(spark, "toy")
    jobs.toy_job(spark, out, 0.4, n_train_per_env=100, n_val=10)
    envs = read_envs(spark, f"{out}/envs")
    assert {r.env: r["count"] for r in envs.groupBy("env").count().collect()} == {"env_1": 100, "env_2": 100}
    assert set(r.text for r in envs.select("text").distinct().collect()) <= {"<AAA> a", "<AAA> b", "<BBB> a", "<BBB> b"}


def test_support_and_encode_jobs(spark):
    splits = _splits(spark)
    rep = jobs.support_job(spark, splits, scratch_path(spark, "support"))
    assert rep.count() == 20
    out = scratch_path(spark, "corpus")
    jobs.corpus_b_job(spark, splits, out, k_test_per_class=10)
    enc_path = scratch_path(spark, "enc")
    jobs.encode_job(spark, f"{out}/envs", f"{out}/val_test", enc_path, vocab_size=500)
    enc = spark.read.parquet(enc_path)
    assert enc.count() == 904
    assert enc.where(F.size("input_ids") > 128).count() > 0  # whole texts
    assert os.path.isdir(f"{enc_path}/env=validation")


def test_curve_and_seed_jobs(spark):
    base = scratch_path(spark, "logs")
    fx.write_eval_logs(spark, SF001, base)
    out = scratch_path(spark, "curves")
    s = jobs.curve_job(spark, base, out)
    assert s.count() > 0
    assert os.path.isdir(f"{out}/summary_accuracy")
    agg, pivot = jobs.seed_job(fx.run_history(spark, SF001), "ood_perplexity", scratch_path(spark, "seeds"))
    assert agg.count() == 36 and pivot.count() == 12
