"""Properties of the sampling, ranking, splitting and injection operators."""
import hashlib
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from envlab.functions.draws import draw
from envlab.functions.text import PREFIX_GROUP0, PREFIX_GROUP1, TARGET_TOKENS, inject_prefix, tokens
from envlab.operators.balance import balance_by_gender, split_test_train
from envlab.operators.envs import assign_contiguous, assign_round_robin, env_grid
from envlab.operators.moving import moving_average
from envlab.operators.ranking import draw_bucket, first_k, rank_within
from envlab.sources import fixtures as fx

from .conftest import SF001


def py_draw(seed, tag, *keys):
    s = "|".join([str(seed), tag] + [str(k) for k in keys])
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2**32


def test_draw_equals_python(spark):
    rows = spark.range(50).select("id", draw(7, "t", "id").alias("d")).collect()
    for r in rows:
        assert r.d == py_draw(7, "t", r.id)
        assert 0.0 <= r.d < 1.0


def test_rank_within_equals_window_with_tiny_buckets(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), "id", draw(1, "r", "id").alias("d"))
    got = rank_within(df, ["g"], ["d", "id"], draw_bucket("d", 16), name="r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("d", "id")) - 1)
    assert sorted(got.select("id", "r").collect()) == sorted(ref.select("id", "r").collect())


def test_first_k_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 4).alias("g"), "id", draw(2, "k", "id").alias("d"))
    k = spark.createDataFrame([(0, 5), (1, 0), (2, 10_000), (3, 311)], "g long, _k long")
    got = first_k(df, ["g"], k, "d", "id", draw_bucket("d", 8))
    rn = F.row_number().over(Window.partitionBy("g").orderBy("d", "id"))
    ref = df.join(k, "g").withColumn("rn", rn).where(F.col("rn") <= F.col("_k"))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in ref.collect())
    rest = first_k(df, ["g"], k, "d", "id", draw_bucket("d", 8), keep="rest")
    # groups with k > 0 are split in two; the k = 0 group keeps nothing on either side
    assert rest.count() + got.count() == df.where(F.col("g") != 1).count()


def test_balance_counts_equal_per_class(spark):
    b = balance_by_gender(fx.bios(spark, SF001).where(F.col("split") != "test"))
    per = b.groupBy("profession").agg(F.count_if(F.col("gender") == 0).alias("m"), F.count_if(F.col("gender") == 1).alias("f"))
    assert per.where(F.col("m") != F.col("f")).count() == 0
    assert b.count() == 692


def test_balance_is_partition_independent(spark):
    base = fx.bios(spark, SF001)
    a = sorted(r.example_id for r in balance_by_gender(base).collect())
    for n in (1, 7, 50):
        assert sorted(r.example_id for r in balance_by_gender(base.repartition(n)).collect()) == a


def test_split_is_a_partition_of_the_pool(spark):
    pool = balance_by_gender(fx.bios(spark, SF001))
    test, train = split_test_train(pool, 10)
    t = {r.example_id for r in test.collect()}
    tr = {r.example_id for r in train.collect()}
    p = {r.example_id for r in pool.collect()}
    assert not (t & tr) and (t | tr) == p
    per = test.groupBy("profession").count().collect()
    assert {r["count"] for r in per} == {10}


def test_stratified_split_takes_half_of_each_gender(spark):
    pool = balance_by_gender(fx.bios(spark, SF001))
    test, _ = split_test_train(pool, 10, stratify=True)
    per = test.groupBy("profession", "gender").count().collect()
    assert {r["count"] for r in per} == {5}


def test_round_robin_balances_environments(spark):
    pool = balance_by_gender(fx.bios(spark, SF001))
    _, train = split_test_train(pool, 10)
    env = assign_round_robin(train, 3, 0)
    counts = env.groupBy("profession", "env").count().groupBy("profession").agg(
        (F.max("count") - F.min("count")).alias("spread"), F.countDistinct("env").alias("n_env"))
    assert counts.where((F.col("spread") > 1) | (F.col("n_env") != 3)).count() == 0


def test_contiguous_slices_sizes(spark):
    df = spark.range(1003).select(F.col("id").alias("example_id"))
    sizes = {r.env: r["count"] for r in assign_contiguous(df, 3, 0).groupBy("env").count().collect()}
    assert sizes == {1: 334, 2: 334, 3: 335}
    tiny = spark.range(2).select(F.col("id").alias("example_id"))
    assert {r.env for r in assign_contiguous(tiny, 3, 0).collect()} == {3}


def test_env_grid_values(spark):
    g = {r.env: (r.p_color, r.p_align) for r in env_grid(spark, 0.4, 2, 0.2, 0.9).collect()}
    assert math.isclose(g[1][0], 0.0, abs_tol=1e-12) and math.isclose(g[2][0], 0.4)
    assert math.isclose(g[0][1], 0.1)
    c = {r.env: r.p_color for r in env_grid(spark, 0.8, 3, 0.2, 0.9).collect()}
    assert c[1] == 0.0 and math.isclose(c[2], 0.2) and math.isclose(c[3], 0.6)


def test_injection_properties(spark):
    texts = [("The cat and a dog\tsat  in THE sun.", 0), ("nothing here", 1), ("", 0), ("with the　end", 1)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(texts)], "example_id long, text string, grp int")
    out = df.select("example_id", "text", "grp", inject_prefix("text", "grp", F.lit(0.7), "example_id", 3).alias("inj")).collect()
    for r in out:
        words = r.text.split()
        inj = r.inj.split(" ") if r.inj else []
        stripped = [w for w in inj if w not in (PREFIX_GROUP0, PREFIX_GROUP1)]
        assert stripped == words
        n_pref = len(inj) - len(stripped)
        assert n_pref == sum(1 for w in words if w.lower() in TARGET_TOKENS)
        for i, w in enumerate(inj):
            if w in (PREFIX_GROUP0, PREFIX_GROUP1):
                assert inj[i + 1].lower() in TARGET_TOKENS


def test_injection_alignment_rate(spark):
    n = 20000
    df = spark.range(n).select(F.col("id").alias("example_id"), F.lit("the").alias("text"), F.lit(0).alias("grp"))
    inj = df.select(inject_prefix("text", "grp", F.lit(0.8), "example_id", 0).alias("t"))
    aligned = inj.where(F.col("t") == f"{PREFIX_GROUP0} the").count()
    assert abs(aligned / n - 0.8) < 4 * math.sqrt(0.8 * 0.2 / n)


def test_tokens_match_python_split(spark):
    cases = ["a\tb\nc", "x y　z", "p\x1cq\x1dr\x1es\x1ft", "u\x85v", "  lead trail  ", "​zero-width", ""]
    df = spark.createDataFrame([(c,) for c in cases], "text string")
    got = [r.t for r in df.select(tokens("text").alias("t")).collect()]
    assert got == [c.split() for c in cases]


def test_moving_average_blocks_equal_window(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).cast("long").alias("step"),
                                 (F.col("id") * 1.5 % 7).alias("v"))
    got = moving_average(df, "run", "step", "v", "ma", window=20, block=25)
    ref = df.withColumn("ma", F.avg("v").over(Window.partitionBy("run").orderBy("step").rowsBetween(-19, 0)))
    a = {(r.run, r.step): r.ma for r in got.collect()}
    b = {(r.run, r.step): r.ma for r in ref.collect()}
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


def test_rank_and_cut_with_a_hot_group(spark):
    # one group holds 90% of the rows; 64 buckets spread it over many window partitions
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"), "id",
                                   draw(5, "h", "id").alias("d"))
    got = rank_within(df, ["g"], ["d", "id"], draw_bucket("d", 64), name="r")
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("d", "id")) - 1)
    assert sorted(got.select("id", "r").collect()) == sorted(ref.select("id", "r").collect())
    k = spark.createDataFrame([(99, 12345), (3, 7)], "g int, _k long")
    sel = first_k(df, ["g"], k, "d", "id", draw_bucket("d", 64))
    ref_sel = ref.join(k, "g").where(F.col("r") < F.col("_k"))
    assert sorted(r.id for r in sel.collect()) == sorted(r.id for r in ref_sel.collect())


def test_round_robin_is_partition_independent(spark):
    pool = balance_by_gender(fx.bios(spark, SF001))
    _, train = split_test_train(pool, 10)
    a = sorted((r.example_id, r.env) for r in assign_round_robin(train, 2, 0).collect())
    b = sorted((r.example_id, r.env) for r in assign_round_robin(train.repartition(13), 2, 0).collect())
    assert a == b
