"""Linear heads over fixed features, fitted on Spark (M1-M3).

M1  pooled baseline: one multinomial logistic regression on the union of environments
    (``pyspark.ml``).
M2  one linear head per environment on shared *frozen* features, trained as the reference's
    game mode does with the encoder frozen: every head takes a gradient step on its own
    environment's cross-entropy of the *averaged* logits. Full-batch gradient descent: per
    iteration one distributed pass computes per-partition partial gradients with numpy
    (``mapInPandas``), Spark sums them by (env, coordinate), and the driver updates the heads,
    whose size is the model's (E x C x D), not the data's.
    ``fit_heads_in_turns`` does it as the reference's loop does: heads take turns over dealt
    mini-batches, K updates of every head a round, a batch read by partition and batch number.
M3  scoring: head logits per (example, env) from the fitted heads (broadcast table of E rows),
    with JVM higher-order functions; the output is the head-output table (D4).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envlab.operators.encode import batch_plan
from envlab.session import join_small


def fit_pooled(train: DataFrame, features: str = "features", label: str = "label", max_iter: int = 50,
               reg: float = 0.0):
    """M1: ``LogisticRegression`` (multinomial) on the pooled rows; returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = train.select(array_to_vector(F.col(features)).alias("_v"), F.col(label).cast("double").alias("_y"))
    lr = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=max_iter, regParam=reg, family="multinomial")
    return lr.fit(x)


def predict_pooled(model, df: DataFrame, features: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_v", array_to_vector(F.col(features)))
    return model.transform(x.withColumnRenamed("_v", model.getFeaturesCol())).withColumn(
        "pred", F.col("prediction").cast("int")
    ).drop(model.getFeaturesCol(), "rawPrediction", "probability", "prediction")


def _grad_fn(weights: dict[str, np.ndarray], envs: list[str]):
    """Per-partition partial gradients of every head: one row per environment per partition."""
    e_n = len(envs)

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {e: np.zeros_like(weights[e]) for e in envs}
        cnt = {e: 0 for e in envs}
        loss = {e: 0.0 for e in envs}
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["features"].to_numpy()).astype("float64")
            y = pdf["label"].to_numpy().astype("int64")
            logits = sum(x @ weights[e].T for e in envs) / e_n
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            onehot = np.zeros_like(p)
            onehot[np.arange(len(y)), y] = 1.0
            # d CE(mean_e W_e x) / d W_e = (p - y) x^T / E
            err = (p - onehot) / e_n
            nll = -np.log(np.clip(p[np.arange(len(y)), y], 1e-300, None))
            env = pdf["env"].to_numpy()
            for e in envs:
                m = env == e
                if m.any():
                    acc[e] += err[m].T @ x[m]
                    cnt[e] += int(m.sum())
                    loss[e] += float(nll[m].sum())
        yield pd.DataFrame({"env": envs, "g": [acc[e].ravel() for e in envs], "n": [cnt[e] for e in envs],
                            "loss": [loss[e] for e in envs]})

    return fn


def _add(a: dict, b: dict) -> dict:
    for k, (g, n, l_) in b.items():
        if k in a:
            g0, n0, l0 = a[k]
            a[k] = (g0 + g, n0 + n, l0 + l_)
        else:
            a[k] = (g, n, l_)
    return a


def _seq(acc: dict, row) -> dict:
    return _add(acc, {row["env"]: (np.asarray(row["g"], dtype="float64"), int(row["n"]), float(row["loss"]))})


def fit_env_heads(spark: SparkSession, train: DataFrame, n_classes: int, dim: int, iterations: int = 30,
                  lr: float = 0.5, features: str = "features", label: str = "label", env: str = "env",
                  seed: int = 0) -> tuple[dict[str, np.ndarray], list[dict]]:
    """M2: returns the heads ``{env: W (C x D)}`` and the per-iteration mean loss per environment.

    The per-partition gradients (one small row per environment and partition) are combined with a
    tree reduction, so no single task receives all partitions' gradients."""
    x = train.select(F.col(env).alias("env"), F.col(features).alias("features"), F.col(label).cast("int").alias("label"))
    x = x.persist()
    envs = sorted(r[0] for r in x.select("env").distinct().collect())
    rng = np.random.default_rng(seed)
    weights = {e: rng.normal(0.0, 0.01, size=(n_classes, dim)) for e in envs}
    history = []
    schema = "env string, g array<double>, n long, loss double"
    for it in range(int(iterations)):
        parts = x.mapInPandas(_grad_fn(weights, envs), schema)
        tot = parts.rdd.treeAggregate({}, _seq, _add, depth=2)
        for e in envs:
            if e not in tot or tot[e][1] == 0:
                continue
            g, n, loss = tot[e]
            weights[e] = weights[e] - lr * g.reshape(n_classes, dim) / n
            history.append({"iteration": it, "env": e, "loss": loss / n})
    x.unpersist()
    return weights, history


BATCHES_PER_FOLDER = 256


def store_batches(train: DataFrame, path: str, batch_size: int, seed: int, env: str = "env", key: str = "example_id",
                  features: str = "features", label: str = "label") -> None:
    """Deal each environment's rows into mini-batches (W8) and store them so that one batch is read alone:
    a folder per environment and BATCHES_PER_FOLDER batches, rows in the order of batches."""
    plan = batch_plan(train.select(env, key), batch_size, seed, env=env, key=key)
    on = [F.col(env).eqNullSafe(F.col("_env")), F.col(key).eqNullSafe(F.col("_key"))]
    rows = train.join(plan.withColumnsRenamed({env: "_env", key: "_key"}), on).select(
        F.col(env).alias("env"), F.floor(F.col("batch_id") / BATCHES_PER_FOLDER).cast("int").alias("folder"), "batch_id", "rank",
        F.col(features).alias("features"), F.col(label).cast("int").alias("label"),
    )
    rows.repartition("env", "folder").sortWithinPartitions("batch_id", "rank").write.partitionBy("env", "folder").parquet(path)


def head_gradient(x: np.ndarray, y: np.ndarray, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the gradient of the cross-entropy of the averaged logits in one head (all have the same), as
    (rows, C, D), and the loss. A row's numbers do not depend on the rows that come with it."""
    heads = np.mean([weights[e] for e in sorted(weights)], axis=0)
    logits = (x[:, None, :] * heads[None, :, :]).sum(axis=2)
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = -np.log(np.maximum(p[at, y], 1e-300))
    p[at, y] -= 1.0
    return (p / len(weights))[:, :, None] * x[:, None, :], loss


def fit_heads_in_turns(spark: SparkSession, path: str, n_classes: int, dim: int, max_steps: int, k: int = 1, batch_size: int = 64,
                       grad_accum: int = 1, lr: float = 0.5, max_grad_norm: float | None = None, seed: int = 0,
                       window: int = 20) -> tuple[dict[str, np.ndarray], list[dict]]:
    """M2 as the reference's loop: rounds of ``k`` passes over the environments in the order of their names;
    a pass takes the environment's next stored batch (:func:`store_batches`; the batches are replayed in
    their order), adds the gradient of its loss in its own head, and after ``grad_accum`` batches of the
    environment its head takes a step. Ends after the round that reaches ``max_steps`` steps.

    Returns the heads and the training log, a row per batch: step, env, round, train_loss (divided by
    ``grad_accum``, as the reference logs it) and its moving average.

    Every batch is one small job that reads the batch's folder and row groups. Rows are turned into
    fixed-point numbers by a bound that the largest feature gives and summed as integers, so neither
    the order nor the partitioning of the rows changes a bit of the result."""
    stored = spark.read.parquet(path)
    sizes = {r["env"]: r["n"] for r in stored.groupBy("env").agg((F.max("batch_id") + 1).alias("n")).collect()}
    envs = sorted(sizes)
    largest = stored.agg(F.max(F.array_max(F.transform("features", F.abs)))).first()[0] or 1.0
    bits = 61 - int(np.ceil(np.log2(max(batch_size, 2))))
    unit, loss_unit = 2.0 ** (bits - np.ceil(np.log2(max(largest, 1e-300)))), 2.0 ** (bits - 10)  # a loss is below 2**10
    rng = np.random.default_rng(seed)
    weights = {e: rng.normal(0.0, 0.01, size=(n_classes, dim)) for e in envs}

    def partial(current: dict[str, np.ndarray]):
        def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, loss, n = np.zeros(n_classes * dim, dtype=np.int64), 0, 0
            for pdf in batches:
                if len(pdf):
                    g, nll = head_gradient(np.stack(pdf["features"].to_numpy()).astype("float64"), pdf["label"].to_numpy().astype("int64"), current)
                    total += np.rint(g.reshape(len(pdf), -1) * unit).astype(np.int64).sum(axis=0)
                    loss += int(np.rint(nll * loss_unit).astype(np.int64).sum())
                    n += len(pdf)
            if n:
                yield pd.DataFrame({"g": [total], "loss": [loss], "n": [n]})

        return fn

    def gradient(env: str, batch: int) -> tuple[np.ndarray, float]:
        rows = stored.where((F.col("env") == env) & (F.col("folder") == batch // BATCHES_PER_FOLDER) & (F.col("batch_id") == batch))
        # a row per task that holds rows of the batch
        got = rows.select("features", "label").mapInPandas(partial(weights), "g array<long>, loss long, n long").collect()
        n = sum(r["n"] for r in got)
        total = np.sum([np.array(r["g"], dtype=np.int64) for r in got], axis=0)
        return total.reshape(n_classes, dim) / unit / n, sum(r["loss"] for r in got) / loss_unit / n

    taken, held = dict.fromkeys(envs, 0), {e: [] for e in envs}
    step = rounds = 0
    log: list[dict] = []
    while step < max_steps:
        for _ in range(k):
            for e in envs:
                g, loss = gradient(e, taken[e] % sizes[e])
                taken[e] += 1
                held[e].append(g / grad_accum)
                recent = [r["train_loss"] for r in log[-(window - 1):]] if window > 1 else []
                log.append({"step": step, "env": e, "round": rounds, "train_loss": loss / grad_accum,
                            "train_loss_moving_avg": float(np.mean([*recent, loss / grad_accum]))})
                if len(held[e]) == grad_accum:
                    total = sum(held[e])
                    norm = float(np.sqrt((total * total).sum()))
                    if max_grad_norm and norm > max_grad_norm:
                        total = total * (max_grad_norm / (norm + 1e-6))
                    weights[e] = weights[e] - lr * total
                    held[e] = []
                    step += 1
        rounds += 1
    return weights, log


def head_table(spark: SparkSession, weights: dict[str, np.ndarray]) -> DataFrame:
    """The heads as a table ``(env, n_classes, w)`` with ``w`` flattened row-major (D5-like)."""
    rows = [(e, int(w.shape[0]), [float(v) for v in w.ravel()]) for e, w in sorted(weights.items())]
    return spark.createDataFrame(rows, "env string, n_classes int, w array<double>")


def score_heads(examples: DataFrame, heads: DataFrame, envs: list[str], features: str = "features",
                key: str = "example_id", label: str = "label") -> DataFrame:
    """M3: head logits of every example under every head, as (example_id, env, logits, label).

    Each example is repeated once per head (E, a model size) and equi-joined with the broadcast
    head table on ``env``."""
    x = examples.select(key, F.col(features).alias("_x"), F.col(label).alias("label"),
                        F.explode(F.array(*[F.lit(e) for e in envs])).alias("env"))
    j = join_small(x, heads, "env", rows=len(envs))
    d = F.size("_x")
    logits = F.transform(
        F.sequence(F.lit(0), F.col("n_classes") - 1),
        lambda c: F.aggregate(F.zip_with(F.slice("w", c * d + 1, d), "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v),
    )
    return j.select(key, "env", logits.alias("logits"), "label")
