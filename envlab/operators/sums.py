"""Sums of doubles that do not depend on order: exact means and standard deviations.

A double is an integer times a power of two. Rows are summed by group and power: the integer and its
square are cut into pieces of at most 29 bits, whose sums are exact in longs for 2**33 rows of a group and
power, in any order and under any partitioning (partial sums before the shuffle as ever). A group then has
one row per power of two among its values (some tens as a rule, 2,100 at most), and the pieces are put
together as big integers, in tasks, a group's row at a time. Mean and variance are exact fractions, rounded
once. So results are the same for every order, partitioning and retry, with no bound on counts or values.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 28
PIECES = ["hi", "lo", "hh_hi", "hh_lo", "hl_hi", "hl_lo", "ll_hi", "ll_lo"]


def _exact(pieces: list[tuple], n: int) -> tuple[float | None, float | None]:
    """Mean and sample standard deviation from rows (power, sums of PIECES) of ``n`` finite values."""
    if not n:
        return None, None
    low = min(p[0] for p in pieces)
    total = squares = 0
    for power, hi, lo, hh_hi, hh_lo, hl_hi, hl_lo, ll_hi, ll_lo in pieces:
        shift = power - low
        total += ((hi << BITS) + lo) << shift
        hh, hl, ll = ((a << BITS) + b for a, b in ((hh_hi, hh_lo), (hl_hi, hl_lo), (ll_hi, ll_lo)))
        squares += ((hh << 2 * BITS) + (hl << BITS + 1) + ll) << 2 * shift
    mean = _quotient(total, n, low)
    if n < 2:
        return mean, None
    return mean, _root(n * squares - total * total, n * (n - 1), low)


def _quotient(a: int, b: int, power: int) -> float:
    """a / b * 2**power, rounded once; infinite beyond the largest double."""
    try:
        return (a << power) / b if power >= 0 else a / (b << -power)
    except OverflowError:
        return math.copysign(math.inf, a)


def _root(a: int, b: int, power: int) -> float:
    """sqrt(a / b) * 2**power with a relative error far below a double's."""
    if a <= 0:
        return 0.0
    shift = max(0, 160 - (a.bit_length() - b.bit_length()))
    shift += shift % 2
    root = math.isqrt((a << shift) // b)
    return _quotient(root, 1, power - shift // 2)


def exact_mean_std(df: DataFrame, keys: Sequence[str], values: dict[str, F.Column]) -> DataFrame:
    """``keys`` and per entry (name, column) of ``values``: ``<name>_n`` (long; finite values), ``<name>_mean``
    and ``<name>_std`` (double; sample standard deviation).

    NULL and NaN do not count; a group without values has mean NULL, and std NULL below two values; with an
    infinite value the mean is that infinity (NULL with both) and the std is NULL. NULL keys are a group."""
    keys, names = list(keys), list(values)
    kept = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    held = [f"_k{i}" for i in range(len(keys))]
    entries = F.array(*[F.struct(F.lit(i).alias("m"), values[name].cast("double").alias("v")) for i, name in enumerate(names)])
    long = df.select(*kept, F.explode(entries).alias("_e")).select(*held, "_e.m", F.nanvl("_e.v", F.lit(None).cast("double")).alias("v"))
    size = F.abs("v")
    finite = F.col("v").isNotNull() & (size < float("inf"))
    # a power that leaves an integer of at most 56 bits: log2 may be off by one, so two bits are spare
    power = F.when(size > 0, F.floor(F.log2(size)).cast("int") - 54).otherwise(F.lit(0))
    half = F.floor(-F.col("power") / 2)
    whole = (F.col("v") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -F.col("power") - half)).cast("long")
    parts = long.select(*held, "m", "v", F.when(finite, power).alias("power")).select(
        *held, "m", "v", "power", F.when(F.col("power").isNotNull(), whole).alias("x")
    )
    parts = parts.select(*held, "m", "v", "power", F.shiftright("x", BITS).alias("hi"), F.col("x").bitwiseAND((1 << BITS) - 1).alias("lo"))
    cut = {"hh": F.col("hi") * F.col("hi"), "hl": F.col("hi") * F.col("lo"), "ll": F.col("lo") * F.col("lo")}
    sums = [F.sum("hi").alias("hi"), F.sum("lo").alias("lo")]
    for name, product in cut.items():
        sums += [F.sum(F.shiftright(product, BITS)).alias(f"{name}_hi"), F.sum(product.bitwiseAND((1 << BITS) - 1)).alias(f"{name}_lo")]
    infinite = [F.max(F.col("v") == s * float("inf")).alias(f"inf{i}") for i, s in enumerate((1, -1))]
    by_power = parts.groupBy(*held, "m", "power").agg(F.count("power").alias("n"), *sums, *infinite)
    pieces = F.collect_list(F.when(F.col("power").isNotNull(), F.struct("power", *PIECES)))
    groups = by_power.groupBy(*held, "m").agg(F.sum("n").alias("n"), pieces.alias("pieces"), F.max("inf0").alias("up"), F.max("inf1").alias("down"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_exact([tuple(p.values()) for p in ps], int(n)) for n, ps in zip(b["n"], b["pieces"])]
            b["mean"] = pd.array([x for x, _ in out], dtype="Float64")
            b["std"] = pd.array([x for _, x in out], dtype="Float64")
            yield b.drop(columns=["pieces"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema if f.name != "pieces"]
    done = groups.mapInPandas(finish, ", ".join([*fields, "mean double", "std double"]))
    up, down = F.coalesce("up", F.lit(False)), F.coalesce("down", F.lit(False))
    mean = F.when(up & down, F.lit(None)).when(up, F.lit(float("inf"))).when(down, F.lit(float("-inf"))).otherwise(F.col("mean"))
    done = done.withColumn("mean", mean).withColumn("std", F.when(~up & ~down, F.col("std")))
    pick = lambda c, i: F.max(F.when(F.col("m") == i, F.col(c)))
    wide = done.groupBy(*held).agg(*[
        x for i, name in enumerate(names)
        for x in (pick("n", i).alias(f"{name}_n"), pick("mean", i).alias(f"{name}_mean"), pick("std", i).alias(f"{name}_std"))
    ])
    return wide.select(*[F.col(h).alias(k) for h, k in zip(held, keys)], *[f"`{name}_{x}`" for name in names for x in ("n", "mean", "std")])
