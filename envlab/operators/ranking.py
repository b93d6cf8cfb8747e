"""Skew-safe ranking primitives (W1, W2, W10 and friends).

A window ``partitionBy(group).orderBy(x)`` sends a whole group to one task; with a group holding a
third of the data that task never finishes. Both primitives here split every group into many
*buckets* of a monotone bucket expression (for a uniform draw: ``floor(draw * B)``) and only ever
sort inside one (group, bucket):

``rank_within``   exact 0-based rank of every row in its group. Per-(group, bucket) counts give
                  each bucket its offset (a running sum over a table of at most groups x B rows);
                  rows are then numbered inside their (group, bucket) and shifted by the offset.
                  One shuffle of the ranked rows on (group, bucket).

``first_k``       rows among the first ``k`` of their group. Only the one bucket per group that
                  holds the k-th row is sorted, to find the exact cut-off (value, tie-breaker);
                  every other row is kept or dropped by comparing with that cut-off, which is
                  joined back as a one-row-per-group broadcast. The rows themselves (and their
                  text) are never shuffled.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envlab.session import count_small, join_small, materialize

DEFAULT_BUCKETS = 1 << 16


def draw_bucket(col, buckets: int = DEFAULT_BUCKETS) -> Column:
    """Bucket of a [0, 1) draw; monotone in the draw."""
    c = F.col(col) if isinstance(col, str) else col
    return F.least(F.floor(c * F.lit(float(buckets))), F.lit(buckets - 1)).cast("long")


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "rank",
    total: str | None = None,
    coarser: Sequence[Column] = (),
) -> DataFrame:
    """Add ``name`` = 0-based position of each row within ``keys`` ordered by ``order``.

    ``bucket`` must be non-decreasing in ``order`` (rows of a lower bucket always come first).
    ``order`` must be a total order inside a group (end it with a unique key). With ``total``,
    the group's row count is added under that name as well (it comes with the offsets).

    Where a group can have any number of buckets, ``coarser`` names ever coarser buckets (each a function of
    the one before that does not decrease in it). Offsets are then summed level by level: a task sums the
    buckets of one coarser bucket, and the coarser buckets' totals are summed alike, up to the few of the last.
    """
    keys = list(keys)
    # keys and bucket as one struct: equal also where a key is NULL, and the join's partitioning serves the window
    part, b = "_rk_part", "_rk_part._rk_bucket"
    group = [f"{part}.{k}" for k in keys]
    x = df.withColumn(part, F.struct(*keys, bucket.alias("_rk_bucket"), *[c.alias(f"_rk_c{i}") for i, c in enumerate(coarser)]))
    counts = x.groupBy(part).agg(F.count(F.lit(1)).alias("_rk_n"))
    if coarser:
        counts = materialize(counts, "rank-buckets")
        cells = counts.select(part, *[F.col(g).alias(f"_rk_k{i}") for i, g in enumerate(group)], F.col(b).alias("_rk_l0"),
                              *[F.col(f"{part}._rk_c{i}").alias(f"_rk_l{i + 1}") for i in range(len(coarser))], "_rk_n")
        held = [f"_rk_k{i}" for i in range(len(keys))]
        offsets = _offsets(cells, held, 0, len(coarser)).select(part, "_rk_off")
        if total:
            sums = counts.groupBy(*[F.col(g).alias(h) for g, h in zip(group, held)]).agg(F.sum("_rk_n").alias(total))
            same = [F.col(g).eqNullSafe(F.col(h)) for g, h in zip(group, held)]
            offsets = (offsets.join(sums, same) if keys else offsets.crossJoin(sums)).drop(*held)
    else:
        w = Window.partitionBy(*group).orderBy(b) if keys else Window.orderBy(b)
        extra = []
        if total:
            extra.append(F.sum("_rk_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
        offsets = counts.select(
            part,
            (F.sum("_rk_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_rk_n")).alias(
                "_rk_off"
            ),
            *extra,
        )
    joined = x.join(offsets, part, "inner")
    wr = Window.partitionBy(part).orderBy(*order)
    return joined.withColumn(name, (F.row_number().over(wr) - 1 + F.col("_rk_off")).cast("long")).drop(part, "_rk_off")


def _offsets(cells: DataFrame, keys: list[str], level: int, last: int) -> DataFrame:
    """``cells`` (``keys``, buckets of this and all coarser levels, _rk_n) with ``_rk_off``, the rows before
    each cell in its group."""
    inside = [*keys, f"_rk_l{level + 1}"] if level < last else keys
    w = Window.partitionBy(*inside).orderBy(f"_rk_l{level}") if inside else Window.orderBy(f"_rk_l{level}")
    before = F.coalesce(F.sum("_rk_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = cells.withColumn("_rk_off", before)
    if level == last:
        return out
    levels = [f"_rk_l{i}" for i in range(level + 1, last + 1)]
    totals = cells.groupBy(*keys, *levels).agg(F.sum("_rk_n").alias("_rk_n"))
    above = _offsets(totals, keys, level + 1, last).select(*[F.col(c).alias(f"_up{c}") for c in inside], F.col("_rk_off").alias("_rk_above"))
    joined = out.join(above, [F.col(c).eqNullSafe(F.col(f"_up{c}")) for c in inside])
    return joined.withColumn("_rk_off", F.col("_rk_off") + F.col("_rk_above")).drop("_rk_above", *[f"_up{c}" for c in inside])


def first_k_cuts(
    df: DataFrame,
    keys: Sequence[str],
    k: DataFrame,
    value: str,
    tie: str,
    bucket: Column,
) -> tuple[DataFrame, int]:
    """The cut-off (``_fk_v``, ``_fk_t``) of every group: the (value, tie) of its k-th row, or
    NULLs when the group has no more than k rows (all kept). Groups missing from ``k`` or with
    ``_k <= 0`` have no cut (nothing kept). Returns the materialised cut table and the number of
    groups in ``k``, which bounds every table below (one row per group)."""
    keys = list(keys)
    k, n_groups = count_small(k.where(F.col("_k") > 0))
    b = "_fk_bucket"
    x = df.withColumn(b, bucket)
    counts = x.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_fk_n"))
    w = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = Window.partitionBy(*keys)
    cum = join_small(
        counts.withColumn("_fk_cum", F.sum("_fk_n").over(w)).withColumn("_fk_total", F.sum("_fk_n").over(wall)),
        k, keys, rows=n_groups,
    )
    # the bucket holding the k-th row of each group, and the position of that row inside it
    boundary = cum.where(
        (F.col("_fk_cum") >= F.col("_k")) & (F.col("_fk_cum") - F.col("_fk_n") < F.col("_k"))
    ).select(*keys, b, (F.col("_k") - (F.col("_fk_cum") - F.col("_fk_n"))).alias("_fk_need"))
    cand = join_small(x.select(*keys, b, value, tie), boundary, keys + [b], rows=n_groups)
    wc = Window.partitionBy(*keys).orderBy(value, tie)
    cut = (
        cand.withColumn("_fk_rn", F.row_number().over(wc))
        .where(F.col("_fk_rn") == F.col("_fk_need"))
        .select(*keys, F.col(value).alias("_fk_v"), F.col(tie).alias("_fk_t"))
    )
    # groups that have no more than k rows keep everything (read off the same window partitions)
    whole = (
        cum.where((F.col("_fk_total") < F.col("_k")) & (F.col("_fk_cum") == F.col("_fk_total")))
        .select(*keys, F.lit(None).cast(df.schema[value].dataType).alias("_fk_v"),
                F.lit(None).cast(df.schema[tie].dataType).alias("_fk_t"))
    )
    cuts, _ = count_small(cut.unionByName(whole))
    return cuts, n_groups


def apply_cuts(df: DataFrame, keys: Sequence[str], cuts: DataFrame, n_groups: int, value: str, tie: str,
               keep: str = "first") -> DataFrame:
    """Rows up to their group's cut (``keep="first"``) or after it (``keep="rest"``); rows of
    groups without a cut are dropped. A map-side filter against a broadcast of one row per group."""
    y = join_small(df, cuts, list(keys), rows=n_groups)
    inside = F.col("_fk_v").isNull() | (F.col(value) < F.col("_fk_v")) | (
        (F.col(value) == F.col("_fk_v")) & (F.col(tie) <= F.col("_fk_t"))
    )
    cond = inside if keep == "first" else ~inside
    return y.where(cond).drop("_fk_v", "_fk_t")


def flag_cuts(df: DataFrame, keys: Sequence[str], cuts: DataFrame, n_groups: int, value: str, tie: str,
              name: str) -> DataFrame:
    """Like :func:`apply_cuts`, but keeps every row of the listed groups and adds ``name`` = the
    row is within the first k."""
    y = join_small(df, cuts, list(keys), rows=n_groups)
    inside = F.col("_fk_v").isNull() | (F.col(value) < F.col("_fk_v")) | (
        (F.col(value) == F.col("_fk_v")) & (F.col(tie) <= F.col("_fk_t"))
    )
    return y.withColumn(name, inside).drop("_fk_v", "_fk_t")


def first_k(
    df: DataFrame,
    keys: Sequence[str],
    k: DataFrame,
    value: str,
    tie: str,
    bucket: Column,
    keep: str = "first",
) -> DataFrame:
    """Rows whose (``value``, ``tie``) is among the first ``k._k`` of their group.

    ``k`` is a small table (``keys`` + ``_k``); groups missing from it, or with ``_k <= 0``, keep
    nothing. With ``keep="rest"`` the complement inside the listed groups is returned instead
    (rows after the first k). ``bucket`` must be non-decreasing in ``value``.
    """
    cuts, n = first_k_cuts(df, keys, k, value, tie, bucket)
    return apply_cuts(df, keys, cuts, n, value, tie, keep)


def rows_at_positions(df: DataFrame, positions, value: str, tie: str, bucket: Column) -> tuple[list[tuple], int]:
    """(value, tie) of the rows at given 0-based positions of the global (value, tie) order, and
    the total row count.

    ``positions`` is a list, or a function of the row count returning one. The per-bucket
    counts (at most one row per bucket, a parameter-sized table) are read on the driver; only the
    buckets holding the wanted positions are then sorted, in one more job."""
    b = "_rp_bucket"
    x = df.withColumn(b, bucket)
    counts, _ = count_small(x.groupBy(b).agg(F.count(F.lit(1)).alias("_rp_n")))
    per = sorted((r[0], r[1]) for r in counts.collect())
    n = sum(c for _, c in per)
    wanted = sorted(set(int(p) for p in (positions(n) if callable(positions) else positions)))
    hits, before = [], 0
    it = iter(wanted)
    p = next(it, None)
    for bk, c in per:
        while p is not None and p < before + c:
            hits.append((bk, before, p))
            p = next(it, None)
        before += c
    if not hits:
        return [], n
    spark = df.sparkSession
    hit_df = spark.createDataFrame(hits, f"{b} long, _rp_before long, _rp_pos long")
    cand = join_small(x.select(b, value, tie), hit_df, b, rows=len(hits))
    wc = Window.partitionBy(b, "_rp_pos").orderBy(value, tie)
    got = (
        cand.withColumn("_rp_rn", F.row_number().over(wc) - 1)
        .where(F.col("_rp_rn") == F.col("_rp_pos") - F.col("_rp_before"))
        .select("_rp_pos", value, tie)
        .collect()
    )
    by_pos = {r[0]: (r[1], r[2]) for r in got}
    return [by_pos[q] for q in wanted if q in by_pos], n
