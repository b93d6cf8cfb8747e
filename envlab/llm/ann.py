"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt by hash into shards of about ``SHARD_ROWS``; each shard's graph starts random and
is refined in two passes: a greedy search from the medoid proposes neighbours for a batch of nodes,
robust pruning with relaxation ``alpha`` keeps diverse edges (a candidate goes if a kept one is
alpha times nearer to it than the node is), and reverse edges are added and pruned alike. A query
runs a beam search on every shard's graph; the shards' nearest are merged by their exact distances.

Equal vectors are one node, which holds the k + 1 smallest ids (more can never be returned).
Queries meet shards in blocks, so a task holds one shard and one block of queries.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from envlab.llm.common import store

SHARD_ROWS = 16_384  # a search touches a share of a shard that shrinks as shards grow
QUERY_ROWS = 16_384
DEGREE = 28
BUILD_BEAM = 48
SEARCH_BEAM = 64
ALPHA = 1.2
BATCH = 256
SEED = 5


def _near(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[rows[i, j]]."""
    diff = x[rows] - q[:, None, :]
    return np.einsum("ijk,ijk->ij", diff, diff)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: (ids, squared distances), both (queries, beam),
    nearest first, padded with -1 and infinity, and the number of vectors that each query touched."""
    n, m = len(x), len(q)
    ids = np.full((m, beam), -1, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = ((x[start] - q) ** 2).sum(axis=1)
    seen = np.zeros((m, n), dtype=bool)
    seen[:, start] = True
    while True:
        rows = np.flatnonzero(~done.all(axis=1))
        if not len(rows):
            return ids, dist, seen.sum(axis=1)
        at = np.argmin(done[rows], axis=1)  # the nearest that is not expanded
        done[rows, at] = True
        near = edges[ids[rows, at]]
        new = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], np.where(near >= 0, near, start)] = True
        d = np.where(new, _near(x, near, q[rows]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_i = np.concatenate([ids[rows], near], axis=1)
        all_done = np.concatenate([done[rows], ~new], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        pick = np.arange(len(rows))[:, None]
        dist[rows], ids[rows] = all_d[pick, order], all_i[pick, order]
        done[rows] = all_done[pick, order] | ~np.isfinite(dist[rows])


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node from its candidates (-1 is none)."""
    v = x[cand]
    d = _near(x, cand, x[nodes])
    alive = (cand >= 0) & (cand != nodes[:, None])
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    out = np.full((len(nodes), degree), -1, dtype=np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        if not alive.any():
            break
        j = np.argmin(np.where(alive, d, np.inf), axis=1)
        ok = alive[rows, j]
        out[ok, k] = cand[rows, j][ok]
        alive &= alpha * alpha * between[rows, j] > d
        alive[rows, j] = False
        alive &= cand != cand[rows, j][:, None]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, int]:
    """(edges (n, degree) padded with -1, medoid) of the vectors ``x``."""
    n = len(x)
    medoid = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    rng = np.random.default_rng(seed)
    if n <= degree + 1:
        full = np.full((n, degree), -1, dtype=np.int64)
        for i in range(n):
            others = [j for j in range(n) if j != i]
            full[i, : len(others)] = others
        return full, medoid
    edges = rng.integers(0, n - 1, size=(n, degree))
    edges += edges >= np.arange(n)[:, None]
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at:at + BATCH]
            found, _, _ = beam_search(x, edges, medoid, x[batch], beam)
            edges[batch] = robust_prune(x, batch, np.concatenate([found, edges[batch]], axis=1), degree, relax)
            src, dst = np.repeat(batch, degree), edges[batch].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
            back = np.full((len(nodes), count.max()), -1, dtype=np.int64)
            back[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            for lo in range(0, len(nodes), BATCH):
                part = slice(lo, lo + BATCH)
                width = int(count[part].max())
                cand = np.concatenate([edges[nodes[part]], back[part, :width]], axis=1)
                edges[nodes[part]] = robust_prune(x, nodes[part], cand, degree, relax)
    return edges, medoid


def usable(v: Column) -> Column:
    """Not NULL, no NULL or non-finite component, and not all zeros."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda c: c != 0), F.lit(False))


INDEX = "dim int, shard int, medoid int, vectors array<array<float>>, ids array<array<long>>, edges array<array<int>>"


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, **options) -> DataFrame:
    """The stored index of (vec_id, embedding): a row per shard with its vectors, their smallest
    k + 1 ids, edges and medoid. Vectors of different lengths never share a shard.

    Rows with a NULL id or a vector that is NULL, zero or holds a NULL or non-finite component take no part;
    repeated rows count once; of a vector that many ids have, k + 1 ids are held however many there are; an
    empty table gives an empty index; other columns are ignored."""
    v = F.col("embedding").cast("array<float>")
    good = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(
        usable(F.col("embedding"))
    ).distinct()
    # the limit per vector is taken before the shuffle too, so a common vector costs little
    few = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = (
        good.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    nodes = store(nodes, "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        x = np.array(table["embedding"].to_pylist(), dtype=np.float32)
        edges, medoid = build_graph(x, **options)
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "medoid": pa.array([medoid], pa.int32()),
            "vectors": pa.array([x.tolist()], pa.list_(pa.list_(pa.float32()))),
            "ids": pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
            "edges": pa.array([[e[e >= 0].tolist() for e in edges]], pa.list_(pa.list_(pa.int32()))),
        })

    return store(
        dealt.withColumn("first", F.col("ids")[0]).groupBy("dim", "shard").applyInArrow(build, INDEX), "ann-index"
    )


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` nearest found of every query (vec_id, embedding): ``query_id, rank int, vec_id,
    score double`` (Euclidean, double precision), ties to the smaller vec_id, never the query's own
    id. Queries that are not usable give no rows; a query given twice is one query; an empty index or no
    queries give no rows; other columns are ignored."""
    q = queries.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")
    ).where(usable(F.col("q"))).distinct().withColumn("dim", F.size("q"))
    blocks = max(1, -(-q.count() // query_rows))
    shards = index.select(F.col("dim").alias("of"), F.col("shard").alias("nr"))  # one row per shard
    asked = q.join(shards, F.col("dim") == F.col("of")).select("dim", F.col("nr").alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "q")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def find(key: tuple[pa.Scalar, ...], shard: pa.Table, wanted: pa.Table) -> pa.Table:
        if not shard.num_rows or not wanted.num_rows:
            return schema.empty_table()
        x = np.array(shard["vectors"][0].as_py(), dtype=np.float32)
        ids, lists = shard["ids"][0].as_py(), shard["edges"][0].as_py()
        edges = np.full((len(x), max(1, max(map(len, lists)))), -1, dtype=np.int64)
        for i, e in enumerate(lists):
            edges[i, : len(e)] = e
        names = wanted["query_id"].to_pylist()
        qs = np.array(wanted["q"].to_pylist(), dtype=np.float64)
        wide = max(beam, k + 1)
        rows = []
        for at in range(0, len(qs), BATCH):
            part = qs[at:at + BATCH]
            near, _, _ = beam_search(x, edges, shard["medoid"][0].as_py(), part.astype(np.float32), wide)
            exact = np.sqrt(((x[near].astype(np.float64) - part[:, None, :]) ** 2).sum(axis=2))
            for name, ns, ds in zip(names[at:at + BATCH], near, exact):
                best = sorted(
                    (float(d), v) for n, d in zip(ns.tolist(), ds) if n >= 0 for v in ids[n] if v != name
                )[:k]
                rows += [(name, v, d) for d, v in best]
        if not rows:
            return schema.empty_table()
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    key = ["dim", "shard", "block"]
    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
