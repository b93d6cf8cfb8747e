"""Exact top-k by inner product: best-first search of paged M-trees.

Components become the integers floor(scale * x). With R the largest norm, a row x gets one more
component, sqrt(R^2 - |x|^2), and a query a zero: then the squared Euclidean distance of query q and
row x is |q|^2 + R^2 - 2 q.x, so the largest inner product is the smallest distance, and distances
obey the triangle inequality.

The rows are dealt to the nearest of some pivots (metric regions), a large region in parts, so that a
subtree holds ``SUBTREE_ROWS`` or so. A subtree is an M-tree: its pages hold entries, a routing entry
with its object, covering radius, distance to the parent object and child page, a leaf entry with a
row and its distance to the parent object. A table of pages, a row each, is the index.

A search first asks the nearest subtree of each query, which bounds its k-th distance; then it asks
only subtrees that can hold something within that bound. Inside a subtree, which a block of queries
searches at once, pages come nearest first;
|d(q, parent) - d(object, parent)| - radius bounds an entry's distance from below, so an entry beyond
the k-th best is skipped without computing its distance. Bounds are widened by a rounding margin,
scores are integer sums, and ties at the k-th place are kept: the result is exact.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from envlab.llm.common import store

SCALE = 256
SUBTREE_ROWS = 4096
PIVOT_PAGE = 4096  # pivots that a task holds at once
PAGE = 48  # entries of a page
QUERY_ROWS = 8192  # queries of a block
MARGIN = 1e-9  # relative rounding margin of distances
EXACT = 1 << 53  # sums of products up to here are exact in double precision
LARGEST = 1 << 62
LEAST, NONE = -(1 << 62), (1 << 63) - 1  # score and id of a place without an entry


def usable(v: Column) -> Column:
    """Not NULL and no NULL or non-finite component."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad), F.lit(False))


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double> of integers) of the usable rows of (vec_id, embedding)."""
    rows = vectors.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    ).where(usable(F.col("e")))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of integers ``a`` and ``b`` (as doubles), as long."""
    big = max(np.abs(a).max(initial=0), 1.0) * max(np.abs(b).max(initial=0), 1.0) * max(a.shape[1], 1)
    if big < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    if big >= LARGEST and not (np.abs(a) @ np.abs(b).T).max(initial=0) < LARGEST:
        raise OverflowError("an inner product does not fit in a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes all norms ``sqrt(top)``."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``."""
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def slack(*norms: float) -> float:
    """What a computed distance of points of such norms may be off by: squares are off by a few units
    in the last place, whose root counts near zero."""
    return 2 * max(norms) * math.sqrt(MARGIN * 1e-5) + MARGIN


# ---- building a subtree


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """Places of up to ``count`` objects, each the farthest from those before it."""
    picks = [0]
    far = distances(x, x[:1])[:, 0]
    while len(picks) < count:
        at = int(np.argmax(far))
        if far[at] <= 0:
            break
        picks.append(at)
        far = np.minimum(far, distances(x, x[at:at + 1])[:, 0])
    return np.array(picks)


def build_pages(x: np.ndarray, page: int = PAGE) -> list[dict]:
    """Pages of an M-tree over the lifted rows ``x``; the first is the root. A page: ``leaf``, ``obj``
    (places in x of its entries' objects), ``up`` (distances to the parent object; NaN in the root),
    and, of routing entries, ``radius`` and ``child`` (page numbers)."""
    pages: list[dict] = []
    margin = slack(float(np.sqrt((x * x).sum(axis=1).max(initial=0.0))))

    def add(at: np.ndarray, parent: int | None) -> int:
        number = len(pages)
        pages.append({})
        if len(at) <= page:
            up = distances(x[at], x[[parent]])[:, 0] if parent is not None else np.full(len(at), np.nan)
            pages[number] = {"leaf": True, "obj": at, "up": up, "radius": np.zeros(len(at)), "child": np.full(len(at), -1)}
            return number
        fan = min(page, -(-len(at) // page))
        picks = _spread(x[at], max(fan, 2))
        near = np.argmin(distances(x[at], x[at[picks]]), axis=1)
        parts = [(at[p], at[near == k]) for k, p in enumerate(picks)]
        if len(picks) < 2 or max(len(p) for _, p in parts) == len(at):  # objects that cannot be told apart
            cuts = np.array_split(at, fan)
            parts = [(int(c[0]), c) for c in cuts]
        obj, radius, child = [], [], []
        for o, members in parts:
            if not len(members):
                continue
            obj.append(int(o))
            radius.append(float(distances(x[members], x[[o]]).max()) + margin)
            child.append(add(members, int(o)))
        up = distances(x[obj], x[[parent]])[:, 0] if parent is not None else np.full(len(obj), np.nan)
        pages[number] = {"leaf": False, "obj": np.array(obj), "up": up, "radius": np.array(radius), "child": np.array(child)}
        return number

    add(np.arange(len(x)), None)
    return pages


# ---- searching a subtree


class Subtree:
    """Pages read back from the index, to be searched by a block of queries; ``computed`` counts the
    distances computed, ``skipped`` the entries that stored bounds spared."""

    def __init__(self, pages: dict[int, tuple], top: float):
        self.pages, self.top = pages, top
        self.computed = self.skipped = 0

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each (queries, k), of each query's best entries but those of id ``own``: largest
        score first, ties to the smaller id; places without an entry have id NONE. Scores below ``least``
        (-infinity: none) may be left out.

        Every query has its pages to visit, nearest first. The page that is next for most queries is
        taken, by all queries that still have to visit it, so a page is read once for a block."""
        n, norm = len(q), (q * q).sum(axis=1)
        margin = slack(math.sqrt(self.top), math.sqrt(norm.max(initial=0.0)))
        best, ids = np.full((n, k), LEAST, dtype=np.int64), np.full((n, k), NONE, dtype=np.int64)
        # finite, as an infinite ``lower`` marks a page that is done or not known yet
        bound = np.minimum(np.sqrt(np.maximum(norm + self.top - 2.0 * least, 0.0)) + margin, np.finfo(float).max)
        lower, parent = np.full((n, len(self.pages)), np.inf), np.full((n, len(self.pages)), np.nan)
        lower[:, 0] = 0.0
        while True:
            wants = np.argmin(lower, axis=1)
            votes = np.bincount(wants[lower[np.arange(n), wants] <= bound], minlength=lower.shape[1])
            page = int(np.argmax(votes))
            if not votes[page]:
                return best, ids
            rows = np.flatnonzero(lower[:, page] <= bound)
            lower[:, page] = np.inf
            leaf, v, up, radius, child, held = self.pages[page]
            # stored distances to the parent bound an entry's distance before it is computed
            near = np.abs(parent[rows, page][:, None] - up[None, :]) - radius[None, :] <= (bound[rows] + margin)[:, None] if page else np.ones((n, len(v)), dtype=bool)
            at = np.flatnonzero(near.any(axis=0))
            self.computed += len(rows) * len(at)
            self.skipped += len(rows) * (len(v) - len(at))
            if not len(at):
                continue
            scores = products(q[rows], v[at])
            if leaf:
                self._keep(rows, scores, [held[e] for e in at.tolist()], own, best, ids)
                full = rows[ids[rows, -1] != NONE]
                bound[full] = np.minimum(bound[full], np.sqrt(np.maximum(norm[full] + self.top - 2.0 * best[full, -1], 0.0)) + margin)
            else:
                d = np.sqrt(np.maximum(norm[rows][:, None] + self.top - 2.0 * scores, 0.0))
                lower[rows[:, None], child[at][None, :]] = np.maximum(d - radius[at][None, :] - margin, 0.0)
                parent[rows[:, None], child[at][None, :]] = d

    @staticmethod
    def _keep(rows: np.ndarray, scores: np.ndarray, held: list[list[int]], own: np.ndarray, best: np.ndarray, ids: np.ndarray) -> None:
        """Merge the scores of entries, which hold the ids ``held``, into the best of the queries ``rows``."""
        k = best.shape[1]
        some = (scores >= best[rows, -1][:, None]).any(axis=1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        entry = np.repeat(np.arange(len(held)), [len(x) for x in held])
        names = np.array([i for x in held for i in x], dtype=np.int64)
        new = scores[:, entry]
        new_ids = np.broadcast_to(names, new.shape).copy()
        mine = new_ids == own[rows][:, None]
        new[mine], new_ids[mine] = LEAST, NONE
        all_scores, all_ids = np.concatenate([best[rows], new], axis=1), np.concatenate([ids[rows], new_ids], axis=1)
        by_id = np.argsort(all_ids, axis=1, kind="stable")
        order = np.take_along_axis(by_id, np.argsort(-np.take_along_axis(all_scores, by_id, axis=1), axis=1, kind="stable"), axis=1)[:, :k]
        best[rows], ids[rows] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)


# ---- the index as tables

PAGES = (
    "dim int, region long, part int, page int, leaf boolean, vectors array<array<double>>, up array<double>, "
    "radius array<double>, child array<int>, ids array<array<long>>"
)
SUBTREE = ["dim", "region", "part"]


class Index:
    """``pages`` (a row per page), ``balls`` (a row per subtree: dim, region, part, pivot, radius) and
    ``top``, the squared norm of lifted rows."""

    def __init__(self, pages: DataFrame, balls: DataFrame, top: float):
        self.pages, self.balls, self.top = pages, balls, top


def _sheets(rows: DataFrame, count: int, *columns: str) -> DataFrame:
    """``rows`` (about ``count``) gathered by dim into rows of about PIVOT_PAGE of them."""
    sheet = F.pmod(F.xxhash64("region"), F.lit(max(1, -(-count // PIVOT_PAGE))))
    return rows.groupBy("dim", sheet.alias("sheet")).agg(F.collect_list(F.struct(*columns)).alias("sheet_rows"))


def build_index(vectors: DataFrame, k: int, scale: int = SCALE, subtree_rows: int = SUBTREE_ROWS, page: int = PAGE) -> Index:
    """The stored index of (vec_id, embedding). Equal vectors are one entry with their k + 1 smallest
    ids (more can never be returned). Vectors of different lengths never share a subtree."""
    rows = integers(vectors, scale).distinct()
    few = Window.partitionBy("v").orderBy("vec_id")
    objects = store(
        rows.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("v")),
        "mtree-objects",
    )
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top, count = objects.agg(F.max(norm), F.count(F.lit(1))).first()
    top = float(top or 0.0)
    wanted = max(1, -(-count // subtree_rows))
    # about as many pivots as subtrees are wanted, by hash, and one of every length
    some = objects.where(F.pmod(F.xxhash64("h"), F.lit(max(count, 1))) < wanted).select("dim", "h", "v")
    least = objects.groupBy("dim").agg(F.min_by(F.struct("h", "v"), "h").alias("x")).select("dim", "x.h", "x.v")
    pivots = _sheets(some.union(least).distinct().withColumnRenamed("h", "region"), wanted, "region", "v")
    blocks = objects.groupBy("dim", F.pmod(F.col("h"), F.lit(wanted)).alias("block")).agg(F.collect_list(F.struct("v", "ids")).alias("o"))

    def nearest(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, o, sheet = b.column(0)[r].as_py(), b.column(1)[r].values, b.column(2)[r].values
                x, p = (lifted(matrix(c.field("v")).reshape(len(c), dim), top) for c in (o, sheet))
                d = distances(x, p)
                at = np.argmin(d, axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(o), dim, dtype=np.int32)), o.field("v"), o.field("ids"), pa.array(d[np.arange(len(o)), at]),
                    sheet.field("region").take(pa.array(at)),
                ], names=["dim", "v", "ids", "d", "region"])

    met = blocks.join(pivots, "dim").select("dim", "o", "sheet_rows").mapInArrow(nearest, "dim int, v array<double>, ids array<long>, d double, region long")
    # a row per object and sheet of pivots
    dealt = store(met.groupBy("dim", "v", "ids").agg(F.min(F.struct("d", "region"))["region"].alias("region")), "mtree-dealt")
    parts = dealt.groupBy("dim", "region").agg(F.ceil(F.count(F.lit(1)) / (2 * subtree_rows)).cast("int").alias("parts"))
    dealt = dealt.join(parts, ["dim", "region"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending")])
        raw = matrix(table["v"]).reshape(table.num_rows, key[0].as_py())
        ids = table["ids"].to_pylist()
        out = []
        for number, p in enumerate(build_pages(lifted(raw, top), page)):
            at = p["obj"]
            out.append({
                "dim": key[0].as_py(), "region": key[1].as_py(), "part": key[2].as_py(), "page": number, "leaf": p["leaf"],
                "vectors": raw[at].tolist(), "up": p["up"].tolist(), "radius": p["radius"].tolist(), "child": p["child"].tolist(),
                "ids": [ids[i] for i in at] if p["leaf"] else [],
            })
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("dim", pa.int32()), ("region", pa.int64()), ("part", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()),
            ("vectors", pa.list_(pa.list_(pa.float64()))), ("up", pa.list_(pa.float64())), ("radius", pa.list_(pa.float64())),
            ("child", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int64()))),
        ]))

    pages = store(dealt.withColumn("first", F.col("ids")[0]).groupBy(*SUBTREE).applyInArrow(build, PAGES), "mtree-pages")
    return Index(pages, _balls(pages, top), top)


def _balls(pages: DataFrame, top: float) -> DataFrame:
    """(dim, region, part, pivot, radius): a ball around an object of a subtree's root page that holds
    all of the subtree."""
    def ball(batches):
        for b in batches:
            pivot, around = [], []
            for dim, vectors, radius in zip(*(b.column(i).to_pylist() for i in (0, 3, 4))):
                x = lifted(np.array(vectors, dtype=float).reshape(len(vectors), dim), top)
                mid = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
                pivot.append(vectors[mid])
                around.append(float((distances(x, x[[mid]])[:, 0] + radius).max()) + slack(math.sqrt(top)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(pivot, pa.list_(pa.float64())), pa.array(around, pa.float64())], names=[*SUBTREE, "pivot", "radius"]
            )

    first = pages.where("page = 0").select(*SUBTREE, "vectors", "radius")
    return store(first.mapInArrow(ball, "dim int, region long, part int, pivot array<double>, radius double"), "mtree-balls")


# ---- searching

QUERY = "query_id:bigint,q:array<double>,least:bigint,region:bigint,part:int"


def _route(blocks: DataFrame, sheets: DataFrame, top: float, every: bool) -> DataFrame:
    """Blocks of queries (dim, block, qs) meet sheets of subtree balls. A row per block and subtree with
    those of the block's queries that go there (qs), and of each its distance ``d`` from the pivot.
    ``every``: to all subtrees that can hold a score of ``least`` or more, but the one named by the query's
    region and part; else to the nearest of the sheet."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, block, qs, balls = b.column(0)[r].as_py(), b.column(1)[r], b.column(2)[r].values, b.column(3)[r].values
                q, p = matrix(qs.field("q")).reshape(len(qs), dim), matrix(balls.field("pivot")).reshape(len(balls), dim)
                norm = (q * q).sum(axis=1)
                d = np.sqrt(np.maximum(norm[:, None] + top - 2.0 * (q @ p.T), 0.0))
                if every:
                    least = qs.field("least")
                    least = np.where(least.is_null(), -math.inf, least.fill_null(0).to_numpy(zero_copy_only=False).astype(float))
                    far = np.sqrt(np.maximum(norm + top - 2.0 * least, 0.0)) + 2 * slack(math.sqrt(top), math.sqrt(norm.max()))
                    goes = d - balls.field("radius").to_numpy()[None, :] <= far[:, None]
                    region, part = (qs.field(c).to_numpy(zero_copy_only=False)[:, None] for c in ("region", "part"))
                    goes &= ~((region == balls.field("region").to_numpy()[None, :]) & (part == balls.field("part").to_numpy()[None, :]))
                else:
                    goes = np.zeros(d.shape, dtype=bool)
                    goes[np.arange(len(q)), np.argmin(d, axis=1)] = True
                for t in np.flatnonzero(goes.any(axis=0)).tolist():
                    at = np.flatnonzero(goes[:, t])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([dim], pa.int32()), balls.field("region").slice(t, 1), balls.field("part").slice(t, 1),
                        pa.array([block.as_py()], pa.int64()), pa.ListArray.from_arrays([0, len(at)], qs.take(pa.array(at))),
                        pa.array([d[at, t].tolist()], pa.list_(pa.float64())),
                    ], names=[*SUBTREE, "block", "qs", "d"])

    met = blocks.join(sheets, "dim").select("dim", "block", "qs", "sheet_rows")
    return met.mapInArrow(run, f"dim int, region long, part int, block long, qs array<struct<{QUERY}>>, d array<double>")


def _ask(routed: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, region, part, vec_id, score) found in the subtrees, and per subtree and block a row
    without a query: the numbers of distances ``computed`` and of entries ``skipped``. A task holds a
    subtree's pages and a block of queries."""
    top, key = index.top, [*SUBTREE, "block"]
    routed = store(routed, "mtree-routed")
    pages = index.pages.join(routed.select(*[F.col(c).alias(c) for c in key]).distinct(), SUBTREE)
    schema = pa.schema([
        ("query_id", pa.int64()), ("region", pa.int64()), ("part", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()),
        ("computed", pa.int64()), ("skipped", pa.int64()),
    ])

    def find(key: tuple[pa.Scalar, ...], wanted: pa.Table, pages: pa.Table) -> pa.Table:
        if not wanted.num_rows or not pages.num_rows:
            return schema.empty_table()
        dim, region, part = (x.as_py() for x in key[:3])
        held = {}
        for r in range(pages.num_rows):
            col = lambda name: pages[name][r]
            vs = col("vectors").values
            held[col("page").as_py()] = (
                col("leaf").as_py(), matrix(vs).reshape(len(vs), dim), np.asarray(col("up").values),
                np.asarray(col("radius").values), np.asarray(col("child").values), col("ids").as_py(),
            )
        tree, out = Subtree(held, top), []
        for block in wanted["qs"].chunks:
            x = block.flatten()
            own, least = x.field("query_id").to_numpy(), x.field("least")
            least = np.where(least.is_null(), -math.inf, least.fill_null(0).to_numpy(zero_copy_only=False).astype(float))
            scores, ids = tree.nearest(matrix(x.field("q")).reshape(len(x), dim), own, k, least)
            i, j = np.nonzero((ids != NONE) & (scores >= least[:, None]))
            zero = np.zeros(len(i), dtype=np.int64)
            out.append([own[i], zero + region, zero.astype(np.int32) + part, ids[i, j], scores[i, j], zero, zero])
        found = pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        work = [[None], [region], [part], [None], [None], [tree.computed], [tree.skipped]]
        return pa.concat_tables([found, pa.table([pa.array(c, f.type) for c, f in zip(work, schema)], schema=schema)])

    return routed.groupBy(*key).cogroup(pages.groupBy(*key)).applyInArrow(
        find, "query_id long, region long, part int, vec_id long, score long, computed long, skipped long"
    )


def searched(index: Index, queries: DataFrame, k: int, scale: int = SCALE, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Stored (query_id, vec_id, score) of all that can be among a query's best, and rows without a query
    with the numbers of distances ``computed`` and of entries ``skipped``."""
    asked = store(
        integers(queries, scale).groupBy("vec_id").agg(F.min("v").alias("q"))
        .select(F.size("q").alias("dim"), F.col("vec_id").alias("query_id"), "q"), "mtree-queries",
    )
    blocks = max(1, -(-asked.count() // query_rows))
    sheets = store(_sheets(index.balls, index.balls.count(), "region", "part", "pivot", "radius"), "mtree-sheets")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")

    def blocked(df: DataFrame) -> DataFrame:
        return df.groupBy("dim", block).agg(F.collect_list(F.struct("query_id", "q", "least", "region", "part")).alias("qs"))

    none = asked.withColumn("least", F.lit(None).cast("long")).withColumn("region", F.lit(0).cast("long")).withColumn("part", F.lit(-1))
    near = _route(blocked(none), sheets, index.top, every=False).select(
        *SUBTREE, F.explode(F.arrays_zip("qs", "d")).alias("x")
    ).select("dim", F.col("x.qs.query_id").alias("query_id"), F.struct("x.d", "region", "part", "x.qs.q").alias("x"))
    # one subtree per query, which bounds its k-th score
    near = near.groupBy("dim", "query_id").agg(F.min("x").alias("x")).select("dim", "query_id", "x.q", F.lit(None).cast("long").alias("least"), "x.region", "x.part")
    packed = near.groupBy(*SUBTREE, block).agg(F.collect_list(F.struct("query_id", "q", "least", "region", "part")).alias("qs"))
    first = store(_ask(packed, index, k), "mtree-first")
    kth = first.where("vec_id IS NOT NULL").groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"), F.min("region").alias("region"), F.min("part").alias("part")
    )
    # a query whose subtree held nothing else asks it once more
    bounded = asked.join(kth, "query_id", "left").select(
        "dim", "query_id", "q", "least", F.coalesce("region", F.lit(0).cast("long")).alias("region"), F.coalesce("part", F.lit(-1)).alias("part")
    )
    rest = _ask(_route(blocked(bounded), sheets, index.top, every=True).drop("d"), index, k)
    return store(first.unionByName(rest), "mtree-found")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.where("vec_id IS NOT NULL").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search(index: Index, queries: DataFrame, k: int, scale: int = SCALE, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The ``k`` largest inner products of every query (vec_id, embedding): ``query_id, rank int, vec_id,
    score long``, ties to the smaller vec_id, never the query's own id; fewer rows if there are fewer
    candidates.

    Rows with a NULL id, a NULL vector or a NULL or non-finite component take no part; zero vectors do;
    vectors meet those of their own length only; a candidate id that comes with several vectors counts
    once, by its best score, and of a query id with several the vector that sorts first asks; repeated
    rows count once; an empty table gives no rows; other columns are ignored. An inner product beyond a
    long raises OverflowError."""
    return best_of(searched(index, queries, k, scale, query_rows), k)
