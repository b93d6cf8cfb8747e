"""Line dedup: overlapping documents are aligned, and common blocks go from the later one.

A block is a stretch of neighbouring lines (blank ones aside) with at least ``min_words`` words. What
tells overlapping documents are hashes of lines that are rare because they are long: a line of
``min_words`` words or more, or, where lines are shorter, a shortest run of neighbouring ones that
reaches so many and begins or ends at a line. Every common block holds such a run, and there are two
per line at most. A document is paired with the first holder of each of its runs: one pair per
document and run however common the run is, never all pairs of its holders, and the first holder of
every run of a block is among the document's partners whichever other documents hold the block.

A pair is aligned with patience diff: trim common ends, anchor on lines that occur once on either
side, keep the longest increasing run of anchors, repeat in the gaps. Aligned neighbouring lines form
blocks. Runs that both documents hold but that cross the alignment (moved or repeated passages) are
then aligned on their own. Blocks of at least ``min_words`` words are deleted from the later document,
so a line goes if and only if it lies in a block that some earlier document holds. The first holder of
a line's blocks never loses them.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envlab.llm.common import column, join_first, store

MIN_WORDS = 20
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, for two run hashes modulo 2**64


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k:
            before[i] = at[k - 1]
        tails[k:k + 1] = [v]
        at[k:k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], increasing on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
        once = {x for x, n in ca.items() if n == 1 and cb.get(x) == 1}
        if once:
            place = {b[j]: j for j in range(j0, j1) if b[j] in once}
            mine = [i for i in range(i0, i1) if a[i] in once]
            anchors = [(mine[k], place[a[mine[k]]]) for k in increasing([place[a[i]] for i in mine])]
        else:
            continue
        i, j = i0, j0
        for x, y in anchors:
            todo.append((i, x, j, y))
            out.append((x, y))
            i, j = x + 1, y + 1
        todo.append((i, i1, j, j1))
    return sorted(out)


def _blocks(places: list[tuple[int, int]], words: list[int], min_words: int) -> set[int]:
    """Places in the later document of the aligned neighbouring lines that have ``min_words`` words."""
    out, block, end = set(), [], None
    for i, j in [*places, (-1, -1)]:
        if block and (i, j) != (end[0] + 1, end[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                out.update(block)
            block = []
        block.append(i)
        end = (i, j)
    return out


def repeated_lines(later: list[int], words: list[int], earlier: list[int], min_words: int) -> list[int]:
    """Places in ``later`` of the blocks of at least ``min_words`` words that ``earlier`` holds: first those
    of the patience alignment, then shared runs that cross it."""
    out = _blocks(patience(later, earlier), words, min_words)
    n = np.array([len(later)])
    _, begin, end = shortest_runs(n, np.array(words, dtype=np.int64), min_words)
    held: dict[int, set] = {}
    for i, j in zip(begin.tolist(), end.tolist()):
        if all(k in out for k in range(i, j)):
            continue
        if j - i not in held:
            held[j - i] = set(zip(*(earlier[k:] for k in range(j - i))))
        if tuple(later[i:j]) in held[j - i]:
            out.update(range(i, j))
    return sorted(out)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _aligned(pairs: DataFrame, seqs: DataFrame, min_words: int) -> DataFrame:
    """(key, at array<int>): places to delete, for stored pairs (key, first)."""
    partners = store(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n")), "line-partners")
    early = partners.join(seqs.select(F.col("key").alias("first"), F.col("h").alias("h2")), "first")
    sides = join_first(pairs, early, ["first"], F.col("key")).select(F.col("key").alias("k1"), "h2").join(
        seqs.select("key", "at", "h", "w"), F.col("k1") == F.col("key")
    ).select("key", "at", "h", "w", "h2")

    def run(batches):
        for b in batches:
            at = []
            for p, h, w, h2 in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                at.append([p[k] for k in repeated_lines(h, w, h2, min_words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32()))], names=["key", "at"])

    kind = seqs.schema["key"].dataType.simpleString()
    return sides.mapInArrow(run, f"key {kind}, at array<int>").where(F.size("at") > 0)


def shortest_runs(n: np.ndarray, w: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the shortest runs of at least ``min_words`` words that begin or end at
    each line, for documents of ``n`` lines whose words ``w`` follow one another; end is exclusive."""
    need = max(min_words, 1)
    edge = np.concatenate([[0], np.cumsum(n)])
    doc, at, c = np.repeat(np.arange(len(n)), n), np.arange(len(w)), np.concatenate([[0], np.cumsum(w)])
    end = np.searchsorted(c, c[:-1] + need)
    begin = np.searchsorted(c, c[1:] - need, side="right") - 1
    on, back = end <= edge[doc + 1], begin >= edge[doc]
    pairs = np.unique(np.concatenate([at[on] * (len(w) + 1) + end[on], begin[back] * (len(w) + 1) + at[back] + 1]))
    i, j = np.divmod(pairs, len(w) + 1)
    return doc[i], i, j


def _run_hash(h: np.ndarray, i: np.ndarray, j: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of h[i:j], by prefix sums modulo 2**64."""
    def powers(x: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(h), x, np.uint64)]), dtype=np.uint64)

    p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base)[:-1], dtype=np.uint64)])
    return ((p[j] - p[i]) * powers(pow(base, -1, 2**64))[i]).view(np.int64)


def _runs(seqs: DataFrame, min_words: int) -> DataFrame:
    """(key, r1, r2): two hashes of each of a document's shortest runs."""
    def run(batches):
        for b in batches:
            n = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            h = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            w = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            d, i, j = shortest_runs(n, w, min_words)
            cols = [pa.array(_run_hash(h, i, j, x)) for x in BASES]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), *cols], names=["key", "r1", "r2"])

    kind = seqs.schema["key"].dataType.simpleString()
    return seqs.select("key", "h", "w").mapInArrow(run, f"key {kind}, r1 bigint, r2 bigint")


def overlapping(seqs: DataFrame, min_words: int) -> DataFrame:
    """Stored (key, first): each document with the first holders of its runs that are other documents."""
    runs = _runs(seqs, min_words)
    known = store(
        runs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
        .where("first <> last").drop("last"), "line-runs",
    )
    later = join_first(runs, known, ["r1", "r2"], F.col("key")).where("key <> first")
    return store(later.select("key", "first").distinct(), "line-pairs")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, at array<int>): the lines (from 0) to delete of each document that has some;
    ``th`` is xxhash64 of its text and tells documents with equal ids apart."""
    seqs = store(
        docs.select(
            F.struct("doc_id", F.xxhash64("text").alias("th")).alias("key"),
            F.filter(
                F.transform(_lines(F.col("text")), lambda x, i: F.struct(
                    i.alias("at"), F.trim(x).alias("line")
                )), lambda s: s["line"] != ""
            ).alias("lines"),
        ).distinct().select(
            "key",
            F.transform("lines", lambda s: s["at"]).alias("at"),
            F.transform("lines", lambda s: F.xxhash64(s["line"])).alias("h"),
            F.transform("lines", lambda s: F.size(F.split(s["line"], r"\s+"))).alias("w"),
        ),
        "line-seqs",
    )
    return _aligned(overlapping(seqs, min_words), seqs, min_words).groupBy("key").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at")
    ).select("key.doc_id", "key.th", "at")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated blocks, and ``removed array<int>`` (line places).

    Lines are compared without outer blanks; blank lines are never deleted and never part a block;
    documents come in the order of (doc_id, hash of the text) with NULL ids first, so equal ids
    are fine and repeated rows are treated alike; a NULL text stays NULL; a text whose every line
    goes becomes empty; an empty table gives no rows; an input column ``removed`` is replaced, others
    stay as they are, whatever their names."""
    cut = repeated(docs, min_words).select(F.col("doc_id").alias("id"), "th", F.col("at").alias("places"))
    kept = [c for c in docs.columns if c != "removed"]
    rows = docs.select(F.struct(*[column(c) for c in kept]).alias("row"))
    out = rows.join(cut, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("th")), "left")
    left = F.array_join(F.filter(_lines(F.col("row.text")), lambda x, i: ~F.array_contains(F.col("places"), i)), "\n")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(left)
    return out.select(
        *[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in kept],
        F.coalesce("places", F.array().cast("array<int>")).alias("removed"),
    )
