"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments, so that of two fingerprints
within ``max_bits`` one segment differs by at most one bit. Every segment is indexed whole and once
per bit with that bit as a wildcard; equal index keys propose pairs, which are verified on all bits.
A wildcard key proposes only pairs that differ in its bit, so a pair is not proposed by all the
variants of an equal segment.

Only distinct fingerprints are indexed: a group of copies is one entry. A key shared by more than
``KEY_PAIRS`` fingerprints proposes no pairs; its members are indexed by all wildcard choices of
``max_bits`` bits of the whole fingerprint instead, where sharing a key *is* being within
``max_bits`` and at most 2**max_bits fingerprints can share one. Links are the same either way.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from envlab.llm.common import column, join_first, store

BITS = 64
SEED = 42
KEY_PAIRS = 256
MASK64 = (1 << 64) - 1


def fingerprint(text: str | bytes | None, words: int = 3) -> int:
    """The unsigned fingerprint of a text: shingles of ``words`` words (A-Z lowered, split at
    ASCII white space; a shorter text is one shingle), bit set if set in over half the XXH64
    hashes. No words: 0."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    w = raw.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*[w[i:] for i in range(words)]))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``th`` (xxhash64 of the text) and ``fp`` (the fingerprint as a signed long) of
    every row."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), dtype="<u8", count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view("<i8"))], names=["doc_id", "th", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, fp long")


def _segments(max_bits: int) -> list[tuple[int, int]]:
    n = max_bits // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _index(fps: DataFrame, max_bits: int) -> DataFrame:
    """(variant, part, fp): ``variant`` is 100 times the segment's start, plus 1, plus the wildcard's
    bit (-1: none); ``part`` has the segment's bits but the wildcard."""
    entries = []
    for lo, hi in _segments(max_bits):
        segment = ((1 << (hi - lo)) - 1) << lo
        for bit in (-1, *range(lo, hi)) if max_bits else (-1,):
            mask = segment & ~(1 << bit) if bit >= 0 else segment
            entries.append(F.struct(
                F.lit(lo * 100 + bit + 1).alias("variant"),
                F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("part"),
            ))
    return fps.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.variant", "e.part", "fp")


def _bit(fp: Column, bit: Column) -> Column:
    return F.call_function("getbit", fp, F.greatest(bit, F.lit(0)))


def links(fps: DataFrame, max_bits: int = 2, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``max_bits`` bits that connect all that are linked.
    ``fps``: one row per distinct fingerprint, column ``fp``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    # one shuffle of the index; a key's entries are counted as they stream by, in order of key
    key = Window.partitionBy("variant", "part")
    members = _index(fps, max_bits).withColumn("n", F.count(F.lit(1)).over(key)).where("n > 1")
    members = store(members.withColumn("bit", F.col("variant") % 100 - 1), "simhash-members")
    few, many = members.where(F.col("n") <= key_pairs), members.where(F.col("n") > key_pairs)
    one, two = few.alias("x"), few.alias("y")
    wild = F.col("x.bit") >= 0
    pairs = one.join(
        two,
        (F.col("x.variant") == F.col("y.variant")) & (F.col("x.part") == F.col("y.part"))
        & F.when(wild, (_bit(F.col("x.fp"), F.col("x.bit")) == 0) & (_bit(F.col("y.fp"), F.col("x.bit")) == 1))
        .otherwise(F.col("x.fp") < F.col("y.fp"))
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    masks = [_signed(MASK64 & ~sum(1 << i for i in bits)) for bits in combinations(range(BITS), max_bits)]
    hot = (
        many.select("fp").distinct()
        .select("fp", F.explode(F.lit(masks).cast("array<long>")).alias("mask"))
        .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
        .groupBy("mask", "part").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    )
    return pairs.union(hot).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of undirected edges (a, b) of longs, the smallest node
    of each as its root, by alternating large-star and small-star steps. Every step is two grouped
    minima joined back, stored in the shared folder; nothing but a count and a checksum per step
    reaches the driver."""
    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    seen = None
    while (now := state(edges)) != seen:
        seen = now
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = store(large, "cc")
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = store(small.where("a <> b").distinct(), "cc")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()


def _classes(docs: DataFrame, words: int, max_bits: int, key_pairs: int) -> DataFrame:
    """(doc_id, th, fp, first) of every row: ``th`` is xxhash64 of the text, ``first`` the first (doc_id,
    th) of the row's class, NULL ids last."""
    prints = store(fingerprints(docs, words), "simhash-fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    groups = store(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    roots = store(components(links(groups.select("fp"), max_bits, key_pairs)), "simhash-roots")
    joined = roots.join(groups, roots["node"] == groups["fp"]).select("node", "root", "first")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    linked = joined.join(least, "root").select(F.col("node").alias("fp"), "least")
    of = store(groups.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("first")), "simhash-classes")
    # a fingerprint of many copies is dealt over several tasks
    return join_first(prints, of, ["fp"], F.monotonically_increasing_id())


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """One row per document: ``doc_id, fp long, component_id``, the smallest doc_id reachable over
    links of at most ``max_bits`` differing bits.

    A NULL, empty or blank text has fingerprint 0 and is linked like any other; equal fingerprints
    are always linked; a NULL doc_id keeps its row and is a component's id only if it holds no
    other; repeated rows are kept; an empty table gives no rows; other columns are ignored."""
    classed = _classes(docs, words, max_bits, key_pairs)
    return classed.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 3, max_bits: int = 2, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one row of each near-duplicate class:
    that of the smallest doc_id (then the smallest hash of the text, then any of equal rows)."""
    classed = _classes(docs, words, max_bits, key_pairs)
    rows = classed.select("doc_id", "th", F.col("first").alias("f"))
    stays = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("th").eqNullSafe(F.col("f.th"))
    # stored, so that the planner knows its size: a small list of rejects is broadcast, a large one is not
    gone = store(rows.where(~stays).select(F.col("doc_id").alias("id"), "th").distinct(), "simhash-gone")
    whole = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row")).select("row", F.xxhash64("row.text").alias("h"))
    out = whole.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th")), "left_anti")
    again = rows.where(stays).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        out = out.select("row", "h", F.col("row.doc_id").alias("id")).dropDuplicates(["id", "h"])
    return out.select("row.*")
