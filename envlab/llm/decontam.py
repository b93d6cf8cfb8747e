"""Benchmark decontamination: a prefix-filtered set join with exact containment.

A window of an item is contained in a document only if all its shingles are, in particular the
window's rarest one: ordered by rarity in the corpus, the necessary prefix for full containment is
one shingle. So

1. the corpus counts of the benchmark's shingles give the rarity order,
2. documents are joined on the rarest shingle of each window only,
3. the shingle's offset bounds where the window would start; it must lie inside the document,
4. the words at that place are compared with the window's words.

The benchmark side is held by the executors in blocks of at most ``BLOCK_ROWS`` rows (its size is
counted first); a larger benchmark takes one pass over the documents per block. Only DataFrame
functions are used, documents are never shuffled, and words leave a row only as matches.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from envlab.llm.common import column, store, words_of

WINDOW = 10
SHINGLE = 4
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
# a row holds one window's words (some hundred bytes), so a block is some 20 MB
BLOCK_ROWS = 100_000


def _words(text: Column) -> Column:
    return words_of(text, SEPARATORS)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``win array<string>, items array<string>`` (sorted ids)."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    return (
        words.where(n > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
        .groupBy("win").agg(F.sort_array(F.collect_set(F.coalesce("item", F.lit("null")))).alias("items"))
    )


def _shingles(df: DataFrame, words: str, length: int, keep: list[str]) -> DataFrame:
    """(…keep, at, h): the hash of the ``length`` words at every place ``at`` (from 0)."""
    return df.where(F.size(words) >= length).select(
        *keep, words, F.explode(F.sequence(F.lit(0), F.size(words) - length)).alias("at")
    ).select(*keep, "at", F.xxhash64(F.slice(words, F.col("at") + 1, length)).alias("h"))


def _blocks(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """``df`` cut by a hash of ``key`` into blocks of about ``rows`` rows, each to be broadcast."""
    n = -(-max(df.count(), 1) // rows)
    return [df.where(F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n)) == i) if n > 1 else df for i in range(n)]


def _lengths(wins: DataFrame, shingle: int) -> list[int]:
    return sorted(r[0] for r in wins.select(F.least(F.size("win"), F.lit(shingle))).distinct().collect())


def rarest(docs_words: DataFrame, wins: DataFrame, lengths: list[int], shingle: int, block_rows: int) -> DataFrame:
    """Windows with their rarest shingle: ``h, len, offset, win, items``."""
    grams = store(
        reduce(
            DataFrame.union,
            [
                _shingles(wins.where(F.least(F.size("win"), F.lit(shingle)) == n), "win", n, ["win", "items"])
                .select("win", "items", F.col("at").alias("offset"), F.lit(n).alias("len"), "h")
                for n in lengths
            ],
        ),
        "decon-grams",
    )
    known = store(grams.select("len", "h").distinct(), "decon-known")
    counts = [
        _shingles(docs_words, "w", n, []).join(F.broadcast(block), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(n).alias("len"), "h", "n")
        for n in lengths
        for block in _blocks(known.where(F.col("len") == n).select("h"), "h", block_rows)
    ]
    ranked = grams.join(reduce(DataFrame.union, counts), ["len", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # a window has at most `window` shingles
    order = Window.partitionBy("win").orderBy("n", "h", "offset")
    return store(ranked.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "n"), "decon-rarest")


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per document: ``doc_id, n_words long, n_hit long, n_items long, items_sha256 string,
    contaminated boolean, items array<string>, spans array<struct<at, len>>`` (matched windows, by
    word place), ``th`` (xxhash64 of the text).

    A NULL or wordless text has no words and no hits, like a benchmark item without words; an item
    shorter than ``window`` words is one window; repeated items share their windows; a NULL item_id
    is named ``null``; repeated documents keep their rows (told apart by id and text); an empty
    benchmark contaminates nothing; other columns are ignored."""
    wins = store(windows(benchmark, window), "decon-windows")
    lengths = _lengths(wins, shingle)
    docs = documents.select("doc_id", F.xxhash64("text").alias("th"), _words(F.col("text")).alias("w"))
    n_words = F.size("w")
    hit = "struct<at:int,len:int,items:array<string>>"
    passes = []
    if lengths:
        blocks = _blocks(rarest(docs, wins, lengths, shingle, block_rows), "h", block_rows)
        for b, block in enumerate(blocks):
            block = F.broadcast(block)
            # every document gives one row of its own (at = -1) and one per place and shingle length;
            # a place's row lives on only if a window is found there
            places = F.sequence(F.lit(-1), n_words - 1) if b == 0 else F.when(n_words > 0, F.sequence(F.lit(0), n_words - 1))
            rows = docs.select("doc_id", "th", "w", F.explode(places).alias("at")).select(
                "doc_id", "th", "w", "at",
                F.explode(F.when(F.col("at") < 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(n) for n in lengths]))).alias("len"),
            ).where("at < 0 OR at + len <= size(w)").withColumn(
                "h", F.when(F.col("at") >= 0, F.xxhash64(F.expr("slice(w, at + 1, len)")))
            )
            found = rows.join(
                block.select(F.col("h").alias("bh"), F.col("len").alias("bl"), "offset", "win", "items"),
                (F.col("h") == F.col("bh")) & (F.col("len") == F.col("bl"))
                & (F.col("at") >= F.col("offset"))
                & (F.col("at") - F.col("offset") + F.size("win") <= F.size("w"))
                & (F.expr("slice(w, greatest(at - offset, 0) + 1, size(win))") == F.col("win")),
                "left",
            ).where("at < 0 OR win IS NOT NULL")
            passes.append(found.select(
                "doc_id", "th", F.when(F.col("at") < 0, F.size("w")).alias("n"),
                F.when(F.col("at") >= 0, F.struct(
                    (F.col("at") - F.col("offset")).alias("at"), F.size("win").alias("len"), "items"
                )).cast(hit).alias("hit"),
            ))
    else:
        passes.append(docs.select("doc_id", "th", n_words.alias("n"), F.lit(None).cast(hit).alias("hit")))
    found = reduce(DataFrame.union, passes)
    per_doc = found.groupBy("doc_id", "th").agg(
        F.count("n").alias("copies"), F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.struct("hit.at", "hit.len"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("hit.items")))).alias("items"),
    ).withColumn("spans", F.filter("spans", lambda s: s["at"].isNotNull()))
    # spans come by start; each adds the words past the farthest end so far
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["at"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(s["at"] + s["len"] - F.greatest(a["end"], s["at"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"].cast("long"),
    )
    return per_doc.select(
        "doc_id", "th", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy").withColumn("contaminated", F.col("n_hit") > 0)


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that hold no benchmark window."""
    found = contamination(documents, benchmark, window, shingle).where("contaminated")
    # stored, so that the planner knows its size: a small list of rejects is broadcast, a large one is not
    gone = store(found.select(F.col("doc_id").alias("id"), "th").distinct(), "decon-gone")
    rows = documents.select(F.struct(*[column(c) for c in documents.columns]).alias("row"))
    kept = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("th")), "left_anti")
    return kept.select("row.*")
