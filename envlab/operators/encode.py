"""Word-level encoding and batching of environment examples.

The vocabulary is built from the training texts; the reference's pretrained sub-word tokenizer
is not rebuilt (see README). Whole texts and all words are encoded; a maximum length or vocabulary
size is used only where the caller asks for one.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envlab.functions.draws import draw
from envlab.functions.text import PREFIX_GROUP0, PREFIX_GROUP1
from envlab.operators.ranking import draw_bucket, rank_within
from envlab.session import join_small, materialize
from envlab.sources.corpus import encoder_text_col

# Special tokens and their fixed ids; the two spurious prefixes are atomic tokens.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
SPECIALS = (PAD, UNK, CLS, SEP, PREFIX_GROUP0, PREFIX_GROUP1)
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
# words that every task holds, the most frequent first, and the longest of them: some 10 MB at most
DICTIONARY_WORDS, DICTIONARY_CHARS = 100_000, 64
# bytes of text that a task splits at once, but for one longer row: some tens of MB of arrays
SLICE_BYTES = 4 << 20
# a block of rows ends when it has so many ids, or so many distinct words (or characters of them) outside the dictionary
BLOCK_IDS, BLOCK_WORDS, BLOCK_CHARS = 4 << 20, 300_000, 8 << 20


def max_seq_length(requested: int | None, model_max: int | None = None) -> int | None:
    """the smaller of the requested length and the model's maximum; a model's maximum alone is
    capped at 1024. None (no truncation) when neither is given."""
    if requested is None:
        return None if model_max is None else min(model_max, 1024)
    return int(requested) if model_max is None else min(int(requested), model_max)


def _text_columns(text_col: str) -> list[F.Column]:
    """What :func:`_words` takes: the text in Spark's lower case where splitting and folding it takes more than
    the rules for ASCII, else NULL; and the text."""
    text = F.make_valid_utf8(F.col(text_col).cast("string"))
    other = (F.octet_length(text) != F.char_length(text)) | text.rlike(r"[\x1C-\x1F]")
    return [F.when(other, F.lower(text)).alias("_low"), text.alias("_text")]


def _words(batch: pa.RecordBatch, most: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of the last columns' texts, split on whitespace and lower-cased (uncased model) except the atomic
    special tokens, and how many each row has: the first ``most`` if given."""
    low, text = batch.columns[-2:]
    other = low.is_valid()
    if other.true_count:
        pairs = zip(text.filter(other).to_pylist(), low.filter(other).to_pylist())
        plain = [" ".join(x if x in SPECIALS else y for x, y in zip(t.split(), y.split(), strict=True)) for t, y in pairs]
        text = pc.replace_with_mask(text, other, pa.array(plain, pa.string()))
    lists = pc.ascii_split_whitespace(text)
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    kept = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if most is not None or not kept.all():
        row = np.repeat(np.arange(len(sizes)), sizes)
        if most is not None:
            before = np.cumsum(kept) - kept
            start = np.concatenate([[0], np.cumsum(np.bincount(row, kept, len(sizes)))]).astype(np.int64)
            kept = kept & (before - start[row] < most)
        flat, sizes = flat.filter(pa.array(kept)), np.bincount(row[kept], minlength=len(sizes))
    return pc.if_else(pc.is_in(flat, pa.array(SPECIALS)), flat, pc.ascii_lower(flat)), sizes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in _slices(whole, SLICE_BYTES)):
        yield pa.RecordBatch.from_arrays(_words(b)[0].value_counts().flatten(), names=["token", "n"])


def build_vocab(texts: DataFrame, size: int | None = None, text_col: str = "text") -> DataFrame:
    """F16: ``(token, id, n)``: the special tokens with fixed ids, then all other tokens, the most
    frequent first (ties by token), ids in that order; ``size`` keeps only the first so many.
    Tasks count the words of some texts at once, and partial + final aggregates add up; ids are exact distributed ranks over buckets of a count and a
    token's first six bytes, whose offsets are summed level by level."""
    t = texts.select(*_text_columns(text_col)).mapInArrow(_count, "token string, n long").where(~F.col("token").isin(*SPECIALS))
    counts = materialize(t.groupBy("token").agg(F.sum("n").alias("n")), "vocab-counts")
    start = F.conv(F.rpad(F.hex(F.substring(F.encode("token", "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("long")
    x = counts.withColumn("_neg", -F.col("n")).withColumn("_start", start)
    at = [F.struct("_neg", F.shiftright("_start", bits).alias("_at")) for bits in (0, 16, 32)]
    ranked = rank_within(x, [], ["_neg", "token"], at[0], name="_r", coarser=[*at[1:], F.col("_neg"), F.shiftright("_neg", 12)])
    if size is not None:
        ranked = ranked.where(F.col("_r") < int(size))
    words = ranked.select("token", (F.col("_r") + len(SPECIALS)).cast("int").alias("id"), "n")
    spark = texts.sparkSession
    sp = spark.createDataFrame([(s, i, 0) for i, s in enumerate(SPECIALS)], "token string, id int, n long")
    return sp.unionByName(words)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows whose last column, lists or texts, holds at most ``most`` values or bytes
    in all, or one row."""
    last = batch.column(batch.num_columns - 1)
    sizes = pc.list_value_length(last) if pa.types.is_list(last.type) else pc.binary_length(last)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        to = max(int(np.searchsorted(ends, before + most, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at, before = to, ends[to - 1]


def _coder(words: Broadcast, rare: bool, most: int | None):
    """Tasks' side of :func:`encode`: the last columns, of :func:`_text_columns`, become ``input_ids``. A word outside the
    dictionary is [UNK]; or with ``rare`` minus its place (from 1) among the distinct such words of ``_block``,
    a run of rows. The last row of a slice has the block's new ones in ``_rare``; the first is at ``_from``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = words.value
        block, places, n_ids, chars = TaskContext.get().partitionId() << 32, {}, 0, 0
        for b in (part for whole in batches for part in _slices(whole, SLICE_BYTES)):
            flat, sizes = _words(b, most)
            at = pc.index_in(flat, value_set=held)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            found = np.where(known, ids[at.fill_null(0).to_numpy(zero_copy_only=False)], UNK_ID).astype(np.int32)
            told = len(places)
            if rare:
                missing = pc.dictionary_encode(flat.filter(pa.array(~known)))
                place = np.array([places.setdefault(w, len(places)) for w in missing.dictionary.to_pylist()], dtype=np.int32)
                found[~known] = -place[missing.indices.to_numpy(zero_copy_only=False)] - 1
            ends = np.cumsum(sizes + 2)
            out = np.empty(int(ends[-1]), dtype=np.int32)
            inner = np.ones(len(out), dtype=bool)
            starts = ends - sizes - 2
            out[starts], out[ends - 1] = CLS_ID, SEP_ID
            inner[starts] = inner[ends - 1] = False
            out[inner] = found
            coded = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))
            columns, names = [*b.columns[:-2], coded], [*b.schema.names[:-2], "input_ids"]
            if rare:
                n, new = b.num_rows, list(islice(places, told, None))
                columns += [pa.array(np.full(n, block)), pa.array([told] * n, pa.int32()), pa.array([None] * (n - 1) + [new], pa.list_(pa.string()))]
                names += ["_block", "_from", "_rare"]
                n_ids, chars = n_ids + len(out), chars + sum(map(len, new))
                if n_ids >= BLOCK_IDS or len(places) >= BLOCK_WORDS or chars >= BLOCK_CHARS:
                    block, places, n_ids, chars = block + 1, {}, 0, 0
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _fill(rows: pa.Table, found: pa.Table) -> pa.Table:
    """A block's rows with the ids ``found`` (``_at``, ``id``) of its words; words without one are [UNK]."""
    lists = [c.column("input_ids") for c in rows.to_batches()]
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists] or [np.zeros(0, np.int32)])
    sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists] or [np.zeros(0, np.int32)])
    at, ids = found["_at"].to_numpy(), found["id"].to_numpy()
    known = np.full(max(-int(flat.min(initial=0)), int(at.max(initial=-1)) + 1), UNK_ID, dtype=np.int32)
    known[at] = ids
    negative = flat < 0
    flat[negative] = known[-flat[negative] - 1]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    filled = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return rows.set_column(rows.column_names.index("input_ids"), "input_ids", filled).drop_columns(["_block"])


def encode(df: DataFrame, vocab: DataFrame, max_len: int | None = None, key: Sequence[str] = ("env", "example_id"),
           text_col: str | None = "text") -> DataFrame:
    """``input_ids = [CLS] + ids(tokens) + [SEP]`` (unknown -> [UNK]) and an attention mask of
    ones; other columns of ``df`` are kept, the text is dropped (``text_col``; None: ``content`` if there is
    such a column, else the first). ``key`` names the columns that come first; rows may share them.
    ``max_len`` truncates if given.

    Words are coded inside the row: every task holds the ``DICTIONARY_WORDS`` most frequent ones. A
    vocabulary of no more needs no shuffle. Of a larger one, the distinct words outside the dictionary of a
    block of rows leave it, find their ids by a join on the word and meet the block's rows again, whose
    codes point to them; texts and tokens are never shuffled.
    """
    text_col = encoder_text_col(df) if text_col is None else text_col
    key = [k for k in key if k in df.columns]
    keep = [c for c in df.columns if c not in (text_col, *key)]
    if max_len is not None and int(max_len) < len((CLS, SEP)):
        raise ValueError("max_len has room for [CLS] and [SEP] at least")
    near = (F.col("id") < DICTIONARY_WORDS + len(SPECIALS)) & (F.char_length("token") <= DICTIONARY_CHARS)
    held = vocab.where(near).select("token", "id").toArrow().combine_chunks()
    dictionary = held["token"].combine_chunks() if held.num_rows else pa.array([], pa.string())
    words = df.sparkSession.sparkContext.broadcast((dictionary.cast(pa.string()), np.append(held["id"].to_numpy(), 0).astype(np.int32)))
    rest = vocab.where(~near).select("token", "id")
    x = df.select(*key, *keep, *_text_columns(text_col))
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name not in ("_low", "_text")), "input_ids array<int>"]
    rare = not rest.isEmpty()
    run = _coder(words, rare, None if max_len is None else int(max_len) - 2)
    if not rare:
        out = x.mapInArrow(run, ", ".join(fields))
    else:
        coded = materialize(x.mapInArrow(run, ", ".join([*fields, "_block long", "_from int", "_rare array<string>"])), "encode-coded")
        asked = coded.where(F.size("_rare") > 0).select("_block", "_from", F.posexplode("_rare").alias("_pos", "token"))
        found = asked.join(rest, "token").select(F.col("_block").alias("_of"), (F.col("_from") + F.col("_pos")).alias("_at"), "id")
        rows = coded.drop("_from", "_rare")
        out = rows.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(_fill, ", ".join(fields))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def batch_plan(df: DataFrame, batch_size: int, seed: int, drop_last: bool = False, env: str = "env",
               key: str = "example_id") -> DataFrame:
    """W8 on the keys alone: (env, key, rank, batch_id), and with ``input_ids`` in ``df`` the ``longest``
    sequence of the batch. Per environment a seeded permutation, ``batch_id = floor(rank / batch_size)``;
    ``drop_last`` drops the final short batch. No ids or masks go through its shuffles, only their sizes."""
    sized = "input_ids" in df.columns
    size = [F.size("input_ids").alias("_size")] if sized else []
    x = df.select(env, key, *size).withColumn("_d", draw(seed, "batch", env, key))
    r = rank_within(x, [env], ["_d", key], draw_bucket("_d"), name="rank", total="_n").drop("_d")
    r = r.withColumn("batch_id", F.floor(F.col("rank") / int(batch_size)).cast("int"))
    if drop_last:
        r = r.where(F.col("rank") < F.floor(F.col("_n") / int(batch_size)) * int(batch_size))
    r = r.drop("_n")
    if sized:
        # a window holds one batch
        r = r.withColumn("longest", F.max("_size").over(Window.partitionBy(env, "batch_id"))).drop("_size")
    return r


def _planned(df: DataFrame, plan: DataFrame, env: str, key: str) -> DataFrame:
    rows = df.drop("attention_mask")
    on = [F.col(env).eqNullSafe(F.col("_env")), F.col(key).eqNullSafe(F.col("_key"))]
    return rows.join(plan.withColumnsRenamed({env: "_env", key: "_key"}), on).drop("_env", "_key")


def assign_batches(df: DataFrame, batch_size: int, seed: int, drop_last: bool = False, env: str = "env",
                   key: str = "example_id") -> DataFrame:
    """``df`` with ``rank`` and ``batch_id`` of :func:`batch_plan`. (env, key) tells rows apart; the
    attention mask, all ones, is left behind and made anew."""
    out = _planned(df, batch_plan(df.select(env, key), batch_size, seed, drop_last, env, key), env, key)
    if "attention_mask" in df.columns:
        out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return out.select(*df.columns, "rank", "batch_id")


def padded_batches(df: DataFrame, batch_size: int, seed: int, drop_last: bool = False, fixed_length: int | None = None,
                   env: str = "env", key: str = "example_id") -> DataFrame:
    """W8 + F17 of encoded rows in one join: batches are drawn and their longest sequence found on keys and
    sizes; the ids meet the plan once, are padded with [PAD], and the mask is made after that."""
    plan = batch_plan(df, batch_size, seed, drop_last, env, key)
    return _padded(_planned(df, plan, env, key), F.col("longest"), fixed_length).select(*df.columns, "rank", "batch_id")


def _padded(rows: DataFrame, longest: F.Column, fixed_length: int | None) -> DataFrame:
    if fixed_length is not None:
        n = int(fixed_length)
        if n < 2:
            raise ValueError("fixed_length has room for [CLS] and [SEP] at least")
        longest = F.lit(n)
        cut = F.concat(F.slice("input_ids", 1, n - 1), F.array(F.lit(SEP_ID)))
        rows = rows.withColumn("input_ids", F.when(F.size("input_ids") > n, cut).otherwise(F.col("input_ids")))
    size = F.size("input_ids")
    rows = rows.withColumn("_size", size).withColumn("_pad", F.greatest(longest - size, F.lit(0)))
    return rows.withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(PAD_ID), F.col("_pad")))).withColumn(
        "attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("_size")), F.array_repeat(F.lit(0), F.col("_pad")))
    ).drop("_size", "_pad")


def pad_batches(batched: DataFrame, fixed_length: int | None = None, env: str = "env") -> DataFrame:
    """F17 of rows that have a ``batch_id``: pad ``input_ids`` (with [PAD]) and ``attention_mask`` (with 0) to
    the longest sequence of the batch, or to ``fixed_length``, to which longer rows are truncated as the
    encoder does (the last id is [SEP]). The window holds one batch (``batch_size`` rows)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(env, "batch_id")) if fixed_length is None else F.lit(0)
    rows = batched.withColumn("_longest", longest)
    return _padded(rows, F.col("_longest"), fixed_length).select(*batched.columns)


def epoch_plan(train: DataFrame, batch_size: int, grad_accum: int = 1, nb_steps: int | None = None,
               num_train_epochs: int = 1, env: str = "env") -> DataFrame:
    """A6 + A7: smallest environment, ``steps_per_epoch = floor(min / (accum * batch))``, epochs
    and total optimisation steps; and the number of distinct labels over training environments.
    One pass to an (env, label) count table, then arithmetic on that small table."""
    per_env = train.groupBy(env, "labels").agg(F.count(F.lit(1)).alias("c")).groupBy(env).agg(
        F.sum("c").alias("n"), F.collect_set("labels").alias("ls")
    )
    one = per_env.agg(
        F.min("n").alias("min_env_size"),
        F.count(F.lit(1)).alias("n_envs"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ls")))).cast("long").alias("num_labels"),
    )
    spe = F.floor(F.col("min_env_size") / F.lit(int(grad_accum) * int(batch_size)))
    if nb_steps is not None:
        epochs = F.when(spe > 0, F.greatest(F.lit(1), F.floor(F.lit(int(nb_steps)) / spe))).otherwise(F.lit(1))
        steps = F.lit(int(nb_steps))
    else:
        epochs, steps = F.lit(int(num_train_epochs)), spe * int(num_train_epochs)
    return one.select("min_env_size", "n_envs", "num_labels", spe.cast("long").alias("steps_per_epoch"),
                      epochs.cast("long").alias("num_epochs"), steps.cast("long").alias("max_steps"))


def step_schedule(spark, max_steps: int, batches: DataFrame, env: str = "env") -> DataFrame:
    """Which batch each optimisation step reads (invariant training takes one environment per
    step, environments in name order): step s -> environment ``s mod E``, and that
    environment's batch ``(s div E) mod n_batches`` (the data loader is cycled, replaying its
    first pass). Steps come from a distributed ``range``; the environment table has E rows."""
    nb = batches.groupBy(env).agg((F.max("batch_id") + 1).alias("n_batches"))
    envs = nb.select(env, "n_batches", (F.row_number().over(Window.orderBy(env)) - 1).alias("env_idx")).persist()
    n_envs = envs.count()
    steps = spark.range(int(max_steps)).select(F.col("id").alias("step"), F.pmod(F.col("id"), F.lit(n_envs)).alias("env_idx"))
    j = join_small(steps, envs, "env_idx")
    return j.select("step", env, F.pmod(F.floor(F.col("step") / n_envs), F.col("n_batches")).cast("int").alias("batch_id"))
