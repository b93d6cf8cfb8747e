"""Cases of the round's findings: words in tasks' slices, blocks of rows, ids for the words outside the dictionary."""
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from envlab.functions.text import PREFIX_GROUP0, tokens
from envlab.llm import tokens as TK
from envlab.operators import encode as EN

TEXTS = ["The cat\tthe CAT", None, "", "  \x0b lead tail \n", "a\x1cB\x1d\x1eC\x1f", f"{PREFIX_GROUP0} <aaa> [SEP] [sep] [Sep]", "ΟΔΟΣ ΣΑΣ Σ ΑΣ'Α İx K",
         "x\xa0Y\x85z​W", "é É [CLS]　[cls] Q", "one"]


def test_words_of_slices_are_those_of_the_expressions(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    old = F.transform(tokens("text"), lambda t: F.when(t.isin(*EN.SPECIALS), t).otherwise(F.lower(t)))
    want = [r.w or [] for r in df.orderBy("i").select(old.alias("w")).collect()]
    table = df.orderBy("i").select("i", *EN._text_columns("text")).toArrow().combine_chunks().to_batches()[0]
    for batch, rows in ((table, want), (table.slice(3), want[3:])):
        for most in (None, 0, 2):
            words, sizes = EN._words(batch, most)
            assert words.to_pylist() == [w for r in rows for w in r[:most]] and sizes.tolist() == [len(r[:most]) for r in rows]


def test_vocabulary_counts_over_slices(spark, monkeypatch):
    monkeypatch.setattr(EN, "SLICE_BYTES", 8)
    df = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string").coalesce(1)
    got = {r["token"]: r["n"] for r in EN.build_vocab(df).collect()}
    want = dict.fromkeys(EN.SPECIALS, 0)
    for r in df.select(tokens("text").alias("w")).collect():
        for w in r.w or []:
            if w not in EN.SPECIALS:
                want[w.lower()] = want.get(w.lower(), 0) + 1
    assert got == want


def test_rows_of_one_key_keep_their_own_words(spark, monkeypatch):
    monkeypatch.setattr(EN, "DICTIONARY_WORDS", 1)
    rows = [("e", 1, "a a a b c"), ("e", 1, "c d Unseen b"), (None, None, "d a"), ("e", 2, None)]
    df = spark.createDataFrame(rows, "env string, example_id long, text string").coalesce(1)
    vocab = EN.build_vocab(df.where(~F.col("text").contains("Unseen") | F.col("text").isNull()).union(
        spark.createDataFrame([("e", 1, "c d b")], df.schema)))
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    want = sorted([EN.CLS_ID, *[ids.get(w.lower(), EN.UNK_ID) for w in (t or "").split()], EN.SEP_ID] for *_, t in rows)
    for most in (1, 1 << 20):
        monkeypatch.setattr(EN, "BLOCK_WORDS", most)
        out = EN.encode(df, vocab).collect()
        assert sorted(r["input_ids"] for r in out) == want
        assert all(r["attention_mask"] == [1] * len(r["input_ids"]) for r in out)


def test_a_word_leaves_a_block_once(monkeypatch):
    monkeypatch.setattr(EN, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(EN, "SLICE_BYTES", 12)
    monkeypatch.setattr(EN, "BLOCK_WORDS", 4)
    texts = ["in x y", "y x in", "x z", "Z w", "x y v x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.nulls(5, pa.string()), pa.array(texts)], names=["i", "_low", "_text"])
    held = SimpleNamespace(value=(pa.array(["in"]), np.array([7, 0], dtype=np.int32)))
    out = [r for b in EN._coder(held, True, None)(iter([batch])) for r in b.to_pylist()]
    assert [(r["_block"] - (3 << 32), r["_from"], r["_rare"]) for r in out] == [
        (0, 0, None), (0, 0, ["x", "y"]), (0, 2, None), (0, 2, ["z", "w"]), (1, 0, ["x", "y", "v"])]
    assert [r["input_ids"] for r in out] == [[2, 7, -1, -2, 3], [2, -2, -1, 7, 3], [2, -1, -3, 3], [2, -3, -4, 3], [2, -1, -2, -3, -1, 3]]


def test_words_in_use_stay_in_a_full_memo_and_lend_their_pieces(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(TK, "MEMO_WORDS", 6)
    monkeypatch.setattr(TK, "MEMO_PIECES", 6)
    enc = TK.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    merged, merge = [], enc.merge
    monkeypatch.setattr(enc, "merge", lambda w: merged.append(w) or merge(w))
    for text in ("x the cat sat, on", "x the hat", "x the mat the, 'll a1 \u0436\u0436.", "x the dog", "x the fox the."):
        assert enc.encode(text) == enc._whole(text)
    assert merged.count("\u0120the") == 1 and merged.count("\u0120sat") == 1
