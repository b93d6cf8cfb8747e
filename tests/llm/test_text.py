"""Chat formatting, decontamination, mixing and toxicity: brute force, round trips, edge cases."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from envlab.checks.compare import compare, type_mismatches
from envlab.llm import chat, decontam, mixing, queries, toxicity
from envlab.llm.oracle import SQL
from envlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, duck001, name):
    df = QUERIES[name](spark, SF)
    ok, msg = compare(df, duck001, SQL[name])
    assert ok, msg
    assert not type_mismatches(df, duck001, SQL[name])


NASTY = ["", None, "[INST]", "[\\INST]", "[\\\\\\/INST] x", "<", "</s>", "<\\/s>", "a\\", "[[/INST]", "[ROLE]r[/ROLE]", "é\n\\n", "[" * 50, "x" * 200_000]


def test_chat_round_trip(spark):
    rnd = random.Random(0)
    rows, want = [], {}
    for c in range(40):
        turns = []
        for t in range(rnd.randrange(1, 7) if c else 700):
            role = rnd.choice(["system", "user", "assistant", "tool", "judge", "[TURN]", None])
            turns.append((c, t, role, rnd.choice(NASTY[:-1]) if c else f"t{t}"))
        rows += turns
        want[c] = [(r or "", x or "") for _, _, r, x in turns]
    rows += [(None, None, "user", NASTY[-1]), (None, None, "user", "a"), (77, 1, "user", "b"), (77, 1, "user", "b")]
    want |= {None: [("user", "a"), ("user", NASTY[-1])], 77: [("user", "b")] * 2}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    out = chat.format_chats(df).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "segments", "formatted", "n_rows"
    ).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out} == want
    for r in out:
        assert r["loss"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["n_rows"] == len(want[r["conv_id"]])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_turn_order(spark):
    orders = {"ua": True, "sua": True, "uaua": True, "uata": True, "": None, "u": False, "au": False, "uu": False, "us": False, "suat": False, "ua" * 400: True, "ua" * 300 + "a": False}
    name = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rows = [(i, t, name[c], "x") for i, o in enumerate(orders) for t, c in enumerate(o)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: r["valid"] for r in out.collect()} == {i: v for i, v in enumerate(orders.values()) if v is not None}


def test_templates_that_cannot_be_read_back():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Mark("[A]", "[A]x[")}).check()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def decon_brute(docs, items, k=10):
    wins = []
    for item, t in items:
        w = WORDS.findall((t or "").translate(LOW))
        wins += [(str(item), w[i:i + k]) for i in range(max(1, len(w) - k + 1)) if w]
    out = []
    for d, t in docs:
        w = WORDS.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for item, x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i:i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [decontam.BLOCK_ROWS, 7])
def test_decontamination_matches_brute_force(spark, docs_of, block_rows):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "The", "É", "é", "q", "k9", "ΟΣ", "ſ", "a", "b"])
    items = [(i, rnd.choice([" ", "-", ", "]).join(word() for _ in range(rnd.choice([1, 2, 3, 5, 10, 14, 30])))) for i in range(12)]
    items += [(50, None), (51, " ,;"), (52, items[3][1]), (53, "never seen words here"), (3, items[0][1])]
    docs = []
    for i in range(40):
        w = [word() for _ in range(rnd.randrange(0, 60))]
        for _ in range(i % 3):
            w[rnd.randrange(len(w) + 1):0] = rnd.choice(items[:12])[1].split()
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (5, "the"), (5, "the"), (5, docs[6][1]), (200, "zz " * 30_000 + items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    out = decontam.contamination(docs_of(docs), bench, block_rows=block_rows).select(*names).collect()
    assert sorted((tuple(r) for r in out), key=str) == decon_brute(docs, items)


def test_decontamination_edges(spark, docs_of):
    docs = docs_of([(1, "one two three four"), (2, None), (None, "alpha beta"), (1, "clean text")])
    bench = spark.createDataFrame([(1, "two three"), (None, "beta")], "item_id long, text string")
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "clean text"), (2, None)]
    assert decontam.keep_clean(docs, bench.limit(0)).count() == 4
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_raking_meets_the_targets(spark):
    rnd = random.Random(1)
    rows = [
        (i, "t " * rnd.randrange(1, 60), rnd.choice(["en", "en", "de", None]), "big" if i % 3 else f"s{i % 9}", 0) for i in range(3000)
    ]
    rows = [(i, t + ("@" if i % 10 == 0 else ""), a, s, n) for i, t, a, s, n in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int")
    t = mixing.Targets({"en": 0.5, "de": 0.4, "xx": 0.3}, {"prose": 0.7, "contact": 0.25}, source_power=0.5, rest=0.1)
    out = mixing.mix(df, t, sweeps=25).toPandas()
    out["mass"] = out.tokens * out.weight / out.tokens.sum()
    langs = out.groupby("lang").mass.sum()
    assert abs(langs["en"] - 0.5) < 1e-6 and abs(langs["de"] - 0.4) < 1e-6 and abs(langs[""] - 0.1) < 1e-6  # xx has no tokens
    topics = out.groupby("topic").mass.sum()
    assert abs(topics["contact"] - 0.25 / 0.95) < 1e-6
    share = out.groupby("source").tokens.sum() / out.tokens.sum()
    want = share**0.5 / (share**0.5).sum()
    assert (out.groupby("source").mass.sum() - want).abs().max() < 1e-6
    assert abs(out.chance.max() - 1) < 1e-9 and abs(out.kept.mean() - out.chance.mean()) < 0.04
    kept = mixing.sample(df, t, sweeps=25)
    assert kept.columns == df.columns and kept.count() == out.kept.sum()


def test_rarest_cell_does_not_set_the_scale(spark):
    t = mixing.Targets({"en": 0.6, "de": 0.4}, {"prose": 1.0}, source_power=0.5, rest=0.0)
    rows = [(i, "t " * 20, "en" if i % 3 else "de", f"s{i % 4}") for i in range(2000)]
    schema = "doc_id long, text string, lang string, source string"
    share = []
    for more in ([], [(-1, "t", "en", "rare")]):
        df = spark.createDataFrame(rows + more, schema)
        out = mixing.mix(df, t, budget=1.0).toPandas()
        total = out.tokens.sum()
        # by the drawn copies: the budget and the targets are met
        got = out.tokens * out.copies
        assert abs(got.sum() / total - 1) < 0.05
        assert abs(got[out.lang == "de"].sum() / got.sum() - 0.4) < 0.05
        want = out.weight
        assert ((out.copies == want.astype(int)) | (out.copies == want.astype(int) + 1)).all()
        assert (out.chance - want.clip(upper=1)).abs().max() < 1e-9
        share.append(out.tokens[out.kept].sum() / total)
        rows_out = mixing.sample(df, t, budget=1.0)
        assert rows_out.columns == df.columns
        seen = rows_out.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
        assert seen.to_dict() == {d: c for d, c in zip(out.doc_id, out.copies) if c}
    assert out.copies[out.doc_id == -1].item() > 1
    assert abs(share[0] - share[1]) < 0.03


def test_one_more_document_moves_the_kept_share_little(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = spark.createDataFrame([(10**9, "word " * 30, "en", "a new source", 150)], "doc_id long, text string, lang string, source string, n_chars long")
    share = []
    for df in (docs, docs.select(*one.columns).union(one)):
        out = mixing.mix(df, queries.MIX, budget=mixing.BUDGET).toPandas()
        share.append(out.tokens[out.kept].sum() / out.tokens.sum())
    assert share[0] > 0.9 and abs(share[0] - share[1]) < 0.01


def test_mixing_twin_stops_where_the_operator_stops(spark, tmp_path):
    from envlab.checks.compare import duck

    rnd = random.Random(4)
    rows = []
    for i in range(600):  # nearly one language and topic per source: slow to meet the targets
        src = i % 6
        lang = ["en", "de", "fr"][src % 3] if rnd.random() < 0.85 else rnd.choice(["en", "de", "fr", "es", None])
        mark = rnd.choice([" @", " license", " | "]) if rnd.random() < (0.5 if src < 2 else 0.05) else " plain"
        rows.append((i, "t " * rnd.randrange(40) + mark, lang, f"s{src}" if i else None, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/parts")
    path = next(p for p in (tmp_path / "parts").iterdir() if p.name.endswith(".parquet"))
    path.rename(tmp_path / "documents.parquet")
    cells = mixing.described(df).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    assert mixing.rake(cells, queries.MIX, sweeps=mixing.SWEEPS).gap <= mixing.TOLERANCE
    most = mixing.MAX_SWEEPS
    try:
        mixing.MAX_SWEEPS = mixing.SWEEPS  # eight are not enough
        assert mixing.rake(cells, queries.MIX).gap > mixing.TOLERANCE
    finally:
        mixing.MAX_SWEEPS = most
    ok, msg = compare(queries.op2_mixing(spark, str(tmp_path)), duck(str(tmp_path)), SQL["op2_mixing"])
    assert ok, msg


def test_pipeline_mixes_to_its_budget(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, "t " * 20, "en", f"s{i % 4}", 40) for i in range(400)] + [(-1, "t", "en", "rare", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert abs(out.where("doc_id >= 0").count() / 400 - mixing.BUDGET) < 0.1


def test_raking_sweeps_until_the_targets_are_met(spark, monkeypatch, caplog):
    t = mixing.Targets({"en": 0.6, "de": 0.4}, {"prose": 1.0}, source_power=1.0, rest=0.0)
    schema = "source string, lang string, topic string, tokens long"
    cells = [("a", "en", "prose", 9500), ("a", "de", "prose", 500), ("b", "en", "prose", 500), ("b", "de", "prose", 9500)]
    r = mixing.rake(spark.createDataFrame(cells, schema), t)
    factor = {x["source"]: x["sf"] for x in r.sources.collect()}
    mass = {(a, b): n * factor[a] * r.language[b] * r.topic["prose"] for a, b, _, n in cells}
    assert abs(mass["a", "en"] + mass["b", "en"] - 0.6) <= mixing.TOLERANCE
    assert r.gap <= mixing.TOLERANCE and not caplog.records
    # one language per source: sources want half each, languages do not
    monkeypatch.setattr(mixing, "MAX_SWEEPS", 12)
    docs = spark.createDataFrame([(0, "t t", "en", "a"), (1, "t t", "de", "b")], "doc_id long, text string, lang string, source string")
    assert all(abs(x["gap"] - 0.1) < 1e-6 for x in mixing.mix(docs, t).collect())
    assert "off their targets after 12 sweeps" in caplog.text


def test_mixing_edges(spark, docs_of):
    t = mixing.Targets({"en": 1.0}, {"prose": 1.0})
    assert mixing.mix(docs_of([(1, None), (2, ""), (None, None)]), t).toPandas().kept.sum() == 0
    assert mixing.mix(docs_of([(1, "a")]).limit(0), t).count() == 0
    assert mixing.mix(docs_of([(None, "a b"), (3, "c d"), (3, "c d")]), t).toPandas().kept.all()


def chain_brute(scores, trans):
    import itertools

    import numpy as np

    n = len(scores)
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(s for s, v in zip(scores, y) if v) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += p
        on += p * np.array(y)
    return on / total


def test_marginals_match_enumeration():
    import numpy as np

    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    seqs = [rng.normal(size=n) * 3 for n in (1, 2, 5, 9)]
    got, pairs = toxicity.chain_marginals(seqs, trans)
    for s, p in zip(seqs, got):
        assert np.allclose(p, chain_brute(s, trans))
    assert abs(pairs.sum() - sum(len(s) - 1 for s in seqs)) < 1e-9
    both = [p for p in got]
    assert abs(pairs[:, 1].sum() - sum(p[1:].sum() for p in both)) < 1e-9
    model = toxicity.Model(np.zeros(8), 0.0, trans, np.zeros(3))
    many = [rng.normal(size=n) for n in (0, 700, 3, 200, 5)]
    for s, p in zip(many, model.marginals(many)):
        assert len(p) == len(s) and (not len(s) or np.allclose(p, toxicity.chain_marginals([s], trans)[0][0]))


def test_toxic_spans_and_filter(spark, docs_of):
    rnd = random.Random(3)
    bad = ["vile", "grubworm", "grubhead", "grubling"]
    docs, labels = [], []
    for i in range(400):
        w = [f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(30)]
        y = i % 4 == 0
        for _ in range(3 if y else 0):
            w[rnd.randrange(30)] = rnd.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, 0, int(y)))
    docs += [(1000, None), (1001, ""), (None, "İ you VILE thing, Grubbers"), (1002, "plain " * 50_000), (1002, "plain"), (1003, "12 34")]
    labels += [(5, 0, None), (None, 0, 1), (0, 0, 0)]
    df, lab = docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    out = toxicity.score_documents(df, model).collect()
    assert len(out) == len(docs)
    by = {(r["doc_id"], r["score"] >= 0.7) for r in out}
    held = {i for i, _ in docs[:400] if __import__("zlib").crc32(str(i).encode()) % 3 == 1}
    wrong = [i for i in held if (i, i % 4 == 0) not in by]
    assert len(held) > 100 and len(wrong) <= 2
    assert {(None, True), (1000, False), (1001, False), (1002, False), (1003, False)} <= by
    spans = next(r["spans"] for r in out if r["doc_id"] is None)
    assert any("İ you VILE thing, Grubbers"[s["start"]:s["end"]] == "VILE" for s in spans)
    kept = toxicity.keep_clean(df, model, 0.7)
    assert kept.columns == df.columns and kept.count() == sum(r["score"] < 0.7 for r in out)
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    flags = spark.createDataFrame([(4,), (None,)], "doc_id long").select(toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert flags[1]["h"] is False
    empty = toxicity.fit(df, lab.limit(0))
    assert all(r["score"] < 0.01 for r in toxicity.score_documents(df.limit(5), empty).collect())


def test_op7_scores_against_plain_python(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        scores = model.emissions(toxicity.tokens(r["text"]))
        p = toxicity.chain_marginals([scores], model.trans)[0][0] if len(scores) else scores
        assert abs(g["score"] - model.score(p)) < 1e-5 and g["predicted"] == int(g["score"] >= 0.7)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_training_sample_is_bounded_in_bytes(spark, docs_of, monkeypatch):
    docs = docs_of([(i, ("vile " if i % 2 else "fine ") * 50) for i in range(60)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(texts))
    toxicity.fit(docs, labels)
    toxicity.fit(docs, labels, sample_bytes=1000)
    toxicity.fit(docs, labels, sample_bytes=1)
    assert len(seen[0]) > 30 and [len(x) for x in seen[1:]] == [4, 1] and seen[1] == seen[0][:4]
