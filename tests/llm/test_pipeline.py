"""The pipeline: each stage against a brute-force version on its own input."""
import hashlib
import json
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from envlab.llm import mixing, simhash, toxicity
from envlab.llm.queries import MIX, TOXIC

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "__h", "a.b"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic ones, copies, near copies, benchmark passages, NULLs, empty texts, repeated
    rows and extra columns; labels and a benchmark."""
    rnd = random.Random(7)
    at = str(tmp_path_factory.mktemp("pipeline"))
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    bad = ["vilegrub", "grubhead", "nastyworm"]
    bench = [" ".join(word() for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(420):
        w = [word() for _ in range(rnd.randrange(30, 90))]
        if i % 4 == 0:
            for _ in range(5):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        elif i % 7 == 0:
            w[5:5] = bench[i % 6].split()
        elif i % 5 == 0 and i > 100:
            w = rows[i - 99][1].split()
            if i % 10 == 0:
                w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w), rnd.choice(["en", "en", "de", "fr", None]), f"s{i % 3}"))
    rows += [(1000, None, "en", "s0"), (1001, "", None, None), (1002, "  ", "de", "s1"), (1003, "long " * 20_000, "es", "s2"), (None, "no id here at all", "en", "s0")]
    rows += [rows[1], rows[1]]
    rows = [(i, t, a, s, len(t or ""), 1, "x") for i, t, a, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __h int, `a.b` string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(420)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in COLUMNS]).collect()), key=repr)


def toxic_by_hand(rows, model):
    keep = []
    for r in rows:
        p = model.marginals([model.emissions(toxicity.tokens(r[1]))])[0]
        if model.score(p) < TOXIC:
            keep.append(r)
    return keep


def near_by_hand(rows):
    prints = [simhash.fingerprint(r[1]) for r in rows]
    left = set(range(len(rows)))
    keep = []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 2]
            left -= set(near)
            todo += near
        keep.append(min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)))
    return keep


def clean_by_hand(rows, bench):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for t in bench:
        w = split(t)
        windows |= {tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return [r for r in rows if not hit(split(r[1]))]


def mixed_by_hand(rows):
    """Raking on plain dicts, then whole copies and a seeded draw."""
    def topic(t):
        return next((n for n, m in mixing.TOPICS if m in (t or "")), mixing.OTHER_TOPIC)

    cells = {}
    keys = [(r[3] or "", r[2] or "", topic(r[1]), len(re.findall(r"[^ \t\r\n]+", r[1] or ""))) for r in rows]
    lang, top = [*MIX.language, "~"], [*MIX.topic, "~"]
    at = lambda v, named: v if v in named else "~"
    for s, a, t, n in keys:
        if n:
            k = (s, at(a, lang), at(t, top))
            cells[k] = cells.get(k, 0) + n
    total = sum(cells.values())
    by = {s: sum(n for k, n in cells.items() if k[0] == s) for s in {k[0] for k in cells}}
    want_s = {s: (n / total) ** MIX.source_power for s, n in by.items()}
    want_s = {s: w / sum(want_s.values()) for s, w in want_s.items()}
    want = [want_s, *({v: x / (sum(named.values()) + MIX.rest) for v, x in [*named.items(), ("~", MIX.rest)]} for named in (MIX.language, MIX.topic))]
    f = [dict.fromkeys(want[0], 1.0), dict.fromkeys(lang, 1.0), dict.fromkeys(top, 1.0)]
    held = lambda axis, skip: {v: sum(n * np.prod([f[b][k[b]] for b in range(3) if not (skip and b == axis)]) for k, n in cells.items() if k[axis] == v) for v in f[axis]}

    def fit(axis):
        h = held(axis, True)
        have = sum(want[axis][v] for v in h if h[v] > 0)
        f[axis] = {v: want[axis][v] / have / h[v] if h[v] > 0 else 0.0 for v in h}

    def gap():
        out = 0.0
        for axis in (1, 2):
            h = held(axis, False)
            have = sum(want[axis][v] for v in h if h[v] > 0)
            out = max([out, *(abs(h[v] - want[axis][v] / have) for v in h if h[v] > 0)])
        return out

    fit(0)
    done = 0
    while done < mixing.SWEEPS or (done < mixing.MAX_SWEEPS and gap() > mixing.TOLERANCE):
        fit(1), fit(2), fit(0)
        done += 1
    held_cells = {(s, a, t) for s, a, t, n in keys if n}
    out = []
    for r, (s, a, t, n) in zip(rows, keys):
        e = total * f[0][s] * f[1][at(a, lang)] * f[2][at(t, top)] * mixing.BUDGET if (s, a, t) in held_cells else 0.0
        name = "null" if r[0] is None else str(r[0])
        draw = int(hashlib.md5("|".join([str(mixing.SEED), "mix", name]).encode()).hexdigest()[:8], 16) / 4294967296
        out += [r] * (int(e) + (draw < e - int(e)))
    return out


def test_every_stage_against_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels, bench = spark.read.parquet(f"{corpus}/labels.parquet"), [r["text"] for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    want = rows_of(docs)
    model = toxicity.fit(docs, labels)
    by_hand = {
        "toxicity": lambda rows: toxic_by_hand(rows, model), "near_duplicates": near_by_hand,
        "decontamination": lambda rows: clean_by_hand(rows, bench), "mixing": mixed_by_hand,
    }
    sizes = [len(want)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns, name
        want = sorted(by_hand[name](want), key=repr)
        docs = corpus_pipeline.store(out, f"test-{name}")
        assert rows_of(docs) == want, name
        sizes.append(len(want))
        if name == "toxicity":
            ids = {r[0] for r in want}
            assert sum(i not in ids for i in range(0, 420, 4)) > 95 and sum(i in ids for i in range(420) if i % 4) > 300  # some copies of toxic texts are labelled 0
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2]
    name, stage = corpus_pipeline.STAGES[-1]
    out = stage(spark, docs, corpus)
    rows = out.collect()
    assert sorted(json.dumps([r[c] for c in COLUMNS]) for r in rows) == sorted(json.dumps(list(r)) for r in want)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) <= set(range(16))
    whole = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows))


def test_pipeline_on_empty_documents(spark, corpus, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == [*COLUMNS, "size", "text_crc32", "row_number", "shard", "slot"]
