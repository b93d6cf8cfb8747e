"""Spelling variants, exact top-k and fill-in-middle against brute force, and their edge cases."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from envlab.llm import fim, mtree, queries, spelling

from ..conftest import SF0001

# ---- spelling variants


def misspelt_counts(rows, noise):
    c = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    return c


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, noise, min_chars=7, min_n=2, ratio=10):
    n = {w: k for w, k in misspelt_counts(rows, noise).items() if k >= min_n and len(w) >= min_chars}
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    near = {w: [x for m in (len(w) - 1, len(w), len(w) + 1) for x in by.get(m, ()) if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got_variants(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def spelt(seed=4, docs=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcé×") for _ in range(rnd.choice([6, 7, 7, 8, 9, 15]))) for _ in range(25)]
    out = []
    for i in range(docs):
        words = []
        for _ in range(40):
            w = base[int(len(base) * rnd.random() ** 3)]
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1:], w[:k] + "b" + w[k:], w[:k] + "c" + w[k + 1:]])
            words.append(w.upper() if rnd.random() < 0.2 else w)
        out.append((i, rnd.choice(" _1\n").join(words)))
    return out


@pytest.mark.parametrize("most", [2, 7, 256])
def test_variants_match_brute_force(spark, docs_of, most):
    rows = spelt() + [(500, None), (501, ""), (502, " 12 "), (None, "abcabcabc abcabcabc"), (3, "aaaaaaa aaaaaaa"), (3, "aaaaaaa aaaaaaa")]
    rows += [(503, " ".join(["b" * 4000, "b" * 3999, "b" * 4000, "b" * 3999]))]
    rows += [(i, "mnopqrs " * 40 + "mnopqrst " * 4 + "mnopqrstu " * (i % 3 == 0)) for i in range(600, 630)]
    want = brute_variants(rows, 5)
    assert got_variants(spelling.variants(docs_of(rows, "n long, word string"), noise=5, most=most)) == want
    assert any(r[2] != r[1] and r[1] for r in want)  # paths of two steps


def test_variants_without_noise_other_bounds_and_empty(spark, docs_of):
    rows = spelt(9, 20)
    got = got_variants(spelling.variants(docs_of(rows).repartition(5), min_chars=5, min_n=1, ratio=2))
    assert got == brute_variants(rows, None, 5, 1, 2)
    assert spelling.variants(docs_of([]), noise=31).collect() == []
    assert spelling.variants(docs_of([(1, None)]), noise=31).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(docs_of(rows), ratio=1)


def test_op11_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    assert got_variants(queries.op11_spelling(spark, SF0001)) == brute_variants(rows, 31)


def test_groups_are_small_and_hold_every_near_pair(spark):
    words = sorted({w for w in misspelt_counts(spelt(), None)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    most = 5
    met, sizes = set(), []
    for g in spelling.groups(df, most).collect():
        ws = [x["word"] for x in g["words"]]
        sizes.append((len(ws), g["hi"] - g["lo"]))
        met |= {frozenset((a, b)) for a in ws for b in ws if a != b}
    assert all(frozenset((a, b)) in met for a in words for b in words if a < b and one_edit(a, b))
    assert all(n <= most or width == 1 for n, width in sizes)


def test_near_pairs_across_blocks():
    rnd = random.Random(2)
    words = sorted({"ab" + "".join(rnd.choice("xyz") for _ in range(rnd.choice([5, 6]))) for _ in range(400)})
    n = len(words)
    assert n > 3 * spelling.BLOCK
    one = np.zeros(n, dtype=int)
    i, j = spelling.near_pairs(words, one, 8, one, one + 8)
    want = {(a, b) for a in range(n) for b in range(a) if one_edit(words[a], words[b]) and 8 in (len(words[a]), len(words[b]))}
    assert {(max(p), min(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


# ---- exact top-k


def vectors_of(spark, rows, extra="score long, rank string"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<float>, {extra}")


def brute_topk(rows, ids, k, scale=256):
    usable = sorted({
        (i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    })
    out = []
    for q in sorted({i for i, _ in usable if i in ids}):
        x = min(v for i, v in usable if i == q)
        best = {}
        for i, v in usable:
            if i != q and len(v) == len(x):
                best[i] = max(best.get(i, -(1 << 62)), sum(a * b for a, b in zip(x, v)))
        order = sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(order)]
    return sorted(out)


def got_topk(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def clustered(n, dim=6, seed=1, wide=0.02):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, dim))
    return [(int(i), (centres[i % 12] + wide * rnd.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def test_topk_matches_brute_force_with_ties_copies_and_bad_rows(spark):
    rows = clustered(300) + [(1000 + i, [1.0] * 6) for i in range(30)] + [(2000, [0.0] * 6), (2001, [0.0] * 6)]
    rows += [(None, [1.0] * 6), (3000, None), (3001, [1.0, None, 1.0, 0.0, 0.0, 0.0]), (3002, [float("nan")] * 6), (3003, [float("inf")] * 6)]
    rows += [(4000, [3.0, 1.0]), (4001, [2.0, 1.0]), (5000, []), (5001, []), (6000, [9.0] * 3), (5, rows[5][1]), (7, rows[8][1])]
    ids = {0, 5, 7, 100, 299, 1000, 1029, 2000, 3000, 3002, 4000, 4001, 5000, 6000}
    df = vectors_of(spark, rows)
    want = brute_topk(rows, ids, 5)
    for sub, page in ((20, 4), (1000, 48)):
        index = mtree.build_index(df, 5, subtree_rows=sub, page=page)
        assert got_topk(mtree.search(index, df.where(df.vec_id.isin(*ids)), 5, query_rows=3)) == want


def test_topk_bounds_spare_distances_on_clusters(spark):
    rows = clustered(3000, seed=3)
    df = vectors_of(spark, rows).repartition(3)
    index = mtree.build_index(df, 5, subtree_rows=400, page=16)
    found = mtree.searched(index, df.where("vec_id % 50 = 0"), 5)
    assert got_topk(mtree.best_of(found, 5)) == brute_topk(rows, set(range(0, 3000, 50)), 5)
    computed = found.agg({"computed": "sum"}).first()[0]
    assert computed < 0.5 * 60 * 3000


def test_topk_large_components_and_empty_tables(spark):
    rows = [(i, [float((-1) ** i * 2.0**20 * (i % 7 + 1)), float(i)]) for i in range(40)]
    df = vectors_of(spark, rows)
    assert got_topk(mtree.search(mtree.build_index(df, 3, subtree_rows=8, page=4), df.where("vec_id % 4 = 0"), 3)) == brute_topk(rows, set(range(0, 40, 4)), 3)
    none = df.where("vec_id < 0")
    assert mtree.search(mtree.build_index(none, 3), df, 3).collect() == []
    assert mtree.search(mtree.build_index(df, 3), none, 3).collect() == []


def test_pages_keep_their_bounds():
    x = mtree.lifted(np.floor(np.random.default_rng(0).normal(size=(500, 4)) * 50), 1e5)
    pages = mtree.build_pages(x, 8)

    def members(p):
        return list(p["obj"]) if p["leaf"] else [i for c in p["child"] for i in members(pages[c])]

    assert sorted(members(pages[0])) == list(range(500))
    for p in pages:
        assert len(p["obj"]) <= 8
        for o, r, c in zip(p["obj"], p["radius"], p["child"]):
            if not p["leaf"]:
                assert mtree.distances(x[members(pages[c])], x[[o]]).max() <= r
                np.testing.assert_allclose(pages[c]["up"], mtree.distances(x[pages[c]["obj"]], x[[o]])[:, 0], atol=1e-6)


# ---- fill-in-middle


def test_chunks_count_and_place_code_points():
    rnd = random.Random(5)
    for n in (0, 1, 2, 700, 30_000):
        text = "".join(rnd.choice("ab é中\U0001f600") for _ in range(n))
        raw = text.encode()
        chunks = fim.Chunks()
        t = fim.Text(raw, chunks)
        assert t.n == n and (not n or t.ends[-1] == len(raw))
        for c in {0, n, *(rnd.randrange(n + 1) for _ in range(50))}:
            assert t.place(c) == len(text[:c].encode())


def test_shared_passages_share_chunks_wherever_they_stand():
    rnd = random.Random(6)
    passage = " ".join(f"w{rnd.randrange(999)}" for _ in range(4000)).encode()
    chunks = fim.Chunks()
    fim.Text(passage, chunks)
    before = chunks.misses
    t = fim.Text("é".encode() * 777 + passage, chunks)
    assert chunks.misses - before < 0.2 * before and t.n == 777 + len(passage)


def test_slices_and_long_stretches_do_not_change_chunks(monkeypatch):
    rnd = random.Random(8)
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(20_000)) + b"a" * 20_000, dtype=np.uint8)
    whole = fim.chunk_ends(data)
    monkeypatch.setattr(fim, "SLICE", 100)
    assert fim.chunk_ends(data).tolist() == whole.tolist()
    assert np.diff(whole).max() <= fim.MAX_CHUNK and whole[-1] == len(data)


def test_equal_hashes_of_different_chunks_are_told_apart(monkeypatch):
    monkeypatch.setattr(fim.xxhash, "xxh3_64_intdigest", lambda b: 1)
    chunks = fim.Chunks()
    assert [chunks.summary(c) for c in (b"abc", "éa".encode(), b"abc", "éa".encode()[1:])] == [(3, 0), (2, 0), (3, 0), (1, 1)]
    assert chunks.hits == 1


def test_fim_edge_cases(spark, docs_of):
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("xyé中<>PSM\n") for _ in range(rnd.randrange(60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a<S>b"), (303, "z" * 300_000 + "é"), (None, "null id text"), (304, "q"), (304, "q"), (305, "\x00\x01")]
    out = fim.restored(fim.fill_in_middle(docs_of(rows, "n long, output string"))).collect()
    assert sorted((str(r["doc_id"]), r["restored"]) for r in out) == sorted((str(i), t or "") for i, t in rows)
    texts = {i: t or "" for i, t in rows}
    for r in out:
        t = texts[r["doc_id"]]
        assert r["n"] == len(t)
        if r["form"] == "plain":
            assert r["output"] == t and r["prefix_chars"] is None and r["middle_chars"] is None
            continue
        a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
        p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
        assert r["output"] == (p + s + m if r["form"] == "psm" else s + p + m)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(docs_of([]))).collect() == []
