"""SimHash and line dedup against brute force, and the edge cases of both."""
import random

import pytest

from envlab.llm import linededup, simhash


def brute(docs, max_bits):
    fps = [simhash.fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in df.collect()), key=str)


def near_copies(n, seed=1):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(260)]
    docs = []
    for i in range(n):
        w = list(base) if i % 3 else [f"v{rnd.randrange(9000)}" for _ in range(rnd.randrange(0, 40))]
        for _ in range(i % 4 if w else 0):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
        docs.append((i * 7 % 1009, " ".join(w)))
    return docs


def test_fingerprint_by_hand():
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in ("a é b", "é b c")]
    want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) > 1)
    assert simhash.fingerprint("A\té\x0bB c") == want
    assert simhash.fingerprint("Ab") == simhash.fingerprint(" ab\n") == xxhash.xxh64_intdigest("ab", 42)
    assert simhash.fingerprint("É b c") != simhash.fingerprint("é b c")
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_duplicates_match_brute_force(spark, docs_of):
    rows = near_copies(150) + [(2000, None), (2001, ""), (2002, " \t"), (None, "only this"), (3, "only this"), (3, "other"), (None, None)]
    for bits in (0, 2, 3):
        assert got(simhash.near_duplicates(docs_of(rows), max_bits=bits)) == brute(rows, bits)


def test_shared_keys_beyond_the_limit_lose_no_link(docs_of):
    rows = near_copies(120, seed=3)
    assert got(simhash.near_duplicates(docs_of(rows), max_bits=2, key_pairs=1)) == brute(rows, 2)


def test_links_in_a_ball(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {base, *(base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(120)), *(rnd.getrandbits(64) for _ in range(50))}
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    pairs = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(df, 2).collect()}
    assert pairs == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(-5, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert all(roots[i] == 0 for i in range(41)) and all(roots[100 + k] == 100 for k in range(30)) and roots[300] == -5


def test_keep_first_keeps_one_row_of_each_class(spark, docs_of):
    same = "the same text over and over again in every one of these rows"
    rows = [(5, same), (4, same), (4, same), (9, None), (8, ""), (None, "solo text here now"), (4, "another text with id four"), (1, "x y z")]
    df = docs_of(rows)
    out = simhash.keep_first(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(
        [(4, same), (8, ""), (None, "solo text here now"), (4, "another text with id four"), (1, "x y z")], key=str
    )
    assert simhash.keep_first(df.limit(0)).count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def every_block(docs, min_words):
    """Every block of every document against every block of the earlier ones."""
    out, seen = {}, set()
    for i, t in sorted(docs):
        lines = [(k, x.strip(" ")) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        gone, mine = set(), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                block = tuple(x for _, x in lines[a:b])
                if sum(len(x.split()) for x in block) >= min_words:
                    mine.add(block)
                    gone |= {k for k, _ in lines[a:b]} if block in seen else set()
        seen |= mine
        out[i] = sorted(gone)
    return out


def test_line_dedup_matches_brute_force(docs_of):
    rnd = random.Random(2)
    pool = [" ".join(f"p{k}w{j}" for j in range(rnd.randrange(3, 15))) for k in range(30)]
    docs = []
    for i in range(60):
        lines = [rnd.choice(pool) if rnd.random() < 0.4 else f"own {i} {k}" for k in range(rnd.randrange(0, 12))]
        if i % 4 == 0:
            at = rnd.randrange(0, 25)
            lines[2:2] = pool[at:at + 4]
        docs.append((i, "\n".join(lines)))
    want = every_block(docs, 20)
    rows = linededup.dedup_lines(docs_of(docs), 20).collect()
    assert {r["doc_id"]: list(r["removed"]) for r in rows} == want
    text = dict(docs)
    for r in rows:
        assert r["text"] == "\n".join(x for k, x in enumerate(text[r["doc_id"]].split("\n")) if k not in r["removed"])


def test_line_dedup_finds_blocks_of_every_earlier_document(docs_of):
    rnd = random.Random(5)
    line = {k: " ".join(f"p{k}w{j}" for j in range(rnd.choice([1, 4, 10, 19, 25]))) for k in range(25)}
    # 2 holds a block of 1 whose lines stood in 0 and -1 before; 3 holds it twice and turned round
    a, b = ["a " * 10, "b " * 10]
    docs = [(-1, f"x\n{a}"), (0, f"y\n{b}"), (1, f"own\n{a}\n\n{b}"), (2, f"{a}\n{b}\nz"), (3, f"{b}\n{a}\n{b}\nq\n{a}\n{b}")]
    for i in range(10, 70):
        at = rnd.randrange(18)
        lines = [line[at + k] if rnd.random() < 0.7 else rnd.choice(["", f"own {i}", line[rnd.randrange(25)]]) for k in range(rnd.randrange(8))]
        docs.append((i, "\n".join(lines)))
    want = every_block(docs, 20)
    assert want[1] == [] and want[2] == [0, 1] and want[3] == [1, 2, 4, 5]
    aligned = {i: set() for i, _ in docs}
    seqs = [(i, [(k, x.strip()) for k, x in enumerate(t.split("\n")) if x.strip()]) for i, t in sorted(docs)]
    for n, (i, x) in enumerate(seqs):
        for _, y in seqs[:n]:
            at = linededup.repeated_lines([s for _, s in x], [len(s.split()) for _, s in x], [s for _, s in y], 20)
            aligned[i] |= {x[k][0] for k in at}
    # alignment with every earlier document finds the same
    assert {i: sorted(x) for i, x in aligned.items()} == want
    rows = linededup.dedup_lines(docs_of(docs).repartition(3), 20).collect()
    assert {r["doc_id"]: list(r["removed"]) for r in rows} == want
    text = dict(docs)
    assert all(r["text"] == "\n".join(x for k, x in enumerate(text[r["doc_id"]].split("\n")) if k not in r["removed"]) for r in rows)


def test_common_lines_propose_their_pairs(docs_of):
    r, c = " ".join(f"r{j}" for j in range(12)), "\n".join(" ".join(f"c{k}{j}" for j in range(12)) for k in range(2))
    # c stands in five documents; 5 holds it behind r, as 1 does, and again
    docs = [(0, f"a\n{c}"), (1, f"{r}\n{c}"), (2, f"f\n{c}"), (3, f"g\n{c}"), (5, f"{r}\n{c}\nown\n{c}")]
    rows = linededup.dedup_lines(docs_of(docs), 20).collect()
    got = {x["doc_id"]: list(x["removed"]) for x in rows}
    assert got == every_block(docs, 20) and got[5] == [0, 1, 2, 4, 5]


def test_moved_and_repeated_blocks_are_aligned():
    later, words = [1, 2, 9, 3, 4, 1, 2], [10] * 7
    assert linededup.repeated_lines(later, words, [3, 4, 8, 1, 2], 20) == [0, 1, 3, 4, 5, 6]
    assert linededup.repeated_lines(later, words, [2, 1, 4, 3], 20) == []


def test_a_passage_of_many_documents_is_spread(docs_of, monkeypatch):
    monkeypatch.setattr("envlab.llm.common.SPREAD_ROWS", 3)
    passage = "\n".join(" ".join(f"c{k}{j}" for j in range(12)) for k in range(3))
    docs = [(i, f"own {i}\n{passage}" if i % 2 else f"{passage}\nend {i}") for i in range(40)]
    rows = linededup.dedup_lines(docs_of(docs), 20).collect()
    assert len(rows) == 40 and {x["doc_id"]: list(x["removed"]) for x in rows} == every_block(docs, 20)


def test_names_with_dots_and_helper_names_stay(spark):
    block = " ".join(f"b{j}" for j in range(25))
    df = spark.createDataFrame([(i, block, "d", 7, True, 1.5) for i in range(3)], "doc_id long, text string, `a.b` string, __h int, places boolean, __at double")
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "removed"]
    assert sorted((r["doc_id"], r["text"], r["a.b"], r["__h"], r["places"]) for r in out.collect()) == [
        (0, block, "d", 7, True), (1, "", "d", 7, True), (2, "", "d", 7, True)
    ]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(0, block, "d", 7, True, 1.5)]


def test_patience():
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]
    assert linededup.patience([1, 1, 2], [1, 2]) == [(0, 0), (2, 1)]
    assert linededup.patience([5, 5, 5], [7, 5, 5]) in ([(1, 1), (2, 2)],)
    assert linededup.patience([], [1]) == []
    assert linededup.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_line_dedup_edges(docs_of):
    block = "\n".join(" ".join(f"b{k}{j}" for j in range(10)) for k in range(4))
    rows = [(None, block), (2, block), (2, "x\n" + block + "\n\ny"), (3, None), (4, ""), (5, "\n\n"), (6, block.replace("\n", " \n ")), (2, block)]
    df = docs_of(rows)
    out = linededup.dedup_lines(df)
    assert out.columns == [*df.columns, "removed"]
    got_rows = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got_rows == sorted([(None, block), (2, ""), (2, "x\n\ny"), (3, None), (4, ""), (5, "\n\n"), (6, ""), (2, "")], key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0
