"""Sharding, WARC, token files and graph search: round trips and brute force, edge cases."""
import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from envlab.llm import ann, shards, tokens, warc
from envlab.llm.queries import op5_ann, op10_tokens

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 5000])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).select(shards.permute(F.col("id"), n)).collect()]
    assert sorted(got) == list(range(n))
    if n >= 97:
        assert got != sorted(got)


def test_shards(spark, docs_of):
    docs = [(i * 31 % 1000, f"text {i} é") for i in range(300)] + [(None, None), (None, ""), (7, "same"), (7, "same"), (8, "x" * 100_000)]
    df = docs_of(docs)
    rows = shards.shard_rows(df, 16).collect()
    assert len(rows) == len(docs)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(16)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    order = sorted(rows, key=lambda r: r["row_number"])
    assert [r["row_number"] for r in order] == list(range(len(docs)))
    # the same rows in another order and partitioning get the same places
    other = shards.shard_rows(docs_of(docs[::-1]).repartition(5), 16).collect()
    pick = lambda rs: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rs)
    assert pick(other) == pick(rows)
    where = spark.range(len(docs)).select(*shards.locate(F.col("id"), len(docs), 16)).collect()
    assert all(tuple(where[r["row_number"]]) == (r["shard"], r["slot"]) for r in rows)
    full = shards.shard_rows(df, 4)
    assert full.columns == [c for c in df.columns if c != "shard"] + ["size", "text_crc32", "row_number", "shard", "slot"]
    assert sorted((r["doc_id"], r["text"]) for r in full.where("doc_id is not null").collect()) == sorted(d for d in docs if d[0] is not None)
    assert shards.shard_rows(df.limit(0), 16).count() == 0


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("member", F.lit("clash"))


def test_warc_round_trip(spark):
    rows = [(i, f"http://x.org/é {i}\r\nX: y", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "u", "<p>1</p>"), (None, "u", "alone"), (3, "again", rows[3][2]), (200, "big", "\r\n\r\nWARC/1.1 é" * 50_000)]
    df = pages_of(spark, rows)
    got = warc.resolved(warc.read_archives(warc.write_archives(df), payloads=True)).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        alone = f is None or f == i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if alone else "revisit", None if alone else f))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(want)
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    # small payloads are all responses when a size is set; archives roll over
    listed = warc.write_archives(df, min_bytes=10**9, max_bytes=500)
    assert warc.read_archives(listed).where("record_type = 'revisit'").count() == 0
    assert listed.agg(F.sum("n_records")).first()[0] == len(rows) and listed.count() > 3
    empty = warc.write_archives(df.limit(0))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0


def test_warc_reader_by_hand():
    a, b = warc.response_member(1, "http://a", b"x" * 300_000), warc.revisit_member(2, None, "D", 1)
    out = list(warc.read_records(io.BytesIO(a + b), keep_payload=True))
    assert [r.kind for r in out] == ["response", "revisit"] and out[0].payload == b"x" * 300_000
    assert out[0].block_ok and out[0].payload_ok and out[1].payload_bytes == 0
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\n")
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(a[:-20])))
    raw = gzip.decompress(a).replace(b"Content-Length: 300", b"Content-Length: 299", 1)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(gzip.compress(raw))))
    wrong = gzip.compress(gzip.decompress(a).replace(b"xxxx", b"xyxx", 1))
    bad = next(warc.read_records(io.BytesIO(wrong)))
    assert not bad.block_ok and not bad.payload_ok
    assert list(warc.read_records(io.BytesIO(b""))) == []


def tokenizer_path():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def plain_record(lines, block, version="WARC/1.0"):
    head = "\r\n".join([version, *lines, f"Content-Length: {len(block)}"]).encode()
    return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_warc_reader_takes_archives_of_others(spark, tmp_path):
    sha = hashlib.sha1(b"<p>hi</p>").hexdigest()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi</p>"
    records = [
        (["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n\r\nmore\r\n"),
        (["warc-type: response", "WARC-Record-ID: <urn:uuid:2>", "Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/", " b"], http),
        (["WARC-Type: request", "WARC-Record-ID: <urn:uuid:3>", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        (["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: text/plain", f"WARC-Payload-Digest: SHA-1:{sha.upper()}"], b"<p>hi</p>"),
        (["WARC-Type: metadata", "Content-Type: application/warc-fields", "WARC-Block-Digest: md5:" + hashlib.md5(b"a: b\r\n").hexdigest()], b"a: b\r\n"),
        (["WARC-Type: conversion", "WARC-Record-ID: <urn:uuid:6>", "WARC-Block-Digest: nosuch:ABC"], b""),
        (["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:7>", "WARC-Refers-To: <urn:uuid:2>", "Content-Type: application/http", "WARC-Payload-Digest: sha1:AAAA"], b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    data = b"".join(plain_record(*r) for r in records)
    got = list(warc.read_records(io.BytesIO(data), keep_payload=True))
    assert [(r.kind, r.payload, r.block_ok, r.payload_ok) for r in got] == [
        ("warcinfo", records[0][1], None, None), ("response", b"<p>hi</p>", None, None), ("request", b"", None, None),
        ("resource", b"<p>hi</p>", None, True), ("metadata", b"a: b\r\n", True, None), ("conversion", b"", None, None), ("revisit", b"", None, None),
    ]
    assert got[1].headers["warc-target-uri"] == "http://a/ b" and got[1].http.startswith(b"HTTP/1.1 200")
    (tmp_path / "x.warc.gz").write_bytes(data)
    listed = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "uri string")
    rows = {r["record_id"]: r for r in warc.resolved(warc.read_archives(listed, payloads=True)).collect()}
    assert len(rows) == 7 and all(r["page_id"] is None for r in rows.values())
    assert rows["<urn:uuid:7>"]["refers_to_id"] == "<urn:uuid:2>" and rows["<urn:uuid:7>"]["payload_digest"] == "AAAA"
    assert rows["<urn:uuid:2>"]["payload_digest"] == rows["<urn:uuid:4>"]["payload_digest"] == warc.sha1_32(b"<p>hi</p>")
    wrong = plain_record(["WARC-Type: resource", "WARC-Block-Digest: sha1:" + "0" * 40], b"x")
    assert next(warc.read_records(io.BytesIO(wrong))).block_ok is False
    (tmp_path / "y.warc.gz").write_bytes(wrong)
    with pytest.raises(Exception, match="digest mismatch"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/y.warc.gz",)], "uri string")).collect()
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nx\r\n\r\n"))))


def test_one_payload_of_many_pages_is_spread(spark, monkeypatch):
    monkeypatch.setattr("envlab.llm.common.SPREAD_ROWS", 4)
    df = spark.createDataFrame([(i, "u", None if i % 3 else f"page {i % 5}") for i in range(60)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.resolved(warc.read_archives(warc.write_archives(df))).collect()}
    first = {}
    for r in sorted(df.collect(), key=lambda r: r["page_id"]):
        at = first.setdefault(r["html"] or "", r["page_id"])
        g = got[r["page_id"]]
        assert (g["record_type"], g["refers_to"]) == (("response", None) if at == r["page_id"] else ("revisit", at))
        assert g["payload_bytes"] == len(r["html"] or "")


def test_shards_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, "t" * i, "d", 1, 2) for i in range(9)], "doc_id long, text string, `a.b` string, __at int, __tie int")
    out = shards.shard_rows(df, 4)
    assert out.columns == [*df.columns, "size", "text_crc32", "row_number", "shard", "slot"]
    assert sorted((r["doc_id"], r["a.b"], r["__at"], r["size"]) for r in out.collect()) == [(i, "d", 1, i + 1) for i in range(9)]


def test_piecewise_encoding_equals_the_library(spark):
    enc = tokens.Encoder(tokenizer_path())
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a<|endoftext|>b", " \t\n x  y\x1c\x1d z ’s 123 中文 don't  \n\n", "\x85  q\xa0 w", "I'll 'S'' ''s", "  lead", "tail  ", "ß" * 500, "é́ ´", "a_b __ _1 x²³¹¼½¾9 ²a", "\x00\x7f\x85\xa0\xad\x1e", "".join(map(chr, range(0x500))), " ".join(map(chr, range(1, 0x500)))]
    for t in texts:
        assert enc.encode(t) == enc._whole(t)
    assert enc.by_piece and enc.width == 2


def test_slices_of_texts_equal_the_library_and_merge_words_together(monkeypatch):
    texts = ["", " ", "one two", "two one, two.\nOne", "a\n\nb\n\n c", "\nx y\tz", "tail ", "two  blanks", "x \n y", "中 two", "a<|endoftext|> b", "it's 'two' ... _1", "nb\xa0sp \xa0\xa0 à \x85", "é è Σ ж à", "one"]
    enc = tokens.Encoder(tokenizer_path())
    want = [enc._whole(t) for t in texts]
    for size in (1, 30, 1 << 24):
        monkeypatch.setattr(tokens, "SLICE_BYTES", size)
        assert list(enc.encode_all(pa.array(texts))) == want
    assert list(enc.encode_all(pa.array([], pa.string()))) == []
    enc.most = 3  # the memo is full all the time
    assert list(enc.encode_all(pa.array(texts))) == want
    enc, calls = tokens.Encoder(tokenizer_path()), []
    merge = enc.merge
    enc.merge = lambda spelt: calls.append(spelt) or merge(spelt)
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c for a in letters for b in letters for c in "xyz"]  # 1,200
    new = ["x " + " ".join(words), "y " + ", ".join(words)]
    assert list(enc.encode_all(pa.array(new))) == [enc._whole(t) for t in new] and len(calls) < 100
    assert not enc._joins("ĠÂłĠÂł") and enc._joins("oĠt")  # a no-break space is no letter


def test_token_files_match_brute_force(spark):
    lib = tokens.Encoder(tokenizer_path()).library
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    start, want = 0, {}
    for i, t in docs:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op10_tokens(spark, SF).collect()}
    assert got == want


def test_token_files_edges(spark, docs_of):
    df = docs_of([(5, "five"), (None, None), (5, "five"), (5, "again"), (1, ""), (2, "long " * 50_000)])
    entries = tokens.write_tokens(df, tokenizer_path())
    index = tokens.build_index(entries)
    keys = entries.select("doc_id", F.expr(tokens.KEY).alias("key"))
    foreign = spark.createDataFrame([(9, "9#0"), (9, "5#3")], "doc_id long, key string")
    places = tokens.look_up(keys.union(foreign), index)
    got = {r["key"]: r for r in tokens.read_tokens(places, entries, keep_ids=True).collect()}
    assert set(got) == {"null#0", "1#0", "2#0", "5#0", "5#1", "5#2"}
    lib = tokens.Encoder(tokenizer_path()).library
    text = {"null#0": "", "1#0": "", "2#0": "long " * 50_000, "5#0": "again", "5#1": "five", "5#2": "five"}
    at = 0
    for k in ("null#0", "1#0", "2#0", "5#0", "5#1", "5#2"):
        assert got[k]["ids"] == [*lib.encode(text[k], add_special_tokens=False).ids, 2] and got[k]["start"] == at
        at += got[k]["n_tokens"]
    empty = tokens.write_tokens(df.limit(0), tokenizer_path())
    assert empty.count() == 0 and tokens.build_index(empty).count() == 0
    assert tokens.read_tokens(tokens.look_up(foreign, tokens.build_index(empty)), empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 300, 5000])
def test_perfect_hash(n):
    keys = [f"{i}#0" for i in range(n)]
    seeds, slots, finger = tokens.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(n))
    at, f = tokens.find_slots(keys, seeds, n)
    assert (at == slots).all() and (f == finger).all()


def brute_nearest(rows, qs, k):
    out = {}
    for q, v in qs:
        d = sorted((float(np.sqrt(((np.float64(v) - np.float64(x)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = d[:k]
    return out


def test_graph_search_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    data = dict(rows)
    want = brute_nearest(rows, [(i, v) for i, v in rows if i % 100 == 0], 10)
    got = {}
    for r in op5_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        for _, v, s in found:
            assert abs(s - float(np.sqrt(((np.float64(data[q]) - np.float64(data[v])) ** 2).sum()))) < 1e-12 and v != q
        hits += len({v for _, v, _ in found} & {v for _, v in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_graph_search_touches_few_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8192, 12)) @ rng.normal(size=(12, 64)) + 0.1 * rng.normal(size=(8192, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    edges, medoid = ann.build_graph(x)
    q = x[::40]
    ids, _, touched = ann.beam_search(x, edges, medoid, q, ann.SEARCH_BEAM)
    true = np.argsort(((x[None] - q[:, None]) ** 2).sum(axis=2), axis=1)[:, :11]
    recall = np.mean([len(set(a[:11]) & set(b)) / 11 for a, b in zip(ids.tolist(), true.tolist())])
    assert recall >= 0.9 and touched.mean() < 0.12 * len(x), (recall, touched.mean())


def test_graph_search_edges(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(1, 60)]
    rows += [(k, [1.0, 0.0, 0.0, 0.0]) for k in range(100, 160)]  # one very common vector
    rows += [(500, None), (501, [0.0] * 4), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan"), 1.0, 0.0, 0.0]), (504, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (505, []), (700, [1.0, 2.0]), (800, [3.0, 4.0]), (7, rows[6][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash"))
    index = ann.build_index(df, k=10, shard_rows=16)
    got = {}
    for r in ann.search(index, df.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    good = [(i, np.float32(v)) for i, v in {i: v for i, v in rows if i is not None}.items() if v and None not in v and np.isfinite(v).all() and any(v)]
    four, two = [x for x in good if len(x[1]) == 4], [x for x in good if len(x[1]) == 2]
    want = brute_nearest(four, [x for x in four if x[0] == 100], 10) | brute_nearest(two, [x for x in two if x[0] % 100 == 0], 10)
    assert {q: sorted(v) for q, v in got.items()} == want
    assert [v for _, v in want[100]] == list(range(101, 111))
    assert ann.search(ann.build_index(df.limit(0), k=3), df, 3).count() == 0


def test_op8_shards_whole_documents(spark, monkeypatch):
    from envlab.llm.queries import QUERIES

    made, shard_rows = [], shards.shard_rows
    monkeypatch.setattr(shards, "shard_rows", lambda *a, **k: made.append(shard_rows(*a, **k)) or made[-1])
    out = QUERIES["op8_sharding"](spark, "/root/testdata/sf0.001")
    assert set(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns) <= set(made[0].columns)
    names = ["doc_id", "size", "text_crc32", "shard", "slot", "row_number"]
    assert sorted(out.select(*names).collect()) == sorted(made[0].select(*names).collect())
