"""Token-id files with a minimal perfect hash index.

Documents are range-partitioned by id; each task encodes its documents in id order and writes one
raw payload file of little-endian ids (two bytes each where the vocabulary allows, else four). The
index maps a document key to its place: keys are dealt by hash into small groups, and each group
gets a minimal perfect hash by displacement (keys fall into buckets; the fullest first, a bucket
tries seeds until all its keys land on free slots). A slot stores a fingerprint of its key, the
payload file and the offset, so a lookup reads one group's seeds, one slot and one payload range,
and a foreign key is told by its fingerprint.

Encoding is the tokenizers library's. A worker remembers the ids of what it has seen: the library's
byte-level pre-tokenizer cuts a text into pieces that are merged on their own, so a text's ids are its
pieces' ids in turn. A blank before a character that is none begins a piece, so a text is first cut
there, into words with what is attached to them, and only new words are cut into pieces. Arrow cuts and
numbers the words of many texts at once, so that each distinct word is looked up once. New words of
letters are merged many at a time where no token of the vocabulary goes on over a blank. Texts that
hold an added token's string go to the library whole.
"""
from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from envlab.llm import files
from envlab.llm.common import shared_uri, store

END_ID = 2
GROUP_KEYS = 2048  # keys a group holds on average
BUCKET_KEYS = 4  # keys a bucket holds on average
MEMO_WORDS = 800_000  # newest words of the memo; the older ones of letters alone are kept beside them; some 280 MB in all
MEMO_PIECES = 100_000  # some 20 MB
SLICE_BYTES = 16 << 20  # text whose words are looked up at once
JOINED_WORDS = 32  # words of letters that are merged at once
LEAD = 32  # characters of a text that order rows of one id over files; more of them would be sampled to the driver
MARKS = string.punctuation.replace("'", "")  # a run of these is a piece; an apostrophe may begin one with letters
# beyond Latin, Greek and Cyrillic, two libraries' character tables might be of different age
FAR = "[^\x00-\u04ff]"
# the byte-level pre-tokenizer's published pattern (fixed value), its classes spelt for U+0000 to U+04FF
_SPACE, _OTHER_NUMBERS = r"\t-\r \x85\xa0", "\xb2\xb3\xb9\xbc-\xbe"
_L, _N = rf"[^\W\d_{_OTHER_NUMBERS}]", rf"[\d{_OTHER_NUMBERS}]"
PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?(?:[^\w{_SPACE}]|_)+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
CUT = rf" (?=[^{_SPACE}])"  # a blank that begins a piece
# Arrow's pattern of texts with a far character, or a blank that begins no piece
ALONE = r"[^\x{0}-\x{4ff}]| [\t-\r \x{85}\x{a0}]| \z"
# in the others a blank put before other spaces that follow something begins no piece either, and is told by that
TO_CUT = (r"([^\t-\r \x{85}\x{a0}])([\t-\r\x{85}\x{a0}])", r"\1 \2")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level model's vocabulary has for each byte: printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Values of ``make`` by key, each made when it is first asked for; all are dropped when there are ``most``."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Ids of texts, as little-endian bytes of ``width`` bytes an id, by the tokenizers library.
    The memo is used where the file's model is a byte-level BPE whose pieces are independent (no
    normalizer, no prefix space) and the text holds no added token and no far character."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        )
        vocabulary = self.library.get_vocab()
        self.width = 4 if self.library.get_vocab_size() > 1 << 16 else 2
        self.pieces = _Memo(self._piece, MEMO_PIECES)
        # of words with a blank before them, which the key lacks, or with a space of their own
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = MEMO_WORDS
        self.find = re.compile(PIECES).findall
        self.cut, self.space = re.compile(CUT).split, re.compile(f"[{_SPACE}]").match
        self.letters = _byte_letters()
        self.blank = self.letters[0x20]
        self.merge = self.library.model.tokenize
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.far = re.compile(FAR).search
        self.code = "H" if self.width == 2 else "I"
        # where no token goes on over a blank, words are merged many at a time: a token that begins with one begins a word
        self.joined = not any(map(self._joins, vocabulary))
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(self.blank)]] = True

    def _joins(self, token: str) -> bool:
        """Whether a token goes on over a blank and may lie in letters and blanks: it has no other whole character."""
        if self.blank not in token.lstrip(self.blank):
            return False
        of = {c: b for b, c in self.letters.items()}
        return all(c == " " or c.isalpha() for c in bytes(of[c] for c in token if c in of).decode("utf-8", "ignore"))

    def _whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def _spelt(self, text: str) -> str:
        """A text's bytes as Latin-1 characters, then as the vocabulary's letters; of printable ASCII only the
        blank has another letter."""
        if text.isascii() and text.isprintable():
            return text.replace(" ", self.blank)
        return text.encode().decode("latin-1").translate(self.letters)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece, merged by the library's model."""
        return self.packed([t.id for t in self.merge(self._spelt(piece))])

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each with a blank before it; words too few to be joined are merged singly."""
        found, many = [], len(stems) // JOINED_WORDS * JOINED_WORDS if self.joined else 0
        for k in range(0, many, JOINED_WORDS):
            ids = np.array([t.id for t in self.merge(self._spelt(" " + " ".join(stems[k:k + JOINED_WORDS])))], dtype=f"<u{self.width}")
            edges = (np.flatnonzero(self.begins[ids]) * self.width).tolist()
            packed = ids.tobytes()
            found += [packed[i:j] for i, j in zip(edges, [*edges[1:], len(packed)])]
        return found + [self._piece(" " + s) for s in stems[many:]]

    def _learn(self, missing: list[str]) -> None:
        """Put words into the memo. A word is often one of letters with marks behind it, which are a piece; other
        words are cut into pieces, of which the first is a word as well."""
        words, older = self.words, self.older
        new, made = {}, []
        for word in missing:
            value = older.get(word)
            if value is not None:
                words[word] = value
                continue
            if word.isalpha():
                new[word] = None
                continue
            stem = word.rstrip(MARKS)
            if stem.isalpha():
                rest = [word[len(stem):]]
            elif self.space(word):
                words[word] = self._first(word)
                continue
            else:
                first, *rest = self.find(" " + word)
                stem = first[1:]
            if stem not in words and stem not in new:
                value = older.get(stem)
                if value is not None:
                    words[stem] = value
                elif stem.isalpha():
                    new[stem] = None
                else:
                    words[stem] = self._piece(first)
            if rest:
                made.append((word, stem, rest))
        words.update(zip(new, self._stems(list(new))))
        for word, stem, rest in made:
            words[word] = words[stem] + b"".join(map(self.pieces.__getitem__, rest))

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, none empty, each with a blank before it unless it begins with a space."""
        found = list(map(self.words.get, words))
        at = [k for k, ids in enumerate(found) if ids is None]
        self._learn([words[k] for k in at])
        for k in at:
            found[k] = self.words[words[k]]
        if len(self.words) >= self.most:  # what was merged becomes the older ones, from which a word in use comes back
            self.words, self.older = {}, {w: ids for w, ids in self.words.items() if w.isalpha()}
        return found

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _first(self, word: str) -> bytes:
        """Ids of a word with no blank before it."""
        return b"".join(map(self.pieces.__getitem__, self.find(word)))

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(a in text for a in self.added) or not text.isascii() and self.far(text):
            return self._whole(text)
        first, *words = self.cut(text)
        return self._first(first) + b"".join(self.word_ids(words))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of every text of a string column without nulls, in order, some SLICE_BYTES of text at once."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield from self._slice(texts.slice(at, stop - at))
            at = stop

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        """Words of the texts that blanks and other spaces cut are looked up once per slice; the ids of a text are gathered
        from those of the slice's distinct words. Other texts are encoded by themselves."""
        if not self.by_piece:
            yield from map(self._whole, texts.to_pylist())
            return
        alone = pc.match_substring_regex(texts, ALONE)
        for a in self.added:
            alone = pc.or_(alone, pc.match_substring(texts, a))
        lists = pc.split_pattern(pc.replace_substring_regex(texts.filter(pc.invert(alone)), *TO_CUT), " ")
        coded = lists.flatten().dictionary_encode()
        words, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
        firsts = of[edges[:-1]]  # these have no blank before them: they get ids of their own, behind the others'
        of[edges[:-1]] = np.arange(len(words), len(words) + len(firsts))
        used = np.zeros(len(words) + len(firsts), dtype=bool)
        used[of] = True
        known = iter(self.word_ids([w for w, u in zip(words, used.tolist()) if u]))
        ids = [next(known) if u else b"" for u in used[:len(words)].tolist()]
        ids += [self._first(words[k]) for k in firsts.tolist()]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.width
        pool = np.frombuffer(b"".join(ids), dtype=f"<u{self.width}")
        each = sizes[of]
        number = np.int32 if max(int(each.sum()), len(pool)) < 1 << 31 else np.int64
        ends = np.cumsum(each, dtype=number)
        places = np.repeat((np.cumsum(sizes) - sizes)[of].astype(number) - ends + each.astype(number), each)
        places += np.arange(len(places), dtype=number)
        gathered = pool[places].tobytes()
        del places, lists, coded
        bounds = iter((np.concatenate([[0], ends]).astype(np.int64)[edges] * self.width).tolist())
        begin = next(bounds)
        for k, by_itself in enumerate(alone.to_pylist()):
            if by_itself:
                yield self.encode(texts[k].as_py())
            else:
                end = next(bounds)
                yield gathered[begin:end]
                begin = end


_ENCODERS: dict[str, Encoder] = {}  # a worker process keeps its encoder over tasks


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task per core
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


ENTRY = "doc_id long, copy long, file long, uri string, at long, n_tokens long, width int"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encode every text, append ``end_id`` and write payload files in ascending doc_id order.
    Returns the stored entries: ``doc_id, copy, file (number in order), uri, at (ids before it in
    the file), n_tokens, width (bytes an id), start (ids of all documents before it)``.

    A NULL text is empty (its ids are the end id alone); NULL ids come first; rows with equal ids
    are ordered by the text and numbered by ``copy``; an empty table writes no file; other columns are
    ignored. Rows with equal ids may lie in several files, those whose texts begin alike lie in one."""
    spark = docs.sparkSession
    folder = shared_uri(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("lead", F.substring("text", 1, LEAD)).repartitionByRange(parts, "doc_id", "lead").sortWithinPartitions("doc_id", "text")
        .select("doc_id", "text", F.spark_partition_id().cast("long").alias("file"))
    )

    def write(batches: Iterator[pa.RecordBatch]):
        enc, out, at, last, copy, none = None, None, 0, None, 0, True
        for b in batches:
            if enc is None:
                enc = encoder(tokenizer_path)
                end = enc.packed([end_id])
            entries = []
            for i, ids, file in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), b.column(2).to_pylist()):
                out = out or files.Appender(folder, f"ids-{file:06d}", ".bin")
                copy = copy + 1 if not none and i == last else 0
                last, none = i, False
                out.write(ids + end)
                n = len(ids) // enc.width + 1
                entries.append({"doc_id": i, "copy": copy, "file": file, "uri": out.uri, "at": at, "n_tokens": n, "width": enc.width})
                at += n
            yield pa.RecordBatch.from_pylist(entries, schema=schema)
        if out is not None:
            out.close()

    schema = pa.schema([
        ("doc_id", pa.int64()), ("copy", pa.int64()), ("file", pa.int64()), ("uri", pa.string()),
        ("at", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
    ])
    return _numbered(store(rows.mapInArrow(write, ENTRY), "token-entries"))


def _numbered(entries: DataFrame) -> DataFrame:
    """``entries`` with copies numbered over files: an id that goes on in the next file counts on."""
    per_file = entries.groupBy("doc_id", "file").agg(F.count(F.lit(1)).alias("n"))
    spread = per_file.groupBy("doc_id").agg(F.count(F.lit(1)).alias("files")).where("files > 1").select(F.col("doc_id").alias("id"))
    # a row per file that such an id lies in
    before = Window.partitionBy("id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(
        per_file.join(spread, F.col("doc_id").eqNullSafe(F.col("id")))
        .select("id", F.col("file").alias("in_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("more")), "token-copies",
    )
    return store(
        entries.join(offsets, (F.col("file") == F.col("in_file")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
        .withColumn("copy", F.col("copy") + F.coalesce("more", F.lit(0))).drop("id", "in_file", "more"), "token-entries",
    )


def _hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hash of each key as two unsigned words: one places the key, one is its fingerprint."""
    h = [xxhash.xxh3_128_intdigest(k) for k in keys]
    m = (1 << 64) - 1
    return np.array([x & m for x in h], dtype=np.uint64), np.array([x >> 64 for x in h], dtype=np.uint64)


def _mix(h: np.ndarray, seed) -> np.ndarray:
    """A 64-bit mix of hash and seed (multiply and shift steps)."""
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def build_mph(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seeds per bucket, slot of each key, fingerprint of each key) of distinct keys; slots are
    exactly 0 .. len(keys) - 1."""
    n = len(keys)
    place, finger = _hashes(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    of = _bucket(place, buckets)
    seeds, slots, used = np.zeros(buckets, dtype=np.int64), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=bool)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in np.argsort(-(edges[1:] - edges[:-1]), kind="stable"):
        mine = order[edges[b]:edges[b + 1]]
        if not len(mine):
            break
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64, dtype=np.uint64)
            at = (_mix(place[mine][None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            free = ~used[at].any(axis=1)
            if len(mine) > 1:
                srt = np.sort(at, axis=1)
                free &= (srt[:, 1:] != srt[:, :-1]).all(axis=1)
            good = np.flatnonzero(free)
            if len(good):
                seeds[b], slots[mine] = seed + good[0], at[good[0]]
                used[at[good[0]]] = True
                break
            seed += 64
            if seed > 1 << 24:
                raise RuntimeError("two keys share a hash")
    return seeds, slots, finger


def find_slots(keys: list[str], seeds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, fingerprint) of keys in a group of ``n`` slots; foreign keys get some slot."""
    place, finger = _hashes(keys)
    seed = seeds[_bucket(place, len(seeds))].astype(np.uint64)
    return (_mix(place, seed) % np.uint64(n)).astype(np.int64), finger


KEY = "concat(coalesce(cast(doc_id as string), 'null'), '#', cast(copy as string))"
INDEX = "grp long, seeds array<long>, finger array<long>, file array<long>, at array<long>, n array<long>"


def build_index(entries: DataFrame) -> DataFrame:
    """The stored index: a row per group of about GROUP_KEYS keys with its seeds and, by slot,
    fingerprints, file numbers, offsets and lengths. Keys are ``<doc_id>#<copy>``."""
    groups = max(1, -(-entries.count() // GROUP_KEYS))
    keyed = entries.select(F.expr(KEY).alias("key"), "file", "at", "n_tokens").withColumn(
        "grp", F.pmod(F.xxhash64("key"), F.lit(groups))
    )

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        seeds, slots, finger = build_mph(table["key"].to_pylist())
        by = np.argsort(slots)
        col = lambda name: table[name].to_numpy()[by].tolist()
        return pa.table({
            "grp": [key[0].as_py()], "seeds": [seeds.tolist()], "finger": [finger.view(np.int64)[by].tolist()],
            "file": [col("file")], "at": [col("at")], "n": [col("n_tokens")],
        })

    return store(keyed.groupBy("grp").applyInArrow(build, INDEX), "token-index")


def look_up(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, file, at, n_tokens) of the keys (column ``key``) that the index holds."""
    groups = max(1, index.count())

    def find(key: tuple[pa.Scalar, ...], wanted: pa.Table, group: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.string()), ("file", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64())])
        if not group.num_rows or not wanted.num_rows:
            return schema.empty_table()
        g = {c: np.asarray(group[c][0].values) for c in ("seeds", "finger", "file", "at", "n")}
        names = wanted["key"].to_pylist()
        slot, finger = find_slots(names, g["seeds"], len(g["finger"]))
        hit = g["finger"][slot] == finger.view(np.int64)
        slot = slot[hit]
        return pa.table([np.array(names, dtype=object)[hit].tolist(), g["file"][slot], g["at"][slot], g["n"][slot]], schema=schema)

    dealt = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").cogroup(index.groupBy("grp")).applyInArrow(find, "key string, file long, at long, n_tokens long")


def read_tokens(places: DataFrame, entries: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Read the id ranges of looked-up ``places`` from the payload files. Returns ``key, start (ids
    before it in all files), n_tokens, ids_crc32 (of the ids as little-endian 32-bit words)`` and
    with ``keep_ids`` also ``ids array<long>``. ``entries`` gives the files' names and lengths."""
    # a row per payload file, as many as writing tasks, in order: their running sum is a short one
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    known = entries.groupBy("file").agg(F.first("uri").alias("uri"), F.first("width").alias("width"), F.sum("n_tokens").alias("n"))
    known = store(known.select("file", "uri", "width", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "token-files")
    schema = "key string, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def read(batches):
        now, src = None, None
        for b in batches:
            rows = []
            for key, at, n, uri, width, base in zip(*(c.to_pylist() for c in b.columns)):
                if uri != now:
                    if src is not None:
                        src.close()
                    now, src = uri, files.open_random(uri)
                ids = np.frombuffer(src.read_at(n * width, at * width), dtype=f"<u{width}")
                rows.append((key, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.tolist()] if keep_ids else [])))
            names = ["key", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names) if rows else pa.RecordBatch.from_pydict(
                {x: pa.array([], pa.string() if x == "key" else pa.int64()) for x in names[:4]}
            )
        if src is not None:
            src.close()

    # neighbours in a file are read by one task, in order
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = places.join(known, "file").select("key", "file", "at", "n_tokens", "uri", "width", "base")
    return placed.repartitionByRange(parts, "file", "at").sortWithinPartitions("file", "at").drop("file").mapInArrow(read, schema)
