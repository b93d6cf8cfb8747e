"""Fill-in-the-middle: documents cut into prefix, middle and suffix and put in another order.

The cuts are numbers of units, here code points, so a document's units are counted and two places
found. A text's UTF-8 bytes are cut into content-defined chunks: a rolling hash over the last
``WINDOW`` bytes ends a chunk where its low bits are zero, at most ``MAX_CHUNK`` bytes on, so passages
that documents share give the same chunks wherever they stand. A worker keeps a cache from chunk to
summary: the number of code points that begin in the chunk, and the bytes at its start that belong to
one begun before (chunks may part a code point). A cached summary is used only if the chunk's whole
content equals the entry's. Running sums of the counts tell the chunk that holds a cut, and only that
chunk is looked into.

The output carries its own order: marker strings stand before the parts, so ``restore`` rebuilds the
text exactly; a text that holds a marker stays plain.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
PLAIN_FROM = 90  # of 100 documents, those from here on stay plain
SPM_BELOW = 20  # of 100 of the others, those below here have the suffix first
WINDOW = 32  # bytes that the rolling hash sees: as many as it has bits
MASK = np.uint32(0xFF800000)  # a chunk has 512 bytes on average
MAX_CHUNK = 4096
SLICE = 1 << 20  # bytes hashed at once
BATCH_ROWS = 256  # documents whose outputs are held at once
CACHE_BYTES = 32 << 20  # content that a worker keeps
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the chunks of bytes ``data``. The hash of the bytes up to a place is the sum of
    their table values, each shifted by its distance, so it sees WINDOW bytes and is the same wherever
    they stand; it is summed by doubling, a slice at a time."""
    ends = []
    for lo in range(0, len(data), SLICE):
        start = max(lo - WINDOW + 1, 0)
        h = GEAR[data[start:lo + SLICE]]
        step = 1
        while step < WINDOW:
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step) if step < len(h) else 0
            h, step = more, step * 2
        ends.append(np.flatnonzero((h[lo - start:] & MASK) == 0) + lo + 1)
    cuts = np.concatenate([np.zeros(1, dtype=np.int64), *ends, np.array([len(data)])]) if len(data) else np.zeros(1, dtype=np.int64)
    cuts = np.unique(cuts)
    out = []
    if len(cuts) > 1 and np.diff(cuts).max() > MAX_CHUNK:  # stretches without a cut
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            out += [*range(a + MAX_CHUNK, b, MAX_CHUNK), b]
        return np.array(out, dtype=np.int64)
    return cuts[1:]


def begins(chunk: bytes) -> np.ndarray:
    """Whether a code point begins at each byte."""
    return (np.frombuffer(chunk, dtype=np.uint8) & 0xC0) != 0x80


class Chunks:
    """The content cache. ``summary`` gives (code points begun in the chunk, bytes at its start that belong
    to one begun before); ``hits`` and ``misses`` count."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held = most, 0
        self.known: dict[int, tuple[bytes, int, int]] = {}
        self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> tuple[int, int]:
        key = xxhash.xxh3_64_intdigest(chunk)
        entry = self.known.get(key)
        if entry is not None and entry[0] == chunk:
            self.hits += 1
            return entry[1:]
        self.misses += 1
        if chunk.isascii():
            found = (len(chunk), 0)
        else:
            b = begins(chunk)
            count = int(np.count_nonzero(b))
            found = (count, int(np.argmax(b)) if count else len(chunk))
        if self.held > self.most:
            self.known.clear()
            self.held = 0
        if entry is None:
            self.held += len(chunk)
            self.known[key] = (chunk, *found)
        return found


class Text:
    """A text's code points, counted by chunks: ``n`` in all, ``place(c)`` the byte at which number c
    begins (the text's end if c is n)."""

    def __init__(self, raw: bytes, chunks: Chunks):
        self.raw, self.chunks = raw, chunks
        self.ends = chunk_ends(np.frombuffer(raw, dtype=np.uint8))
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        counts = [chunks.summary(raw[a:b])[0] for a, b in zip(self.starts.tolist(), self.ends.tolist())]
        self.upto = np.cumsum(np.array(counts, dtype=np.int64))
        self.n = int(self.upto[-1]) if len(counts) else 0

    def place(self, c: int) -> int:
        if c >= self.n:
            return len(self.raw)
        at = int(np.searchsorted(self.upto, c, side="right"))
        a, b = int(self.starts[at]), int(self.ends[at])
        chunk = self.raw[a:b]
        inside = c - (int(self.upto[at - 1]) if at else 0)
        count, lead = self.chunks.summary(chunk)
        if count + lead == len(chunk):  # one byte each after the lead
            return a + lead + inside
        return a + int(np.flatnonzero(begins(chunk))[inside])


def draws(doc_id) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document id."""
    hexed = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(hexed[i:i + 8], 16) for i in range(0, 32, 8))


MARKS = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]


def transform(doc_id, raw: bytes, chunks: Chunks) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, of the prefix, of the middle, output) of a text as UTF-8."""
    text = Text(raw, chunks)
    h1, h2, h3, h4 = draws(doc_id)
    if not raw or any(m in raw for m in MARKS) or h3 % 100 >= PLAIN_FROM:
        return text.n, PLAIN, None, None, raw
    one, two = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    i, j = text.place(one), text.place(two)
    p, s, m = MARKS
    if h4 % 100 < SPM_BELOW:
        return text.n, SPM, one, two - one, b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]))
    return text.n, PSM, one, two - one, b"".join((p, raw[:i], s, raw[j:], m, raw[i:j]))


def restore(output: bytes, form: str) -> bytes:
    """The text from the output and its form. The parts hold no marker, so each stands once."""
    p, s, m = MARKS
    if form == PLAIN:
        return output
    if form == PSM:
        head, middle = output[len(p):].split(m)
        prefix, suffix = head.split(s)
    elif form == SPM:
        head, middle = output[len(s):].split(m)
        suffix, prefix = head.split(p)
    else:
        raise ValueError(f"unknown form {form!r}")
    return prefix + middle + suffix


_CACHE = Chunks()  # a worker process keeps its cache over tasks

FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars
    (code points; NULL if plain), output``.

    A NULL or empty text is plain with an empty output; so is a text that holds a marker, with the text
    as output. The cuts depend on the id and the number of code points alone, so rows with equal ids and
    texts are equal and a NULL id cuts like the text ``null``; an empty table gives no rows; texts are
    processed whole, whatever their length, one at a time; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_run, f"doc_id {kind}, {FIELDS}")


def _parts(batches):
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def _run(batches):
    for b in _parts(batches):
        done = [transform(i, raw.as_py(), _CACHE) for i, raw in zip(b.column(0).to_pylist(), b.column(1))]
        n, form, prefix, middle, output = zip(*done) if done else ((),) * 5
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
            pa.array(output, pa.binary()).cast(pa.string()),
        ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(out: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with ``restored``, the text rebuilt from output and form."""
    extra = "restored string"

    def run(batches):
        for b in _parts(batches):
            at = {name: b.schema.get_field_index(name) for name in ("output", "form")}
            texts = [restore(o.as_py().encode(), f) for o, f in zip(b.column(at["output"]), b.column(at["form"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*b.schema.names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(run, f"{fields}, {extra}")
