"""Spelling variants: words one edit apart, grouped under their most frequent neighbour.

Two words are near if one inserted, deleted or replaced code point parts them. With a common prefix
of p code points, a common suffix of s and a longer length of m, that is p + s >= m - 1, and p is the
place of the edit. Near words with their edit in a region [lo, hi) of the longer one share its first
lo and its last m - hi code points. So each word is keyed, as the longer and as the shorter of a pair,
by what lies outside a region, first the two halves; words of equal keys meet. A key that more than
``GROUP`` words share is split into the halves of its region, which adds to the known prefix or suffix,
until the groups are small: a region of one code point leaves no more words than there are letters.
A pair meets in one group only, that of the region its edit lies in.

Groups are laid out as padded code-point matrices, once from the left and once from the right, and
cut into blocks of ``BLOCK`` rows. Pairs of blocks that share a group are compared densely, code point
by code point, for the lengths of common prefix and suffix. A task returns no pairs: a row per word
with the number of near words and the best of them.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envlab.llm.common import store

LETTERS = "A-Za-zÀ-ÿ"
MIN_CHARS = 7
MIN_N = 2
RATIO = 10  # a form occurs at least so many times as often
GROUP = 256  # words of a key that are compared as they are
BLOCK = 64  # rows of a matrix block
TILES = 512  # pairs of blocks compared at once
MEMO_WORDS = 150_000  # distinct words a task counts before it hands them on
SLICE_WORDS = 100_000  # words of groups that a task lays out at once


def misspelt(word: str, crc: int, noise: int) -> str:
    """``word`` without its code point ``h % length`` if ``noise`` divides h, the word's crc32 continued
    from ``crc``."""
    h = zlib.crc32(word.encode(), crc)
    if h % noise:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_n: int = MIN_N, noise: int | None = None, letters: str = LETTERS) -> DataFrame:
    """Stored (word, n) of all words of at least ``min_chars`` code points and ``min_n`` occurrences.
    A word is a maximal run of ``letters`` (inside of a regular expression's class), A-Z lowered; with
    ``noise``, one in so many distinct words of a document is misspelt all over it, by the hash of
    ``<doc_id>:<word>``."""
    find = re.compile(f"[{letters}]{{{max(min_chars, 1)},}}").findall

    def count(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                # as bytes, lower() takes A-Z only
                words = Counter(find(text.encode().lower().decode()))
                if noise:
                    crc = zlib.crc32(f"{'null' if i is None else i}:".encode())
                    for w, n in words.items():
                        w = misspelt(w, crc, noise)
                        if len(w) >= min_chars:
                            seen[w] += n
                else:
                    seen.update(words)
                if len(seen) > MEMO_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return store(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n), "spelling-words")


def _cut(rows: DataFrame, regions) -> DataFrame:
    """(m, lo, hi, part, word, n) of ``rows`` (word, n and what ``regions`` reads): one row per region,
    a struct of m, lo and hi."""
    size = F.char_length("word")
    return rows.select("word", "n", F.explode(F.array(*regions)).alias("r")).select(
        "r.*", F.xxhash64(
            F.substring("word", F.lit(1), F.col("r.lo")),
            F.substring("word", size - (F.col("r.m") - F.col("r.hi")) + 1, F.col("r.m") - F.col("r.hi")),
        ).alias("part"), "word", "n",
    )


def _region(m, lo, hi):
    return F.struct(m.cast("int").alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _halves(m, lo, hi):
    mid = F.floor((lo + hi) / 2)
    return [_region(m, lo, mid), _region(m, mid, hi)]


KEY = ["m", "lo", "hi", "part"]


def groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(m, lo, hi, words array<struct<word, n>>): groups of at least two and, but for regions of one
    code point, at most ``most`` words; every two near words meet in that of their edit's place."""
    size, zero = F.char_length("word"), F.lit(0)
    rows = _cut(words, [*_halves(size, zero, size), *_halves(size + 1, zero, size + 1)])
    ready = None
    while True:
        full = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > most) & (F.col("hi") - F.col("lo") > 1))
        full = store(full.select(*KEY), "spelling-full")
        if full.isEmpty():
            part = rows
        else:
            part = rows.join(full, KEY, "left_anti")
        ready = part if ready is None else ready.unionByName(part)
        if part is rows:
            break
        again = rows.join(full, KEY, "left_semi").select("word", "n", "m", "lo", "hi")
        rows = store(_cut(again, _halves(F.col("m"), F.col("lo"), F.col("hi"))), "spelling-keys")
    return ready.groupBy(*KEY).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1).drop("part")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes of all rows of a[t] with all rows of b[t]; both (tiles, rows, m)."""
    t, r, m = a.shape
    same = np.ones((t, r, b.shape[1]), dtype=bool)
    out = np.zeros(same.shape, dtype=np.uint8 if m < 255 else np.int32)
    for j in range(m):
        same &= a[:, :, None, j] == b[:, None, :, j]
        if not same.any():
            break
        out += same
    return out


def near_pairs(words: list[str], group: np.ndarray, m: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of the near words of equal ``group`` (numbers in order) whose edit lies in
    the region [lo, hi) of the group. ``words`` have m or m - 1 code points, one of a pair has m."""
    n = len(words)
    rows = -(-n // BLOCK) * BLOCK
    size = np.zeros(rows, dtype=np.int64)
    size[:n] = [len(w) for w in words]
    gid = np.full(rows, -1, dtype=np.int64)
    gid[:n] = group

    def matrix(texts: list[str]) -> np.ndarray:
        codes = np.zeros((rows, m), dtype=np.uint32)
        codes[:n] = np.array(texts, dtype=f"<U{m}").view(np.uint32).reshape(n, m)
        return (codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes).reshape(-1, BLOCK, m)

    left, right = matrix(words), matrix([w[::-1] for w in words])
    g, s = gid.reshape(-1, BLOCK), size.reshape(-1, BLOCK)
    last = np.where(g >= 0, g, -1).max(axis=1)
    found, blocks, apart = [], len(g), 0
    while True:
        one = np.arange(blocks - apart)
        one = one[g[one + apart, 0] == last[one]] if apart else one
        if not len(one):
            break
        for at in range(0, len(one), TILES):
            x = one[at:at + TILES]
            y = x + apart
            p = _shared(left[x], left[y])
            q = _shared(right[x], right[y])
            near = p.astype(np.int32) + q >= m - 1
            near &= (g[x][:, :, None] == g[y][:, None, :]) & (g[x] >= 0)[:, :, None]
            near &= np.maximum(s[x][:, :, None], s[y][:, None, :]) == m
            if not apart:
                near &= np.triu(np.ones((BLOCK, BLOCK), dtype=bool), 1)
            t, i, j = np.nonzero(near)
            i0, j0, edit = x[t] * BLOCK + i, y[t] * BLOCK + j, p[t, i, j]
            inside = (edit >= lo[i0]) & (edit < hi[i0])
            found.append((i0[inside], j0[inside]))
        apart += 1
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _slices(batch: pa.RecordBatch, most: int):
    """``batch`` cut into runs of whole groups that hold at most ``most`` words in all, or one group."""
    ends = np.cumsum(np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        to = max(int(np.searchsorted(ends, before + most, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at, before = to, ends[to - 1]


def _compare(batches):
    """Per word of a batch of groups: near words met there and the best of them (most frequent, then
    first in code-point order)."""
    for b in (part for whole in batches for part in _slices(whole, SLICE_WORDS)):
        m, lo, hi = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        lists = b.column(3)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        texts, counts = np.array(flat.field(0).to_pylist(), dtype=object), flat.field(1).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(m)), sizes)
        rank = np.empty(len(texts), dtype=np.int64)
        order = np.array(sorted(range(len(texts)), key=lambda k: (-counts[k], texts[k])), dtype=np.int64)
        rank[order] = np.arange(len(order))
        near, best = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), len(texts), dtype=np.int64)
        for length in np.unique(m):
            at = np.flatnonzero(m[of] == length)
            i, j = near_pairs(texts[at].tolist(), of[at], int(length), lo[of[at]], hi[of[at]])
            i, j = at[i], at[j]
            near += np.bincount(i, minlength=len(near)) + np.bincount(j, minlength=len(near))
            np.minimum.at(best, i, rank[j])
            np.minimum.at(best, j, rank[i])
        has = np.flatnonzero(near)
        top = order[best[has]]
        yield pa.RecordBatch.from_arrays([
            pa.array(texts[has], pa.string()), pa.array(near[has]), pa.array(counts[top], pa.int64()), pa.array(texts[top], pa.string()),
        ], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n; distinct) that have near words: their number
    and the most frequent, ties to the first in code-point order."""
    met = groups(words, most).select("m", "lo", "hi", "words").mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n")
    )


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of ``forms`` (word, form), which have no cycle and no path of over ``longest``
    steps: the end of each path, found by doubling the steps taken."""
    path = forms.select("word", F.col("form").alias("root"))
    done = 1
    while done < longest:
        ahead = path.select(F.col("word").alias("root"), F.col("root").alias("next"))
        path = store(path.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        done *= 2
    return path


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_n: int = MIN_N, ratio: int = RATIO, noise: int | None = None, most: int = GROUP) -> DataFrame:
    """One row per word of ``word_counts(docs)``: ``word, n, n_near`` (number of near words), ``form``
    (its most frequent near word, the first in code-point order of equals, if that occurs ``ratio``
    times as often or more; else NULL), ``form_n`` (the form's n or NULL) and ``root`` (the end of the
    path of forms; the word itself without a form).

    NULL and empty texts have no words; a NULL doc_id counts as the text ``null`` in the hash of
    ``noise``; repeated rows count each; an empty table gives no rows; other columns are ignored.
    ``ratio`` is at least 2, so a path of forms ends."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = word_counts(docs, min_chars, min_n, noise)
    near = near_words(words, most)
    is_form = F.col("best_n") >= ratio * F.col("n")
    out = store(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "spelling-forms")
    # a form occurs ratio times as often, so a path is short
    top = words.agg(F.max("n")).first()[0] or 1
    longest = int(math.log(max(top / max(min_n, 1), 1), ratio) + 1e-9) + 1
    ends = roots(out.where("form IS NOT NULL").select("word", "form"), longest)
    return out.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
