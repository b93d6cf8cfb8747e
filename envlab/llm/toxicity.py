"""Toxic spans by a linear-chain conditional random field.

Tokens have label 1 (toxic) or 0. A token's score for label 1 adds weights of its features: the
word, its first four and five letters, and the first four letters of both neighbours (hashed);
two-by-two transition scores join neighbours. Forward-backward gives each token's marginal. In odds
form one step of either pass is a fraction of two linear terms, so a batch of documents advances
together, token by token, without logarithms or overflow.

Training: documents are labelled as wholes, tokens are not, so tokens of a toxic training document
are labelled 1 where their word or prefix marks toxic documents (smoothed log-odds over the sample),
all others 0. The field is fitted by Adam on the penalised likelihood, and a document's score is a
logistic function of its marginals (largest, and expected number of toxic tokens), fitted on the
same rows. The sample holds at most ``SAMPLE`` labelled rows of either class, the first by a hash of
the id; everything else covers all rows and whole texts.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 1500
SAMPLE_BYTES = 64 << 20  # bytes of text that training reads on the driver
BUCKETS = 1 << 18
CHUNK = 256  # training sequences are cut to this many tokens
PASSES = 25
MIN_DOCS = 5  # a mark occurs in this many toxic rows of the sample ...
MIN_SHARE = 0.02  # ... and this share of them, so that a few copies of one text make none
MIN_ODDS = 3.0
SPAN = 0.5
MEMO = 500_000
CELLS = 1 << 22  # tokens (with padding) scored at a time
WORD = re.compile(r"[^\W\d_]+")


def features(word: str, lexicon: frozenset[str]) -> tuple[int, int, int, int, int]:
    """Hashed features of a token: word, four and five letters, and its four letters as the left
    and as the right neighbour of another token. A word of the lexicon stands for itself only: what
    it shows is no evidence on other words that begin alike."""
    h = lambda kind, s: xxhash.xxh64_intdigest(kind + s, 7) % BUCKETS
    four, five = (word + "!", word + "!") if word in lexicon else (word[:4], word[:5])
    return h("w", word), h("4", four), h("5", five), h("l", four), h("r", four)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Model:
    """``weights`` by hashed feature, ``bias``, transition scores ``trans[from, to]`` and the
    logistic (intercept, of the largest marginal, of log(1 + expected toxic tokens)); ``lexicon`` has
    the words that mark toxic documents by themselves."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    logistic: np.ndarray
    lexicon: frozenset[str] = frozenset()
    memo: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def _look(self, words: list[str]) -> np.ndarray:
        """(3, n): own score, and what the word adds to its right and left neighbours."""
        memo = self.memo
        got = list(map(memo.get, words))
        if None in got:
            if len(memo) > MEMO:
                memo.clear()
            w = self.weights
            for k, x in enumerate(got):
                if x is None:
                    word = words[k]
                    x = memo.get(word)
                    if x is None:
                        a, b, c, d, e = features(word, self.lexicon)
                        x = memo[word] = (float(w[a] + w[b] + w[c]), float(w[d]), float(w[e]))
                    got[k] = x
        return np.array(got, dtype=np.float64).reshape(-1, 3).T

    def emissions(self, words: list[str]) -> np.ndarray:
        own, to_right, to_left = self._look(words)
        out = own + self.bias
        out[1:] += to_right[:-1]
        out[:-1] += to_left[1:]
        return out

    def marginals(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Each token's probability of label 1. Sequences of like length advance together."""
        out: list = [None] * len(scores)
        order = sorted((k for k in range(len(scores)) if len(scores[k])), key=lambda k: len(scores[k]))
        for k in range(len(scores)):
            if not len(scores[k]):
                out[k] = np.zeros(0)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(scores[order[end]]) * (end + 1 - at) <= CELLS and (
                len(scores[order[end]]) <= 64 + 1.5 * len(scores[order[at]])
            ):
                end += 1
            group = order[at:end]
            for k, p in zip(group, chain_marginals([scores[k] for k in group], self.trans)[0]):
                out[k] = p
            at = end
        return out

    def score(self, marginals: np.ndarray) -> float:
        top = float(marginals.max()) if len(marginals) else 0.0
        z = self.logistic @ np.array([1.0, top, np.log1p(marginals.sum() if len(marginals) else 0.0)])
        return float(1.0 / (1.0 + np.exp(-z)))


def chain_marginals(scores: list[np.ndarray], trans: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Marginals of sequences padded to a common length, and the expected transition counts."""
    a = np.exp(trans - trans[0, 0])
    n, t = len(scores), max(map(len, scores))
    e = np.ones((t, n))
    for k, s in enumerate(scores):
        e[: len(s), k] = np.exp(np.clip(s, -40, 40))
    length = np.array([len(s) for s in scores])
    fwd, bwd = np.empty((t, n)), np.ones((t, n))
    fwd[0] = o = e[0]
    for i in range(1, t):  # odds of label 1 given the tokens so far
        o = e[i] * (a[0, 1] + o * a[1, 1]) / (a[0, 0] + o * a[1, 0])
        fwd[i] = o
    b = np.ones(n)
    for i in range(t - 2, -1, -1):  # odds the later tokens add; 1 at and after the end
        x = e[i + 1] * b
        b = np.where(i + 1 < length, (a[1, 0] + x * a[1, 1]) / (a[0, 0] + x * a[0, 1]), 1.0)
        bwd[i] = b
    odds = fwd * bwd
    p = odds / (1.0 + odds)
    # pair (i, i+1) is proportional to fwd_i^y * a[y, z] * (e * bwd)_{i+1}^z
    f, g = fwd[:-1], e[1:] * bwd[1:]
    real = np.arange(1, t)[:, None] < length[None, :]
    whole = a[0, 0] + g * a[0, 1] + f * (a[1, 0] + g * a[1, 1])
    share = np.where(real, 1.0 / whole, 0.0)
    fs, gs = f * share, g * share
    parts = np.array([[share.sum() * a[0, 0], gs.sum() * a[0, 1]], [fs.sum() * a[1, 0], (fs * g).sum() * a[1, 1]]])
    return [p[: len(s), k] for k, s in enumerate(scores)], parts


def weak_labels(docs: list[np.ndarray], words: list[str], toxic: np.ndarray) -> tuple[list[np.ndarray], frozenset[str]]:
    """Token labels from document labels, and the lexicon. ``docs`` hold places in ``words``. A
    token is 1 in a toxic document if its word marks toxic documents in the sample, or if the first
    four or five letters do, counted over words that are no marks themselves. Equal documents
    count once."""
    once = list({d.tobytes(): k for k, d in enumerate(docs)}.values())
    n1 = max(1, int(toxic[once].sum()))
    n0 = max(1, len(once) - n1)

    def marks(table: np.ndarray, n: int) -> np.ndarray:
        """Which of n features mark toxic documents; ``table`` has each word's features or -1."""
        seen = np.zeros((2, n))
        for k in once:
            found = np.unique(table[docs[k]])
            seen[int(toxic[k]), found[found >= 0]] += 1
        odds = np.log((seen[1] + 0.5) / n1) - np.log((seen[0] + 0.5) / n0)
        return (seen[1] >= max(MIN_DOCS, MIN_SHARE * n1)) & (odds >= MIN_ODDS)

    own = marks(np.arange(len(words))[:, None], len(words))
    number: dict[str, int] = {}
    heads = np.full((len(words), 2), -1, dtype=np.int64)
    for k, w in enumerate(words):
        for j, length in enumerate((4, 5)):
            if len(w) > length and not own[k]:
                heads[k, j] = number.setdefault(w[:length], len(number))
    stems = np.append(marks(heads, len(number)), False)  # -1: none
    shows = own | stems[heads].any(axis=1)
    return [(shows[d] & y).astype(np.float64) for d, y in zip(docs, toxic.tolist())], frozenset(
        words[k] for k in np.flatnonzero(own)
    )


def train(texts: list[str | None], toxic: list[int], passes: int = PASSES) -> Model:
    """Fit the field and the logistic. Without rows of both classes every score is the share of
    toxic rows (0 without any row)."""
    y = np.array(toxic, dtype=bool)
    model = Model(np.zeros(BUCKETS), 0.0, np.zeros((2, 2)), np.zeros(3))
    if not y.any() or y.all():
        model.logistic[0] = 40.0 if len(y) and y.all() else -40.0
        return model
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in tokens(t)], dtype=np.int64) for t in texts]
    gold, model.lexicon = weak_labels(docs, list(vocab), y)
    table = np.array([features(w, model.lexicon) for w in vocab], dtype=np.int64).reshape(-1, 5)
    cut = [(k, i) for k, d in enumerate(docs) for i in range(0, len(d), CHUNK)]
    seqs = [docs[k][i:i + CHUNK] for k, i in cut]
    want = [gold[k][i:i + CHUNK] for k, i in cut]
    flat, target = np.concatenate(seqs), np.concatenate(want)
    edges = np.cumsum([0, *map(len, seqs)])
    first, last = edges[:-1], edges[1:] - 1
    seen = np.zeros((2, 2))
    for s in want:
        z = s.astype(int)
        np.add.at(seen, (z[:-1], z[1:]), 1)
    size = len(target)
    params = np.zeros(BUCKETS + 1 + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    gold_counts = np.zeros_like(params)

    def spread(values: np.ndarray) -> np.ndarray:
        """Sums of a token value over the features of its token and its neighbours."""
        left, right = values.copy(), values.copy()
        own = np.bincount(flat, weights=values, minlength=len(vocab))
        left[first] = 0.0  # a sequence's first token has no left neighbour
        right[last] = 0.0
        by_left = np.bincount(flat[:-1], weights=left[1:], minlength=len(vocab))
        by_right = np.bincount(flat[1:], weights=right[:-1], minlength=len(vocab))
        out = np.zeros(BUCKETS + 1)
        for col, w in ((0, own), (1, own), (2, own), (3, by_left), (4, by_right)):
            out[:BUCKETS] += np.bincount(table[:, col], weights=w, minlength=BUCKETS)
        out[BUCKETS] = values.sum()
        return out

    gold_counts[: BUCKETS + 1], gold_counts[BUCKETS + 1:] = spread(target), seen.ravel()
    params[BUCKETS] = -3.0

    def field_marginals() -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, and the expected transition counts, at ``params``."""
        w = params[:BUCKETS]
        own, to_right, to_left = w[table[:, 0]] + w[table[:, 1]] + w[table[:, 2]], w[table[:, 3]], w[table[:, 4]]
        score = own[flat] + params[BUCKETS]
        add = to_right[flat[:-1]]
        add[first[1:] - 1] = 0.0
        score[1:] += add
        add = to_left[flat[1:]]
        add[last[:-1]] = 0.0
        score[:-1] += add
        trans, out, pairs = params[BUCKETS + 1:].reshape(2, 2), [], np.zeros((2, 2))
        for k in range(0, len(seqs), 1024):
            p, more = chain_marginals([score[a:b] for a, b in zip(edges[k:k + 1024], edges[k + 1:k + 1025])], trans)
            out += p
            pairs += more
        return np.concatenate(out), pairs

    for step in range(1, passes + 1):
        p, pairs = field_marginals()
        grad = np.concatenate([spread(p), pairs.ravel()]) - gold_counts
        grad = grad / size * 1000 + 2e-4 * params
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        params = params - 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    model.weights, model.bias, model.trans = params[:BUCKETS].copy(), float(params[BUCKETS]), params[BUCKETS + 1:].reshape(2, 2).copy()
    p = field_marginals()[0]
    ends = np.cumsum([0, *map(len, docs)])
    x = np.array([[1.0, q.max() if len(q) else 0.0, np.log1p(q.sum())] for q in (p[a:b] for a, b in zip(ends, ends[1:]))])
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-x @ beta))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.eye(3) * 0.5
        beta = beta + np.linalg.solve(h, x.T @ (y - q) - 0.5 * beta)
    model.logistic = beta
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 modulo 3 (a NULL id is not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on at most ``sample`` labelled rows of either class that are not held out, and at most
    ``sample_bytes`` bytes of text of them, in the order of a hash of the id. Rows with a NULL label or id or
    an empty text teach nothing; a doc_id labelled twice counts with its larger label. Without labelled rows
    all scores are near 0."""
    by_id = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id"
    ).agg(F.max("toxic").alias("__toxic"))
    picked = None
    for k in (0, 1):
        some = by_id.where(F.col("__toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.union(some)
    # at most 2 * sample rows of two numbers
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("bytes", F.octet_length("text"))
    sizes = rows.select("doc_id", "bytes").orderBy(*order).limit(2 * sample).collect()
    ids, size = [], 0
    for i, n in sizes:
        size += n or 0
        if size > sample_bytes and ids:
            break
        ids.append(i)
    held = docs.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], docs.select("doc_id").schema)
    got = rows.join(F.broadcast(held), "doc_id").orderBy(*order).limit(2 * sample).select("text", "__toxic").collect()
    return train([r[0] for r in got], [r[1] for r in got])


def _marginals(texts: list, model: Model):
    """(text, marginals) of each text, in bounded groups."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < 4_000_000):
            size += len(texts[end] or "")
            end += 1
        yield from zip(texts[at:end], model.marginals([model.emissions(tokens(t)) for t in texts[at:end]]))
        at = end


def _shared(docs: DataFrame, model: Model):
    """The model as a broadcast variable: BUCKETS weights (one megabyte) and the lexicon."""
    small = Model(model.weights.astype(np.float32), model.bias, model.trans, model.logistic, model.lexicon)
    return docs.sparkSession.sparkContext.broadcast(small)


OUT = "score double, spans array<struct<start:int,end:int,p:double>>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, score double, spans`` — runs of tokens whose marginal is at
    least SPAN, as code-point offsets with the run's largest marginal. A NULL, empty or wordless
    text has no marginals and the score of the logistic at zero; equal texts get equal scores, repeated rows
    are kept; an empty table gives no rows; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = _shared(docs, model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        model = shared.value
        for b in batches:
            scores, spans = [], []
            for text, p in _marginals(b.column(1).to_pylist(), model):
                scores.append(model.score(p))
                spans.append(toxic_spans(text, p) if len(p) and p.max() >= SPAN else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array(spans, span_type)], names=["doc_id", "score", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {OUT}")


def keep_clean(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``. Rows are
    decided where they are scanned; nothing is shuffled."""
    shared = _shared(docs, model)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for b in batches:
            keep = [model.score(p) < threshold for _, p in _marginals(b.column(at).to_pylist(), model)]
            yield b.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def toxic_spans(text: str | None, p: np.ndarray) -> list[dict]:
    """Runs of neighbouring tokens with a marginal of SPAN or more. Lower-casing can change a
    text's length only for a few characters, so offsets are taken from the text itself where the
    tokens agree, and else from the lowered text."""
    text = text or ""
    found = list(WORD.finditer(text))
    if len(found) != len(p):
        found = list(WORD.finditer(text.lower()))
    out, before = [], -2
    for k in np.flatnonzero(p >= SPAN).tolist():
        w = found[k]
        if k == before + 1:
            out[-1]["end"], out[-1]["p"] = w.end(), max(out[-1]["p"], float(p[k]))
        else:
            out.append({"start": w.start(), "end": w.end(), "p": float(p[k])})
        before = k
    return out
