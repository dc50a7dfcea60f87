"""Toxic spans by a linear-chain conditional random field; its marginals add up to document scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.llm.common import doc_key

#: Tokens per piece of a text; the chain is exact across pieces.
PIECE = 64
#: Documents whose chains a task computes at a time.
AT_ONCE = 128
#: Marginal from which a token is part of a span.
OFFENDING = 0.5
#: Characters taken off a token's ends.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…¿¡"
TOKEN = re.compile(r"\S+")


@dataclass(frozen=True)
class Params:
    """`rows` bounds the labelled rows of each class learned from, `tokens` their words in all, `cache` the words a task remembers.

    One row in `holdout` fits the document score instead of the field.
    """
    buckets: int = 1 << 18
    longest: int = 8
    rows: int = 3000
    tokens: int = 1_000_000
    holdout: int = 4
    rounds: int = 2
    steps: int = 30
    rate: float = 0.3
    l2: float = 2e-6
    cache: int = 400_000


def features(token: str, p: Params) -> list[int]:
    """Buckets of a token: the word, its beginnings and its ends in bytes, and last two that its neighbours see: as word before and after."""
    b = token.lower().strip(EDGES)[:64].encode()
    n, crc = len(b), zlib.crc32                              # the start value keeps kinds apart
    out = [crc(b, 1)]
    out += [crc(b[:k], 2) for k in range(2, min(p.longest, n) + 1)]
    out += [crc(b[-k:], 3) for k in range(2, min(5, n) + 1)]
    out += crc(b, 4), crc(b, 5)
    return [x % p.buckets for x in out]


@dataclass(frozen=True)
class Field:
    """Weights of features, bias of the toxic state, log weights of transitions, and the document score's three numbers."""
    weights: np.ndarray
    bias: float
    steps: np.ndarray
    score: np.ndarray


class Pieces:
    """Places of the tokens of sequences in a matrix of `PIECE` steps, one column a piece, full columns first.

    `at`: step and column of every token. `live[t]`: columns that reach step t.
    `column`: columns of the pieces in their order, `count`: pieces of each sequence.
    """

    def __init__(self, sizes: np.ndarray):
        self.count = -(-sizes // PIECE)
        n = int(self.count.sum())
        first = np.cumsum(self.count) - self.count
        length = np.full(n, PIECE)
        last = (first + self.count - 1)[sizes > 0]
        length[last] = (sizes - (self.count - 1) * PIECE)[sizes > 0]
        order = np.argsort(-length, kind="stable")
        self.column = np.empty(n, dtype=np.int64)
        self.column[order] = np.arange(n)
        place = np.arange(int(sizes.sum())) + np.repeat(first * PIECE - (np.cumsum(sizes) - sizes), sizes)
        self.at = place % PIECE, self.column[place // PIECE]
        self.live = np.searchsorted(-length[order], -np.arange(PIECE), side="left")
        self.first = first

    def entering(self, f: np.ndarray, forward: bool) -> np.ndarray:
        """Ratio toxic to clean that enters each column, by the columns' products `f`: one step per piece of the longest sequence."""
        out = np.zeros(f.shape[2])
        now = np.full(len(self.count), 0.0 if forward else 1.0)
        for j in range(int(self.count.max(initial=0))):
            live = np.flatnonzero(self.count > j)
            c = self.column[self.first[live] + (j if forward else self.count[live] - 1 - j)]
            out[c] = now[live]
            m = f[:, :, c] if forward else f[:, :, c].transpose(1, 0, 2)
            now[live] = (m[1, 0] + m[1, 1] * now[live]) / (m[0, 0] + m[0, 1] * now[live])
        return out


def marginals(logits: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token of the concatenated sequences, and expected transitions (2 x 2) in all; exact for any length.

    Forward-backward on ratios of the two states, in three sweeps: the product of
    each piece's matrices, then the ratios that enter the pieces, then both
    directions within all pieces at once. Before a sequence the state is clean.
    """
    if not len(logits):
        return np.zeros(0), np.zeros((2, 2))
    at = Pieces(sizes)
    n = len(at.column)
    a = np.exp(steps)                                        # a[i, j]: from i to j
    e = np.ones((PIECE, n))
    e[at.at] = np.exp(np.clip(logits, -30, 30))
    f = np.zeros((2, 2, n))
    f[0, 0] = f[1, 1] = 1.0
    for t, k in enumerate(at.live):
        x, y = f[0, :, :k].copy(), f[1, :, :k]
        f[0, :, :k] = a[0, 0] * x + a[1, 0] * y
        f[1, :, :k] = (a[0, 1] * x + a[1, 1] * y) * e[t, :k]
        if t % 4 == 3:
            f[:, :, :k] /= f[:, :, :k].max((0, 1))
    r, s = at.entering(f, True), at.entering(f, False)
    before, alpha, beta = np.empty((PIECE, n)), np.empty((PIECE, n)), np.empty((PIECE, n))
    for t, k in enumerate(at.live):
        before[t, :k] = r[:k]
        r[:k] = alpha[t, :k] = (a[0, 1] + a[1, 1] * r[:k]) / (a[0, 0] + a[1, 0] * r[:k]) * e[t, :k]
        t, k = PIECE - 1 - t, at.live[PIECE - 1 - t]
        beta[t, :k] = s[:k]
        z = e[t, :k] * s[:k]
        s[:k] = (a[1, 0] + a[1, 1] * z) / (a[0, 0] + a[0, 1] * z)
    r, z = before[at.at], e[at.at] * beta[at.at]
    odds = alpha[at.at] * beta[at.at]
    w = np.array([[np.ones(len(r)), z], [r, r * z]]) * a[:, :, None]
    return odds / (1 + odds), (w / w.sum((0, 1))).sum(2)


class Words(dict):
    """Tokens to numbers; `own`, `left` and `right` are what a token adds to itself, to the next and to the one before."""

    def __init__(self, weights: np.ndarray, p: Params):
        super().__init__()
        self.weight, self.p = weights.tolist(), p
        self.part = np.zeros((1 << 16, 3))

    def __missing__(self, token: str) -> int:
        *f, left, right = map(self.weight.__getitem__, features(token, self.p))
        i = len(self)
        if i == len(self.part):
            self.part = np.concatenate([self.part, np.zeros_like(self.part)])
        self.part[i] = sum(f), left, right
        self[token] = i
        return i

    def logits(self, texts: list[list[str]], bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all tokens of `texts`, one after the other, and the texts' sizes."""
        if len(self) > self.p.cache:
            self.clear()
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ids = np.fromiter((i for t in texts for i in map(self.__getitem__, t)), dtype=np.int64, count=int(sizes.sum()))
        return chained(self.part[ids], sizes) + bias, sizes


def chained(parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own parts, plus those of the neighbours within a sequence."""
    out = parts[:, 0].copy()
    inner = np.ones(len(parts), dtype=bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    at = np.flatnonzero(inner)
    out[at] += parts[at - 1, 1]
    out[at - 1] += parts[at, 2]
    return out


def evidence(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per sequence its inputs of the document score: log of the soft count of toxic tokens, and log of the size."""
    soft = -np.log1p(-np.minimum(p, 1 - 1e-6))
    start = np.cumsum(sizes) - sizes
    total = np.add.reduceat(np.append(soft, 0.0), np.minimum(start, len(soft))) if len(sizes) else np.zeros(0)
    return np.column_stack([np.log(np.where(sizes > 0, total, 0.0) + 1e-3), np.log1p(sizes), np.ones(len(sizes))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def held_out(doc_id: Column) -> Column:
    """Fold of a doc_id: true where crc32 of its text form leaves 1 modulo 3; a null doc_id is false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: Params) -> list:
    """(doc_id, toxic, text) of labelled documents outside the held-out fold: of each class the `rows` of the smallest hash, as far as `tokens` words go."""
    lab = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = lab.filter("toxic = 1").orderBy(*order).limit(p.rows).union(lab.filter("toxic = 0").orderBy(*order).limit(p.rows))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))     # at most 2 * `rows` rows
    words = F.sum(F.length("text") / 4).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return one.withColumn("words", words).filter(F.col("words") <= p.tokens * 2).orderBy("doc_id").drop("words").collect()


def without_copies(rows: list) -> list:
    """Rows whose texts share none of four least shingle hashes with one before: copies would make any of their words look toxic."""
    seen, out = set(), []
    for r in rows:
        w = r.text.lower().split()
        h = np.array([zlib.crc32(" ".join(w[i:i + 3]).encode()) for i in range(max(1, len(w) - 2))], dtype=np.uint64)
        keys = {(m, int((h * np.uint64(m) % np.uint64(4294967291)).min())) for m in (1, 2654435761, 40503, 69069)}
        if not keys & seen:
            out.append(r)
        seen |= keys
    return out


def seeds(doc: np.ndarray, word: np.ndarray, toxic: np.ndarray, bags: list[np.ndarray], p: Params) -> np.ndarray:
    """Words that mark toxic documents: some feature is found there too often to be chance among as many features as there are."""
    pairs = np.unique(doc.astype(np.int64) * len(bags) + word)
    d, w = pairs // len(bags), pairs % len(bags)
    size = np.array([len(b) for b in bags])
    f = np.concatenate(bags)[np.repeat(np.cumsum(size)[w] - np.cumsum(size[w]), size[w]) + np.arange(size[w].sum())] if len(w) else np.zeros(0, np.int64)
    pairs = np.unique(np.repeat(d, size[w]) * p.buckets + f)
    d, f = pairs // p.buckets, pairs % p.buckets
    a = np.bincount(f[toxic[d] == 1], minlength=p.buckets).astype(float)
    b = np.bincount(f[toxic[d] == 0], minlength=p.buckets).astype(float)
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)

    def ll(k, n, q):
        return k * np.log(np.maximum(q, 1e-300)) + (n - k) * np.log(np.maximum(1 - q, 1e-300))

    q = (a + b) / (n1 + n0)
    g = 2 * (ll(a, n1, a / n1) + ll(b, n0, b / n0) - ll(a, n1, q) - ll(b, n0, q))
    strong = (g > 2 * np.log(max((a + b > 0).sum(), 2))) & ((a + 0.5) / (n1 + 1) > 20 * (b + 0.5) / (n0 + 1))
    return np.array([strong[x].any() for x in bags], dtype=bool)


def trained(texts: list[list[str]], toxic: np.ndarray, p: Params) -> Field:
    """A field for token labels that the documents' labels give: seeds in toxic documents first, then what the field itself finds there.

    Full gradients of the log likelihood by forward-backward, adaptive steps.
    """
    number: dict[str, int] = {}
    word = np.array([number.setdefault(t, len(number)) for x in texts for t in x], dtype=np.int64)
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    bags = [np.array(features(t, p), dtype=np.int64) for t in number]
    size = np.array([len(b) - 2 for b in bags])
    flat, owner = np.concatenate([b[:-2] for b in bags]), np.repeat(np.arange(len(bags)), size)
    left, right = np.array([b[-2] for b in bags]), np.array([b[-1] for b in bags])
    y = seeds(doc, word, toxic, [b[:-2] for b in bags], p)[word] & (toxic[doc] == 1)
    weights, bias, steps = np.zeros(p.buckets), -4.0, np.array([[0.0, 0.0], [0.0, 0.0]])
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    inner = np.ones(len(word), dtype=bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    for _ in range(p.rounds):
        seen, seen_b, seen_s = np.full(p.buckets, 1e-8), 1e-8, np.full((2, 2), 1e-8)
        before = np.where(np.isin(np.arange(len(y)), first), 0, np.append(0, y[:-1]))
        have = np.zeros((2, 2))
        np.add.at(have, (before, y.astype(np.int64)), 1)
        for _ in range(p.steps):
            own = np.bincount(owner, weights[flat], len(bags))
            parts = np.column_stack([own, weights[left], weights[right]])[word]
            prob, pairs = marginals(chained(parts, sizes) + bias, sizes, steps)
            miss = y - prob
            per = np.bincount(word, miss, len(bags))
            g = np.bincount(flat, per[owner], p.buckets)
            g += np.bincount(left[word[inner - 1]], miss[inner], p.buckets) + np.bincount(right[word[inner]], miss[inner - 1], p.buckets)
            g -= p.l2 * len(word) * weights
            gs = have - pairs
            seen += g * g
            seen_b += miss.sum() ** 2
            seen_s += gs * gs
            weights = weights + p.rate * g / np.sqrt(seen)
            bias += p.rate * miss.sum() / seen_b ** 0.5
            steps = steps + p.rate * gs / np.sqrt(seen_s)
        y = (prob >= OFFENDING) & (toxic[doc] == 1)
    return Field(weights, bias, steps, np.array([1.0, 0.0, 0.0]))


def calibrated(field: Field, texts: list[list[str]], toxic: np.ndarray, p: Params) -> Field:
    """The field with a document score: logistic regression of labels on `evidence`, on documents the field did not learn from."""
    logits, sizes = Words(field.weights, p).logits(texts, field.bias)
    x = evidence(marginals(logits, sizes, field.steps)[0], sizes)
    theta = np.zeros(3)
    for _ in range(50):                                      # Newton steps with a small penalty
        q = sigmoid(x @ theta)
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([0.05, 0.05, 0.01])
        theta = theta + np.linalg.solve(h, x.T @ (toxic - q) - np.array([0.05, 0.05, 0.01]) * theta)
    theta[0] = max(theta[0], 0.0)                            # more toxic tokens never lower a score
    return Field(field.weights, field.bias, field.steps, theta)


def fit(docs: DataFrame, labels: DataFrame, p: Params) -> Field | None:
    """The field learned from a bounded sample of labelled rows; None where they hold a single class."""
    rows = without_copies(training_rows(docs, labels, p))
    toxic = np.array([min(max(r.toxic, 0), 1) for r in rows], dtype=np.int64)
    texts = [r.text.split() for r in rows]
    apart = np.array([zlib.crc32(f"score {r.doc_id}".encode()) % p.holdout == 0 for r in rows], dtype=bool)
    learn = np.flatnonzero(~apart)
    if len(set(toxic[learn].tolist())) < 2 or not any(texts[i] for i in learn):
        return None
    field = trained([texts[i] for i in learn], toxic[learn], p)
    check = np.flatnonzero(apart)
    if len(set(toxic[check].tolist())) < 2:
        check = learn
    return calibrated(field, [texts[i] for i in check], toxic[check], p)


_last: dict[int, Words] = {}


def remembered(field: Field, p: Params) -> Words:
    """The words of the last model this Python worker scored with, across tasks."""
    key = zlib.crc32(field.weights.tobytes())
    if key not in _last:
        _last.clear()
        _last[key] = Words(field.weights, p)
    return _last[key]


def spans(text: str, p: np.ndarray) -> list[list[int]]:
    """Stretches [start, end) of code points of neighbouring tokens that are toxic at least as likely as not."""
    out: list[list[int]] = []
    if not (p >= OFFENDING).any():
        return out
    last = False
    for m, x in zip(TOKEN.finditer(text), p):
        if x >= OFFENDING:
            if last:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
        last = x >= OFFENDING
    return out


def tag(docs: DataFrame, field: Field | None, p: Params, threshold: float = 0.7) -> DataFrame:
    """Scores and offsets of `docs` (doc_id, text): one narrow pass, whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(field, p) if field else None
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                s = b.slice(at, AT_ONCE)
                texts = [t or "" for t in s.column("text").to_pylist()]
                score, found = np.full(len(texts), 0.5), [[] for _ in texts]
                if field:
                    logits, sizes = known.logits([t.split() for t in texts], field.bias)
                    prob = marginals(logits, sizes, field.steps)[0]
                    score = sigmoid(evidence(prob, sizes) @ field.score)
                    found = [spans(t, x) for t, x in zip(texts, np.split(prob, np.cumsum(sizes)[:-1]))]
                yield pa.RecordBatch.from_arrays(
                    [s.column("doc_id"), s.column("held_out"), s.column("key"), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                     pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "held_out", "key", "score", "predicted", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), doc_key(F.col("text")).alias("key"), "text")
    return src.mapInArrow(run, "doc_id long, held_out boolean, key long, score double, predicted int, spans array<array<int>>")


def classify(docs: DataFrame, labels: DataFrame, p: Params | None = None, threshold: float = 0.7) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, key (names the text), score, predicted, spans (start and end of toxic stretches).

    Only the text makes a score and its spans. Null and empty texts score by
    their lack of evidence; where the labels hold a single class, all texts
    score 0.5 and have no span. Repeated rows score alike; rows with a null
    doc_id are scored and never learned from; label rows with nulls are not
    learned from; of several labels of one document the largest counts. Other
    columns are not read, an empty table gives an empty result.
    """
    p = p or Params()
    return tag(docs, fit(docs, labels, p), p, threshold)
