"""Quality classifier: supervised embeddings of words, word pairs and character n-grams, averaged per document, softmax output."""

from __future__ import annotations

import math
import tempfile
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import doc_key, only, release, stored


#: Words that are looked up at a time; characters whose n-grams are hashed at a time, or else one word.
GROUP, CHARS = 1 << 15, 1 << 17


@dataclass(frozen=True)
class Params:
    """`sample` bounds the labelled rows learned from; `cache` the words a task remembers; `pair` is how often a word bigram counts."""
    buckets: int = 1 << 16
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    sample: int = 4000
    epochs: int = 6
    rate: float = 0.5
    pair: int = 4
    seed: int = 42
    cache: int = 400_000


def features(word: str, p: Params) -> list[int]:
    """Buckets of the word and of its character n-grams; case and punctuation count."""
    marked = f"<{word}>"
    out = [zlib.crc32(marked.encode())]
    n = len(marked)
    for k in range(p.shortest, p.longest + 1):
        out += [zlib.crc32(marked[i:i + k].encode()) for i in range(n - k + 1)]
    return [x % p.buckets for x in out]


def crc_table() -> np.ndarray:
    """CRC-32 of each byte, the step that `zlib.crc32` takes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()


def all_features(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(position in `words`, bucket) of all `features` of all words, for many words at once.

    CRC-32 runs on from every character's first byte, and is read where an
    n-gram of characters ends.
    """
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    raw = "".join(marked).encode()
    data = np.frombuffer(raw + bytes(4 * p.longest), np.uint8)
    start = np.flatnonzero((data[:len(raw)] & 0xC0) != 0x80)                 # of characters
    ends = np.concatenate([start, np.full(p.longest, len(raw))])
    word = np.repeat(np.arange(len(marked)), size)
    left = np.cumsum(size)[word] - np.arange(len(start))                    # characters to the end of the word
    lengths = {k: np.where(left >= k, ends[k:k + len(start)] - start, 0) for k in range(p.shortest, p.longest + 1)}
    at, bucket = [np.arange(len(marked))], [np.fromiter((zlib.crc32(m.encode()) for m in marked), np.int64, len(marked))]
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for n in range(1, max(int(x.max(initial=0)) for x in lengths.values()) + 1):
        state = CRC[(state ^ data[start + n - 1]) & 0xFF] ^ (state >> np.uint32(8))
        for x in lengths.values():
            i = np.flatnonzero(x == n)
            if len(i):
                at.append(word[i])
                bucket.append((~state[i]).astype(np.int64))
    return np.concatenate(at), np.concatenate(bucket) % p.buckets


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def pair_buckets(h: np.ndarray, p: Params) -> np.ndarray:
    """Buckets of the word bigrams of a text, from the hashes of its words in order (uint32).

    Bigrams of two equal words share one bucket, so that what is learned of some
    words that follow themselves holds for all.
    """
    mixed = (h[:-1] * np.uint32(2_654_435_761)) ^ (h[1:] * np.uint32(2_246_822_519))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(3_266_489_917) >> np.uint32(7)
    return np.where(h[:-1] == h[1:], zlib.crc32(b"same again"), mixed) % p.buckets


def bags(rows: DataFrame, p: Params) -> DataFrame:
    """(doc_id, quality, ids, counts): a document's distinct buckets, at most `buckets` of them, as raw int32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = [], []
            for t in b.column("text"):
                words = (t.as_py() or "").split()
                count = Counter(words)
                found = [features(w, p) for w in count]
                times = np.repeat(list(count.values()), [len(f) for f in found]) if found else np.zeros(0)
                bag = np.bincount(np.array([x for f in found for x in f], dtype=np.int64), weights=times, minlength=p.buckets).astype(np.int32)
                h = {w: word_hash(w) for w in count}
                pairs = pair_buckets(np.fromiter(map(h.__getitem__, words), np.uint32, len(words)), p)
                bag += (p.pair * np.bincount(pairs, minlength=p.buckets)).astype(np.int32)
                at = np.flatnonzero(bag)
                ids.append(at.astype(np.int32).tobytes())
                counts.append(bag[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "quality", "ids", "counts"])

    return rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, ids binary, counts binary")


def held_out(doc_id) -> F.Column:
    """Fold of a doc_id: true where crc32 of its text form leaves 0 modulo 5; a null doc_id is false."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """Up to `sample` labelled documents outside the held-out fold, those of the smallest hash of doc_id."""
    lab = (labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))   # at most `sample` rows


def unloaded(rows: DataFrame, file: BinaryIO) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Write the bags to `file`, a part of the rows at a time; labels, and start and size of each bag in it, by doc_id.

    A bag is its ids, then as many counts, as int32. The driver never holds the
    sample's bags, whatever the length of its texts.
    """
    at, places = 0, []
    for r in rows.toLocalIterator():
        file.write(r.ids)
        file.write(r.counts)
        n = len(r.ids) // 4
        places.append((r.doc_id, r.quality, at, n))
        at += 2 * n
    file.flush()
    places.sort()
    return np.array([q for _, q, _, _ in places], dtype=np.int64).clip(0, 1), [(start, n) for _, _, start, n in places]


def learned(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of the buckets and the output rows of labels 0 and 1.

    Stochastic gradient descent in numpy, one document a step, on the bounded
    sample's bags, read from a file. Without both labels nothing is learned and
    both are 0.
    """
    rows = stored(bags(training_rows(docs, labels, p), p), "bags")
    with tempfile.TemporaryFile() as file:
        y, places = unloaded(rows, file)
        release(rows)
        return descended(y, places, file, p)


def descended(y: np.ndarray, places: list[tuple[int, int]], file: BinaryIO, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The descent of `learned`, over the bags at `places` of `file`."""
    if len(set(y.tolist())) < 2:
        return np.zeros((p.buckets, p.dim)), np.zeros((p.dim, 2))
    rng = np.random.default_rng(p.seed)
    emb = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim))
    out = np.zeros((p.dim, 2))
    share = np.bincount(y, minlength=2) / len(y)
    weight = np.sqrt(0.5 / share)                       # the rarer label counts somewhat more
    steps, done = p.epochs * len(places), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(places)):
            start, n = places[i]
            file.seek(4 * start)
            ids, c = np.frombuffer(file.read(8 * n), np.int32).reshape(2, n)
            rate = p.rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            c = c / c.sum()
            hidden = c @ emb[ids]
            z = hidden @ out
            prob = np.exp(z - z.max())
            prob /= prob.sum()
            prob[y[i]] -= 1
            g = rate * weight[y[i]] * prob
            back = out @ g
            out -= np.outer(hidden, g)
            emb[ids] -= np.outer(c * len(ids) ** 0.5, back)
    return emb, out


def fit(docs: DataFrame, labels: DataFrame, p: Params) -> np.ndarray:
    """Learned evidence of each bucket for label 1: its embedding times the difference of the output rows."""
    emb, out = learned(docs, labels, p)
    return emb @ (out[:, 1] - out[:, 0])


class Evidence(dict):
    """word -> row of `sums` (evidence of its buckets), `sizes` (their number) and `hashes`; forgets all between groups of texts when full."""

    def __init__(self, evidence: np.ndarray, p: Params):
        super().__init__()
        self.evidence, self.p, self.chars, self.new = evidence, p, 0, []
        self.sums, self.sizes, self.hashes = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def learn(self) -> None:
        """Fill the rows of the words that came since the last call."""
        if not self.new:
            return
        n = len(self)
        if n > len(self.sums):
            self.sums, self.sizes, self.hashes = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.sums, self.sizes, self.hashes))
        size = np.cumsum(np.fromiter(map(len, self.new), np.int64, len(self.new)))
        cuts = [*np.flatnonzero(np.diff(size // CHARS, prepend=-1)), len(self.new)]
        for at, to in zip(cuts, cuts[1:]):
            some = self.new[at:to]
            word, bucket = all_features(some, self.p)
            rows = slice(n - len(self.new) + at, n - len(self.new) + to)
            self.sums[rows] = np.bincount(word, self.evidence[bucket], len(some))
            self.sizes[rows] = np.bincount(word, minlength=len(some))
            self.hashes[rows] = np.fromiter(map(word_hash, some), np.uint32, len(some))
        self.chars += int(size[-1])
        self.new.clear()

    def average(self, at: np.ndarray) -> float:
        """Evidence of a whole text, given as the rows of its words, averaged over its features; 0 where it has none."""
        if not len(at):
            return 0.0
        pairs = self.evidence[pair_buckets(self.hashes[at], self.p)]
        return float((self.sums[at].sum() + self.p.pair * pairs.sum()) / (self.sizes[at].sum() + self.p.pair * len(pairs)))

    def logits(self, texts: Iterable[str | None]) -> Iterator[float]:
        """`average` of every text; about GROUP words are looked up before the new ones among them are learned."""
        some, words = [], 0
        for t in texts:
            if not some and (len(self) >= self.p.cache or self.chars >= 32 * self.p.cache):
                self.clear()
                self.chars = 0
            w = (t or "").split()
            some.append(np.fromiter(map(self.__getitem__, w), np.int32, len(w)))
            words += len(w)
            if words >= GROUP:
                self.learn()
                yield from map(self.average, some)
                some, words = [], 0
        self.learn()
        yield from map(self.average, some)

    def logit(self, text: str | None) -> float:
        return next(self.logits([text]))


def remembered(evidence: np.ndarray, p: Params) -> Evidence:
    """The words of the last model this Python worker scored with, across tasks."""
    key, last = zlib.crc32(evidence.tobytes()), only("quality")
    if key not in last:
        last.clear()
        last[key] = Evidence(evidence, p)
    return last[key]


def score(docs: DataFrame, evidence: np.ndarray, p: Params, threshold: float = 0.3) -> DataFrame:
    """Scores of `docs` (doc_id, text): one narrow pass, whole texts.

    The softmax of two outputs of an average is the logistic of the average
    evidence, so a word adds one pair of numbers, which a task remembers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(evidence, p)
        for b in batches:
            logits = known.logits(t.as_py() for t in b.column("text"))
            s = np.array([1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in logits], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("key"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "key", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), doc_key(F.col("text")).alias("key"), "text")
    return src.mapInArrow(run, "doc_id long, held_out boolean, key long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, p: Params | None = None, threshold: float = 0.3) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, key (names the text), score, predicted.

    Only the text makes a score. Words are what white space leaves. Empty and null texts, and all texts where the
    labels hold a single class, score 0.5. Repeated rows score alike; rows with
    a null doc_id are scored and never learned from; label rows with nulls are
    not learned from; of several labels of one document the largest counts.
    """
    p = p or Params()
    return score(docs, fit(docs, labels, p), p, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, p: Params | None = None, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not reject.

    Null and empty texts score 0.5 and stay; repeated rows stay or go together; an
    empty table gives an empty one.
    """
    p = p or Params()
    evidence = fit(docs, labels, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(evidence, p)
        cut = math.log(threshold / (1 - threshold))
        for b in batches:
            yield b.filter(pa.array([x >= cut for x in known.logits(t.as_py() for t in b.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
