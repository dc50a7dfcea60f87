"""Token ids in shards of raw payload, and a minimal perfect hash index from document keys to their place.

A store is a folder of two Parquet tables, written by Spark's own writers (so
a retried task leaves one copy, on any file system):

shards  part, seq (order of the shards), n_ids, payload (raw little-endian ids,
        16-bit where the vocabulary fits, else 32-bit), doc_id, occ, n (of the
        documents in it, in order)
index   bucket, n, groups, disp, prints, part, seq, idx (raw arrays): a perfect
        hash of the bucket's n keys onto 0..n-1, and by slot a 32-bit
        fingerprint of the key and the document's place
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of payload at which a shard is closed; keys in a bucket of the index, on average.
SHARD, BUCKET = 4 << 20, 40_000
#: Words a task remembers, and as many from before these.
WORDS = 500_000
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


# ---- encoding ----------------------------------------------------------------
class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word only once.

    The byte-level pattern always breaks between a character that is no white
    space and a space, so a text is cut there and the parts are encoded alone.
    Parts of plain letters, digits and marks go to the library's BPE model
    directly; all others, special tokens among them, to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]         # byte-level alphabet: shown bytes stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}
        self.unsafe = re.compile(r"\s ").search
        self.cut = re.compile(r"(?<=\S)(?= )").split
        self.letters = re.compile(f" ?[{LETTER}]+").fullmatch
        self.plain = re.compile(f"[ -~\\n{LETTER}]*").fullmatch
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\\s{LETTER}0-9]+|\\s+(?!\\S)|\\s+").findall
        self.words = Words(self.part)
        self.tokens = Words(self.token)

    def token(self, t: str) -> bytes:
        shown = t.replace(" ", self.alphabet[32]) if t.isascii() and t.isprintable() else t.encode().decode("latin1").translate(self.alphabet)
        return array(self.code, map(attrgetter("id"), self.model.tokenize(shown))).tobytes()

    def part(self, rest: str, lead: str = " ") -> bytes:
        p = lead + rest
        if self.letters(p):
            return self.tokens[p] if len(p) < 6 else self.token(p)
        if self.plain(p) and "<|" not in p:
            return b"".join([self.tokens[t] for t in self.pattern(p)])
        return array(self.code, self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        parts = [p[i > 0:] for i, p in enumerate(self.cut(text))] if self.unsafe(text) else text.split(" ")
        first = self.part(parts[0], "") if parts[0] else b""
        return first + b"".join(map(self.words.__getitem__, parts[1:]))


class Words(dict):
    """Remembers up to WORDS short keys, and those of the WORDS before that; a key of these that comes again is kept on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        v = self.before.get(key)
        if v is None:
            v = self.make(key)
        if len(key) <= 40:
            if len(self) >= WORDS:
                self.before = dict(self)
                self.clear()
            self[key] = v
        return v


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# ---- writing -----------------------------------------------------------------
SHARDS = "part int, seq int, n_ids long, payload binary, doc_id array<long>, occ array<int>, n array<int>"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Encode `docs` in ascending doc_id order (nulls first) and write the shards.

    Texts are dealt by ranges of doc_id and sorted within; equal doc_ids meet in
    one range, one after the other, and are told apart by their number `occ`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        stop = array(enc.code, [end]).tobytes()
        width = len(stop)
        part, seq = TaskContext.get().partitionId(), 0
        held, size, ids, occs, ns = [], 0, [], [], []
        before, occ = object(), 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(ns)], pa.int64()), pa.array([b"".join(held)], pa.binary()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([occs], pa.list_(pa.int32())), pa.array([ns], pa.list_(pa.int32()))],
                names=["part", "seq", "n_ids", "payload", "doc_id", "occ", "n"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                occ = occ + 1 if i == before else 0
                before = i
                data = enc.encode(t.as_py() or "") + stop
                held.append(data)
                size += len(data)
                ids.append(i)
                occs.append(occ)
                ns.append(len(data) // width)
                if size >= SHARD:
                    yield shard()
                    seq += 1
                    held, size, ids, occs, ns = [], 0, [], [], []
        if ids:
            yield shard()

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = src.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, SHARDS).write.parquet(f"{path}/shards")


def hashes(doc_id, occ) -> list:
    """The two 64-bit hashes of a key (doc_id, occ)."""
    n = F.isnull(doc_id)
    i = F.coalesce(doc_id, F.lit(0))
    return [F.xxhash64(i, n, occ).alias("h1"), F.xxhash64(occ, n, i, F.lit("second")).alias("h2")]


def mixed(h1: np.ndarray, h2: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes and a displacement."""
    with np.errstate(over="ignore"):
        x = h1 + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= h2
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(groups, displacement of each group, slot of each key): distinct keys onto 0..n-1, no slot left over.

    Keys fall into small groups by h1. Largest groups first, each looks for the
    displacement that sends all its keys to free slots; a key alone takes any
    free slot, which its displacement names directly as -1 - slot.
    """
    n = len(h1)
    groups = n // 3 + 1
    of = (h1 % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(groups + 1))
    disp = np.zeros(groups, dtype=np.int32)
    slot = np.full(n, -1, dtype=np.int64)
    taken = np.zeros(n, dtype=bool)
    count = np.diff(start)
    tries = np.arange(256)
    for g in np.argsort(-count, kind="stable"):
        k = order[start[g]:start[g + 1]]
        if len(k) < 2:
            break
        at = 0
        while True:
            d = tries + at
            s = (mixed(h1[k][None, :], h2[k][None, :], d[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[s].any(axis=1)
            for x in np.flatnonzero(good):
                if len(set(s[x].tolist())) == len(k):
                    break
            else:
                at += len(tries)
                if at > 1 << 26:
                    raise ValueError("two keys have the same hashes")
                continue
            disp[g], slot[k] = d[x], s[x]
            taken[s[x]] = True
            break
    alone = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken)
    slot[order[start[alone]]] = free
    disp[alone] = -1 - free
    return groups, disp, slot


INDEX = "bucket int, n int, groups int, disp binary, prints binary, part binary, seq binary, idx binary"


def uint64(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)


def build(table: pa.Table) -> pa.Table:
    h1, h2 = uint64(table.column("h1")), uint64(table.column("h2"))
    groups, disp, slot = perfect_hash(h1, h2)

    def by_slot(x: np.ndarray, kind) -> bytes:
        out = np.zeros(len(slot), dtype=kind)
        out[slot] = x
        return out.tobytes()

    place = [by_slot(table.column(c).combine_chunks().to_numpy(zero_copy_only=False), np.int32) for c in ("part", "seq", "idx")]
    return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "n": pa.array([len(slot)], pa.int32()),
                     "groups": pa.array([groups], pa.int32()), "disp": pa.array([disp.tobytes()], pa.binary()),
                     "prints": pa.array([by_slot(h2 >> np.uint64(32), np.uint32)], pa.binary()),
                     **{c: pa.array([p], pa.binary()) for c, p in zip(("part", "seq", "idx"), place)}})


def write_index(spark: SparkSession, path: str) -> None:
    """Index all documents of the shards; the number of buckets follows theirs."""
    shards = spark.read.parquet(f"{path}/shards").select("part", "seq", "doc_id", "occ")
    n = shards.agg(F.sum(F.size("doc_id"))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET))
    keys = shards.select("part", "seq", F.posexplode(F.arrays_zip("doc_id", "occ")).alias("idx", "k"))
    keys = keys.select("part", "seq", "idx", *hashes(F.col("k.doc_id"), F.col("k.occ")))
    keys = keys.withColumn("bucket", F.pmod(F.col("h2"), F.lit(buckets)).cast("int"))
    keys.groupBy("bucket").applyInArrow(build, INDEX).write.parquet(f"{path}/index")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 0) -> None:
    """Write the store of `docs` (doc_id, text) to the shared folder `path`.

    Every text is encoded whole, without special tokens added, and closed by
    the id `end`. Null and empty texts hold that id alone. Documents of a null
    doc_id come first; equal doc_ids follow each other in the order of their
    texts. An empty table makes an empty store. Other columns are not read.
    """
    write_shards(docs, path, tokenizer or default_path(), end)
    write_index(docs.sparkSession, path)


# ---- reading -----------------------------------------------------------------
def find(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Place (part, seq, idx) of each of `keys` (doc_id, occ), by one probe of its bucket; unknown keys are left out."""
    index = spark.read.parquet(f"{path}/index")
    buckets = (index.agg(F.max("bucket")).first()[0] or 0) + 1
    total = spark.read.parquet(f"{path}/shards").select("doc_id").agg(F.sum(F.size("doc_id"))).first()[0] or 0
    buckets = max(buckets, -(-total // BUCKET))

    def probe(k: pa.Table, ix: pa.Table) -> pa.Table:
        if not len(k) or not len(ix):
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("occ", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("idx", pa.int32()))})
        row = ix.to_pylist()[0]
        h1, h2 = uint64(k.column("h1")), uint64(k.column("h2"))
        d = np.frombuffer(row["disp"], np.int32)[(h1 % np.uint64(row["groups"])).astype(np.int64)].astype(np.int64)
        slot = np.where(d < 0, -1 - d, (mixed(h1, h2, np.maximum(d, 0)) % np.uint64(row["n"])).astype(np.int64))
        known = pa.array(np.frombuffer(row["prints"], np.uint32)[slot] == (h2 >> np.uint64(32)).astype(np.uint32))
        out = {"doc_id": k.column("doc_id"), "occ": k.column("occ"), **{c: pa.array(np.frombuffer(row[c], np.int32)[slot]) for c in ("part", "seq", "idx")}}
        return pa.table(out).filter(known)

    k = keys.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("occ").cast("int").alias("occ"), *hashes(F.col("doc_id").cast("long"), F.col("occ").cast("int")))
    k = k.withColumn("bucket", F.pmod(F.col("h2"), F.lit(buckets)).cast("int"))
    return k.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(probe, "doc_id long, occ int, part int, seq int, idx int")


def contents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(part, seq, idx, at, n_tokens, ids_crc32) of every document, from the payloads; at counts ids within the shard.

    ids_crc32 is taken over the ids as little-endian 32-bit numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, payload, n in zip(*(b.column(c) for c in ("part", "seq", "payload", "n"))):
                ids = np.frombuffer(payload.as_py(), dtype=f"<u{width}")
                n = np.array(n.as_py(), dtype=np.int64)
                stop = np.cumsum(n)
                crc = [zlib.crc32(ids[a:e].astype("<u4").tobytes()) for a, e in zip((stop - n).tolist(), stop.tolist())]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int32()), pa.array(np.arange(k), pa.int32()),
                     pa.array(stop - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "seq", "idx", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(f"{path}/shards").select("part", "seq", "payload", "n")
    return shards.mapInArrow(run, "part int, seq int, idx int, at long, n_tokens long, ids_crc32 long")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, before): ids in all shards before each; first within parts, then over the parts."""
    s = spark.read.parquet(f"{path}/shards").select("part", "seq", "n_ids")
    parts = s.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return s.select("part", "seq", own.alias("own")).join(F.broadcast(parts), "part").select("part", "seq", (F.col("ahead") + F.col("own")).alias("before"))


def fetch(spark: SparkSession, path: str, keys: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, occ, ids) of the documents of `keys`: their places by the index, then only the shards that hold them."""
    places = find(spark, path, keys)

    def cut(p: pa.Table, s: pa.Table) -> pa.Table:
        rows = []
        if len(s):
            ids = np.frombuffer(s.column("payload")[0].as_py(), dtype=f"<u{width}")
            stop = np.cumsum([0, *s.column("n")[0].as_py()])
            rows = [ids[stop[i]:stop[i + 1]].astype(np.int32) for i in p.column("idx").to_pylist()]
        return pa.table({"doc_id": p.column("doc_id"), "occ": p.column("occ"), "ids": pa.array(rows, pa.list_(pa.int32()))})

    shards = spark.read.parquet(f"{path}/shards").select("part", "seq", "payload", "n").join(places.select("part", "seq").distinct(), ["part", "seq"], "left_semi")
    return places.groupBy("part", "seq").cogroup(shards.groupBy("part", "seq")).applyInArrow(cut, "doc_id long, occ int, ids array<int>")


def read(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, start, n_tokens, ids_crc32, looked up in the store at `path`."""
    keys = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("c"))
    keys = keys.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("c") - 1).cast("int"))).alias("occ"))
    at = find(spark, path, keys).join(contents(spark, path), ["part", "seq", "idx"])
    return at.join(starts(spark, path), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
