"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massweave.llm.common import components, doc_key, stored

BITS = 64
#: Shingles whose bits are unpacked at a time; bounds the memory a long text takes.
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the whole text as a signed 64-bit number; 0 where it has no word."""
    w = (text or "").encode().lower().split()          # bytes: ASCII white space, A-Z only
    if not w:
        return 0
    if len(w) < words:
        grams = iter([b" ".join(w)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(words))))
        n = len(w) - words + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        k = min(CHUNK, n - at)
        h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for _, g in zip(range(k), grams)), dtype=">u8", count=k)
        ones += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, key, fp) for every row; one narrow pass over the texts. key names the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), words) for t in b.column("text")], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), fp], names=["doc_id", "key", "fp"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("text")).alias("key"), "text")
    return src.mapInArrow(run, "doc_id long, key long, fp long")


def links(fps: DataFrame, blocks: int = 4) -> DataFrame:
    """Links (a, b) that join all distinct `fp` at 2 or fewer differing bits.

    Two such values differ in at most two of the blocks, so they agree on all
    but two: every choice of kept blocks is a join key. Values alone under all
    their keys have no partner and go. The others meet at the values one bit
    away from them: two values have such a meeting point in common exactly if
    2 or fewer bits differ. At most 65 values can meet at a point, so however
    many values agree on a block, no group is compared pair by pair. The
    Hamming distance of each link is verified.
    """
    width = BITS // blocks
    full = (1 << BITS) - 1

    def signed(x: int) -> int:
        return x - (1 << BITS) if x >> (BITS - 1) else x

    masks = []
    for gone in combinations(range(blocks), 2):
        m = full
        for b in gone:
            m &= ~(((1 << width) - 1) << (b * width))
        masks.append(signed(m & full))
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.c", "k.key")
    crowded = stored(keyed.groupBy("c", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                     .filter("lo <> hi").select("c", "key"), "blocks")
    near = keyed.join(crowded, ["c", "key"], "left_semi").select("fp").distinct()
    around = near.select("fp", F.explode(F.array(F.col("fp"), *[
        F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS)])).alias("point"))
    met = around.groupBy("point").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("b")).filter(F.size("fps") > 1)
    return (met.select(F.explode("fps").alias("a"), "b").filter("a <> b")
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct())


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id, root, key.

    Fingerprints link at 2 or fewer differing bits; component_id is the
    smallest doc_id reachable and root the component's own number (it is there
    where every doc_id of a component is null; component_id is null then). key
    names the text.

    Null and empty texts have fingerprint zero and link like any other. A null
    doc_id keeps its row. Rows that repeat each keep a row. Other columns are
    not read. An empty table gives an empty result.
    """
    fp = stored(fingerprints(docs, words), "fingerprints")
    ids = stored(fp.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "distinct_fp")
    roots = stored(components(links(ids.select("fp"))), "roots")
    of = stored(ids.join(roots, ids.fp == roots.node, "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root")), "of_fp")
    lowest = stored(of.groupBy("root").agg(F.min("lowest").alias("component_id")), "lowest")
    members = stored(of.select("fp", "root").join(lowest, "root"), "members")
    return fp.join(members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "key")


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that stay of groups (doc_id, key, root, component_id): one of each, that of its smallest doc_id.

    Where that doc_id repeats, one of its texts stays, the same in every run.
    A group whose doc_ids are all null keeps one row.
    """
    first = stored(grouped.filter("doc_id <=> component_id")
                   .groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
                   .select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.isnull("doc_id").alias("n"), "key"), "first")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key(F.col("text")).alias("key"),
                    F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.isnull("doc_id").alias("n"),
                    (F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("others"))
    w = Window.partitionBy("k", "n", "key").orderBy("others")
    return d.join(first, ["k", "n", "key"]).withColumn("r", F.row_number().over(w)).filter("r = 1").select("row.*")


def keep_first(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each near-duplicate component of `docs`, as `first_rows` says."""
    return first_rows(docs, near_duplicates(docs, words))
