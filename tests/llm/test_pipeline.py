"""The pipeline's stages on the smallest tables, and the registered queries against their SQL."""

from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from massweave.llm import nearcopies, queries
from massweave.llm.common import BATCH
from tests.llm.test_text import brute_spans
from tools.check import compare, duck


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
    assert all(k.columns == cols for k in kept[:-1])
    n = [k.count() for k in kept]
    assert n[0] > n[1] > n[2] == n[3] and n[4] > n[3] / 2 and n[5] == n[4]
    sets = [set(nearcopies.shingles(r.text, 5).tolist()) for r in kept[2].collect()]
    at = defaultdict(list)
    for i, x in enumerate(sets):
        for h in x:
            at[h].append(i)
    close = {(i, j) for ij in at.values() for i, j in combinations(ij, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert not close
    lost = {r.doc_id: r.text for r in kept[1].collect()}
    for r in kept[2].collect():
        lost.pop(r.doc_id)
    for t in lost.values():                                  # what went has a close text among all there were
        x = set(nearcopies.shingles(t, 5).tolist())
        assert sum(len(x & y) >= 0.8 * len(x | y) for y in (set(nearcopies.shingles(r.text, 5).tolist()) for r in kept[1].collect())) > 1
    assert not any(brute_spans(r.text) for r in kept[3].collect())
    assert kept[5].columns == ["doc_id", "lang", "source", "ids", "n_pieces"]


def test_stages_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "pieces"])
def test_long_texts_reach_python_in_small_batches(spark, sf, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.unset(limit)
        dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf)
        texts = spark.range(4_000, numPartitions=1).select(F.repeat(F.lit("word "), 1_000).alias("text"))
        got = texts.mapInArrow(sizes, "rows long, size long").collect()
        assert sum(r.rows for r in got) == 4_000 and max(r.size for r in got) < 2 * BATCH
        spark.conf.set(limit, 1 << 20)                       # a lower limit of the session stays
        dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf)
        assert int(spark.conf.get(limit)) == 1 << 20
    finally:
        spark.conf.unset(limit)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf, name):
    out = compare(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name])
    assert isinstance(out, tuple), out


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
