"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm import chat, clusters, licenses, mixing, pieces, pii, quality, repair, simhash, tokenstore, toxicity, vectors
from massweave.llm.common import importable
from massweave.scale import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    r = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return r.select("doc_id", "held_out", "score", "predicted")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    r = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "fingerprint", "component_id")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    r = pii.find(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                    F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_mix"] = mixing.SQL


@query
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document: their number, a check sum of their ids, and whether decoding gives the text back."""
    return pieces.digest(table(spark, sf_dir, "documents"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op5_licenses"] = licenses.SQL


@query
def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and check sum of every document's ids, read back from the store."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")
    tokenstore.write(docs, path)
    return tokenstore.read(spark, path, docs)


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth, by inner product."""
    return vectors.search(table(spark, sf_dir, "embeddings"))


@query
def op1_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of the embeddings of every hundredth, exactly."""
    return vectors.hamming_search(vectors.codes(table(spark, sf_dir, "embeddings")))


ORACLES["op1_hamming"] = vectors.HAMMING_SQL


@query
def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations: check sums of prompt and completions, and their masks."""
    return chat.digest(chat.preferences(*chat.sides(table(spark, sf_dir, "conversations"))))


ORACLES["op4_preferences"] = chat.SQL


@query
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every embedding after five rounds of 40 integer centroids."""
    return clusters.digest(table(spark, sf_dir, "embeddings"))


ORACLES["op13_clusters"] = clusters.SQL


@query
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged by a rule."""
    return repair.repair(table(spark, sf_dir, "conversations"))


ORACLES["op11_repair"] = repair.SQL


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, and the offsets of what makes it toxic."""
    r = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")
    return r.select("doc_id", "held_out", "score", "predicted", text.alias("spans"))
