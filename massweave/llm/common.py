"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.scale import stored

__all__ = ["ascii_lower", "components", "doc_key", "importable", "only", "release", "small_batches", "stored"]

#: Bytes of rows sent to a Python worker at a time, or else one row.
BATCH = 4 << 20


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where the driver was only given its folder on sys.path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """`importable`, and from now on whole texts go to the session's Python workers `BATCH` bytes at a time, unless it asks for fewer.

    Spark's own limit is 64 MB. The executor holds a batch outside its heap while it
    grows, the worker holds it again, and neither gives all of it back.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH:
        spark.conf.set(limit, BATCH)
    return importable(spark)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from `stored` that no later step reads: what was made of them has been written itself."""
    for t in tables:
        folders = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        for f in folders:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_state: dict[str, dict] = {}


def only(owner: str) -> dict:
    """What this Python worker keeps for one operator from task to task; what it kept for others is let go."""
    for k in [k for k in _state if k != owner]:
        del _state[k]
    return _state.setdefault(owner, {})


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; null stays null."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def doc_key(text: Column) -> Column:
    """64 bits of a whole text; with doc_id it names a row, so equal rows share a result."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.length(text))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `edges` (a long, b long) as (node, root), root the smallest node.

    Alternates the large-star and small-star steps until every component is a
    star around its smallest node. Only edges travel, minima are pre-aggregated before the shuffle,
    and each step goes on from a stored table, so a hub's edges are an ordinary
    skewed join that Spark can split. Nodes without an edge are not returned.
    """
    def star(nbrs: DataFrame, hub: str) -> DataFrame:
        return stored(nbrs.groupBy(hub).agg(F.min("v").alias("m")), name)

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").take(1)

    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .filter("a <> b").distinct(), name)
    while not stars(e):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = star(both, "u")
        large = stored(both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), name)
        release(m, e)
        m = star(large, "u")
        small = large.join(m, "u")
        e = stored(small.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                   .union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), name)
        release(m, large)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
