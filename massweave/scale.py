"""Size checks and scratch storage shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to so many rows and bytes.
BROADCAST_ROW_LIMIT, BROADCAST_BYTES = 200_000, 64 << 20


def row_bytes(df: DataFrame) -> int:
    """Bytes a row takes by its types; a string counts as its default width."""
    return int(df._jdf.schema().defaultSize()) + 16


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast `df` only after counting that it is small, in rows and in bytes.

    A side found small is kept, so the join reads what the count computed. A
    larger one is let go at once and the join is left to Catalyst (sort-merge,
    with the AQE skew split).
    """
    limit = min(max_rows, BROADCAST_BYTES // row_bytes(df))
    kept = df.persist()
    if kept.limit(limit + 1).count() <= limit:
        return F.broadcast(kept)
    kept.unpersist()
    return df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    `spark.checkpoint.dir` is read from the session. Where it is unset, a local
    master, as in tests, gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="massweave-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Redistribute a parameter table over `tasks` (default: all cores) before each of its rows is expanded."""
    return df.repartition(tasks or max(df.sparkSession.sparkContext.defaultParallelism, 1))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and go on from the file.

    For a table that several passes read: it is computed once, a lost executor
    does not undo it, and the plans after it start from a scan.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
