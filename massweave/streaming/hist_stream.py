"""Streaming twin of the histogram accumulator.

Bin counts add up, so a stream keeps one running count per (series, bin) and its
state is bounded by series x bins however many rows arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.operators.histogram import finite
from massweave.plans.literals import N_FINE_BINS
from massweave.scale import checked_broadcast, scratch_path


def stream_hist(stream: DataFrame, by: Sequence[str], val: str, range_df: DataFrame, bins: int = N_FINE_BINS) -> DataFrame:
    """Running histogram of a stream against fixed ranges (stream-static join, then a keyed count); NULL and NaN are in no bin."""
    t = stream.filter(finite(val)).select(*by, F.col(val).alias("_v")).join(checked_broadcast(range_df.select(*by, "lo", "width")), list(by))
    t = t.withColumn("_i", F.floor((F.col("_v") - F.col("lo")) / F.col("width")))
    b = F.least(F.greatest(F.col("_i"), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return t.groupBy(*by, "lo", "width", b.alias("bin")).agg(
        F.count("*").alias("count"), F.sum(F.when(F.col("_i") < 0, 1).otherwise(0)).alias("under"),
        F.sum(F.when(F.col("_i") >= bins, 1).otherwise(0)).alias("over"))


def fold_available(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Run the stream over everything available and return the folded state.

    Each micro-batch writes the bins it changed, keyed by batch id and in
    overwrite mode, so a batch that is replayed after a failure replaces itself.
    The last value per bin is the state.
    """
    spark = hist.sparkSession
    out, ckpt = scratch_path(spark, "hist-out"), scratch_path(spark, "hist-ckpt")

    def upsert(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = hist.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()                               # ends by itself once all that is there has been read
    if q.exception() is not None:
        raise q.exception()
    got = spark.read.schema(_schema(hist)).parquet(f"{out}/batch=*")
    keys = [*by, "lo", "width", "bin"]
    last = F.max_by(F.struct("count", "under", "over"), "_batch").alias("s")
    return got.groupBy(*keys).agg(last).select(*keys, "s.count", "s.under", "s.over")


def _schema(hist: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([*hist.schema.fields, T.StructField("_batch", T.LongType())])
