"""Sorting and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, val: str, k: int, tie: Sequence[str]) -> DataFrame:
    """k largest, NULL and NaN last; a top-k heap per task, no full sort."""
    v = F.nanvl(F.col(val).cast("double"), F.lit(None).cast("double"))
    return df.orderBy(v.desc_nulls_last(), *tie).limit(k)


def top_k_per(df: DataFrame, by: Sequence[str], val: str, k: int, tie: Sequence[str]) -> DataFrame:
    """k largest per key; Spark keeps k rows per key in every task before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.col(val).desc_nulls_last(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_changes(df: DataFrame, val: str, k: int, tie: Sequence[str]) -> DataFrame:
    """k largest absolute changes, shown by signed change."""
    return df.orderBy(F.abs(val).desc_nulls_last(), *tie).limit(k).orderBy(val, *tie)


def movers(df: DataFrame, val: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k lowest and the k highest."""
    low = df.orderBy(F.col(val).asc_nulls_last(), *tie).limit(k).withColumn("side", F.lit("bottom"))
    high = df.orderBy(F.col(val).desc_nulls_last(), *tie).limit(k).withColumn("side", F.lit("top"))
    return low.unionByName(high)


def keep_top(df: DataFrame, label: str, val: str, k: int) -> DataFrame:
    """Rows of the k labels with the largest mean."""
    best = df.groupBy(label).agg(F.avg(val).alias("_m")).orderBy(F.desc("_m"), label).limit(k).select(label)
    return df.join(F.broadcast(best), label, "left_semi")          # k labels


def sort_by(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in keys])
