"""Positional idioms over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.cleaning import first_per_key
from massweave.operators.groupwise import at_base, join_on, share_of
from massweave.operators.stats import avg_rank, in_cells, offsets


def running_sum(df: DataFrame, by: Sequence[str], order: str, val: str, out: str = "running") -> DataFrame:
    """Running sum along an ordered series of unique positions, a NULL position last.

    Each cell of neighbouring rows sums on its own and starts from the totals of
    the cells before, so a long series is not one task, however its positions lie.
    """
    t = in_cells(df, by, [order])
    loc = F.sum(val).over(W.partitionBy(*by, "_cell").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    t = join_on(t.withColumn("_l", loc), offsets(t, by, F.coalesce(F.sum(val), F.lit(0))), [*by, "_cell"], "inner")
    return t.withColumn(out, F.col("_off") + F.coalesce("_l", F.lit(0))).drop("_cell", "_at", "_off", "_l")


def neighbour(df: DataFrame, by: Sequence[str], order: str, val: str) -> DataFrame:
    """Previous and next value and the slopes to them; for curves with few points per key."""
    w = W.partitionBy(*by).orderBy(order)
    c = F.col
    t = df.withColumns({"prev": F.lag(val).over(w), "next": F.lead(val).over(w), "_xp": F.lag(order).over(w), "_xn": F.lead(order).over(w)})
    return t.withColumns({"slope_in": (c(val) - c("prev")) / (c(order) - c("_xp")), "slope_out": (c("next") - c(val)) / (c("_xn") - c(order))}).drop("_xp", "_xn")


def row_id(df: DataFrame, by: Sequence[str], order: str, tie: Sequence[str] = (), out: str = "row_id") -> DataFrame:
    """Stable 1-based row number per key (or over everything, with no key); NULL order values come last.

    Rows are ordered once, over all tasks; a row's number is its place in its
    task plus the rows of its key in the tasks before. No value is numbered in
    one task unless its rows are equal in `tie` too.
    """
    t = in_cells(df, by, [order, *tie])
    t = join_on(t, offsets(t, by, F.count("*"), {"_first": F.min("_at")}), [*by, "_cell"], "inner")
    return t.withColumn(out, F.col("_off") + F.col("_at") - F.col("_first") + 1).drop("_cell", "_at", "_off", "_first")


def next_rate(df: DataFrame, by: Sequence[str], year: str, val: str, base_year: int) -> DataFrame:
    """Growth rate from the base year to the next, per key."""
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(val)))
    return df.groupBy(*by).agg((at(base_year + 1) / F.nullif(at(base_year), F.lit(0.0)) - F.lit(1.0)).alias("rate"))


__all__ = ["running_sum", "neighbour", "row_id", "first_per_key", "avg_rank", "at_base", "next_rate", "share_of"]
