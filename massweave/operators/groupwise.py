"""Group totals brought back to the rows, without gathering a group in one task.

A window over `PARTITION BY key` puts a whole key into one task. These helpers
aggregate first (map-side combine) and join the small result back, so a key
that holds a third of the rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.scale import BROADCAST_ROW_LIMIT, checked_broadcast


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join on same-named keys; the right keys are dropped."""
    if not by:
        return left.crossJoin(right)
    rk = {c: f"_k_{c}" for c in by}
    right = right.withColumnsRenamed(rk)
    cond = None
    for c in by:
        e = left[c].eqNullSafe(right[rk[c]])
        cond = e if cond is None else cond & e
    return left.join(right, cond, how).drop(*rk.values())


def with_group(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column], bounded: bool = False,
               max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Attach aggregates of the row's group as extra columns.

    `bounded` says that a group is small by its nature (the years of a series,
    the states of a year); only then is a window used.
    """
    if bounded:
        w = W.partitionBy(*by)
        return df.withColumns({n: a.over(w) for n, a in aggs.items()})
    small = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    if not by:                                    # one row by construction
        return df.crossJoin(F.broadcast(small))
    return join_on(df, checked_broadcast(small, max_rows), by)


def share_of(df: DataFrame, by: Sequence[str], val: str, out: str = "share", floor: float | None = None,
             bounded: bool = False) -> DataFrame:
    """Value over its group total. A zero total gives 0, or is floored."""
    t = with_group(df, by, {"_total": F.sum(val)}, bounded)
    if floor is None:
        e = F.when(F.col("_total") != 0, F.col(val) / F.col("_total")).otherwise(F.lit(0.0))
    else:
        e = F.col(val) / F.greatest(F.col("_total"), F.lit(floor))
    return t.withColumn(out, e).drop("_total")


def at_base(df: DataFrame, by: Sequence[str], year: str, val: str, base_year: int, out: str = "base") -> DataFrame:
    """The value at the base year on every row of a yearly series."""
    return with_group(df, by, {out: F.max(F.when(F.col(year) == base_year, F.col(val)))}, bounded=True)


def index_to_base(df: DataFrame, by: Sequence[str], year: str, val: str, base_year: int, out: str = "index") -> DataFrame:
    """Value over the base-year value; a base of (almost) zero reads 1."""
    t = at_base(df, by, year, val, base_year, "_base")
    return t.withColumn(out, F.when(F.coalesce(F.col("_base"), F.lit(0.0)) <= 1e-9, F.lit(1.0))
                        .otherwise(F.col(val) / F.col("_base"))).drop("_base")
