"""Set operations on tables and key sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "domain") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn(tag, F.lit(n)) for n, d in parts.items()])


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def key_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on), list(on), "left_anti")


def key_intersection(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on), list(on), "left_semi")


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)
