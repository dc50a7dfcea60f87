"""Column arithmetic, wide/long reshaping, splits and balances."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.functions.text import na_text
from massweave.operators.groupwise import share_of


def scale_by_factor(df: DataFrame, measures: Sequence[str], factors: Mapping[str, str]) -> DataFrame:
    """`<segment>_<measure>` = measure x factor; a null or zero factor gives 0."""
    out = {}
    for seg, f in factors.items():
        for m in measures:
            out[f"{seg}_{m}"] = F.coalesce(F.col(m).cast("double"), F.lit(0.0)) * F.coalesce(F.col(f), F.lit(0.0))
    return df.withColumns(out)


def override_or_scale(base, segment_value, factor) -> Column:
    base = F.col(base) if isinstance(base, str) else base
    return F.when(base == -1, F.col(segment_value)).otherwise(base * F.col(factor))


def row_total(cols: Sequence[str]) -> Column:
    e = F.col(cols[0])
    for c in cols[1:]:
        e = e + F.col(c)
    return e


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(0.0, subset=list(cols) if cols else None)


def insert_after(df: DataFrame, col: str, after: str) -> DataFrame:
    names = [c for c in df.columns if c != col]
    names.insert(names.index(after) + 1, col)
    return df.select(*names)


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def project_like(df: DataFrame, columns: Sequence[str], dtype: str = "string") -> DataFrame:
    """Project onto a template's columns; a missing one reads NULL."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(dtype).alias(c) for c in columns])


def to_long(df: DataFrame, ids: Sequence[str], pattern: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """Unpivot the columns that match `pattern`; its groups become key columns."""
    rx = re.compile(pattern)
    cols = [c for c in df.columns if rx.fullmatch(c)]
    if not cols:
        raise ValueError(f"no column matches {pattern!r}; available: {df.columns}")
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), cols, "_col", value)
    return long.withColumns({n: F.regexp_extract("_col", f"^{pattern}$", i + 1) for i, n in enumerate(names)}).drop("_col")


def to_wide(df: DataFrame, rows: Sequence[str], col: str, val: str, values: Sequence, agg=F.sum) -> DataFrame:
    """Pivot on known values: one aggregation, no job to find the columns."""
    return df.groupBy(*rows).pivot(col, list(values)).agg(agg(val))


def split_row(df: DataFrame, pred: Column, label: str, value: str, parts: Mapping[str, Column | float]) -> DataFrame:
    """Replace matching rows by one row per part, keeping the sum."""
    other = [c for c in df.columns if c not in (label, value)]
    split = F.array(*[F.struct(F.lit(n).alias("l"), (F.col(value) * (f if isinstance(f, Column) else F.lit(f))).alias("v"))
                      for n, f in parts.items()])
    same = F.array(F.struct(F.col(label).alias("l"), F.col(value).alias("v")))
    return (df.select(*other, F.explode(F.when(pred, split).otherwise(same)).alias("_s"))
            .select(*other, F.col("_s.l").alias(label), F.col("_s.v").alias(value)))


def merge_labels(df: DataFrame, by: Sequence[str], vals: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(v).alias(v) for v in vals])


def balance(df: DataFrame, by: Sequence[str], label: str, val: str, name: str) -> DataFrame:
    """Add the balance component clip(1 - sum of the others, 0, 1) per key."""
    rest = (df.groupBy(*by).agg(F.sum(val).alias("_s"))
            .select(*by, F.lit(name).alias(label),
                    F.greatest(F.least(F.lit(1.0) - F.col("_s"), F.lit(1.0)), F.lit(0.0)).alias(val)))
    return df.select(*by, label, val).unionByName(rest)


def normalise(df: DataFrame, by: Sequence[str], val: str, floor: float | None = None) -> DataFrame:
    """Parts over their key's sum; a zero sum leaves 0 (or is floored, for shares)."""
    return share_of(df, by, val, "_share", floor).withColumn(val, F.col("_share")).drop("_share")


def na_fill(df: DataFrame, cols: Sequence[str], constants: Mapping[str, str] | None = None) -> DataFrame:
    out = {c: na_text(c) for c in cols}
    out.update({k: F.lit(v) for k, v in (constants or {}).items()})
    return df.withColumns(out)
