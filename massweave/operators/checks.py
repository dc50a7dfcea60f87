"""Reconciliation checks as queries: check_id, keys, got, want, tol, ok."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.operators import curves as cv
from massweave.operators import joins as jn
from massweave.operators.cleaning import nearest_level


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def result(df: DataFrame, check_id: str, on: Sequence[str], got, want, tol, ok: Column | None = None, rel: bool = False) -> DataFrame:
    """The check table; |got - want| within tol, absolute or relative to want."""
    got, want, tol = _c(got), _c(want), _c(tol)
    dev = F.abs(got - want)
    if rel:
        dev = dev / F.nullif(F.abs(want), F.lit(0.0))
    hit = dev <= tol if ok is None else ok
    return df.select(F.lit(check_id).alias("check_id"), *on, got.alias("got"), want.alias("want"), tol.alias("tol"),
                     F.coalesce(hit, F.lit(False)).alias("ok"))


def within(actual: DataFrame, expected: DataFrame, on: Sequence[str], tol: float, rel: bool, check_id: str) -> DataFrame:
    """`got` of one table against `want` of another; a key missing on either side fails."""
    j = actual.select(*on, "got").join(expected.select(*on, "want"), list(on), "full")
    return result(j, check_id, on, "got", "want", tol, rel=rel)


def sums_to_one(parts: DataFrame, by: Sequence[str], val: str, check_id: str = "J02", tol: float = 1e-9) -> DataFrame:
    return result(parts.groupBy(*by).agg(F.sum(val).alias("s")), check_id, by, "s", 1.0, tol)


def pinned_at(df: DataFrame, by: Sequence[str], year: int, val: str, want: float, check_id: str = "J03", tol: float = 1e-9) -> DataFrame:
    t = df.filter(F.col("year") == year).groupBy(*by).agg(F.max(F.abs(F.col(val) - F.lit(want))).alias("d"))
    return result(t, check_id, by, "d", 0.0, tol)


def round_trip(df: DataFrame, on: Sequence[str], basis: str, share: str, uplift: str, recorded: str, asserted: Column,
               tol: float = 0.05, check_id: str = "J04") -> DataFrame:
    """basis x (1 + share x (mean uplift - 1)) against what was recorded; other rows inform only."""
    got = F.col(basis) * (F.lit(1.0) + F.col(share) * (F.col(uplift) - F.lit(1.0)))
    dev = F.abs(got / F.nullif(F.col(recorded), F.lit(0.0)) - F.lit(1.0))
    t = result(df.withColumn("asserted", asserted), check_id, [*on, "asserted"], got, recorded, tol, ok=(dev <= tol) | ~F.col("asserted"))
    return t


def same_curve(a: DataFrame, b: DataFrame, on: Sequence[str], val: str, check_id: str = "J05", tol: float = 1e-12) -> DataFrame:
    d = jn.max_abs_diff(a, b, on, val)
    return result(d, check_id, [], "max_abs_diff", 0.0, tol, ok=(F.col("max_abs_diff") <= tol) & (F.col("n_unmatched") == 0))


def against_label(df: DataFrame, on: Sequence[str], composed: str, label: str, tol: float = 0.15, check_id: str = "J06") -> DataFrame:
    """Composed presence against the label; rows no label could express are exempt."""
    gap = F.abs(F.col(composed) - nearest_level(composed))
    t = df.withColumn("exempt", gap > tol)
    near = F.abs(F.col(composed) - F.col(label)) <= tol
    return result(t, check_id, [*on, "exempt"], composed, label, tol, ok=near | F.col("exempt"))


def binned_against_exact(binned: DataFrame, exact: DataFrame, on: Sequence[str], metrics: Sequence[str], tol: float = 0.03,
                         check_id: str = "J07") -> DataFrame:
    """Worst series per metric; values of at most 1 are exempt."""
    a = binned.unpivot(list(on), list(metrics), "metric", "got")
    b = exact.unpivot(list(on), list(metrics), "metric", "want")
    j = a.join(b, [*on, "metric"]).filter(F.abs("want") > 1)
    dev = F.abs(F.col("got") - F.col("want")) / F.abs("want")
    worst = j.groupBy("metric").agg(F.max_by(F.struct(*on, "got", "want"), F.struct(F.round(dev, 12), *on)).alias("w")).select("metric", "w.*")
    return result(worst, check_id, ["metric", *on], "got", "want", tol, rel=True)


def ranges_overlap(a: DataFrame, b: DataFrame, on: Sequence[str], check_id: str = "J08") -> DataFrame:
    o = jn.overlaps(a, b, on)
    width = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")
    return result(o, check_id, on, width, 0.0, 0.0, ok=F.col("overlap"))


def base_year(yearly: DataFrame, static: DataFrame, on: Sequence[str], val: str, year: int, tol: float = 0.03, check_id: str = "J09") -> DataFrame:
    a = yearly.filter(F.col("year") == year).select(*on, F.col(val).alias("got"))
    return within(a, static.select(*on, F.col(val).alias("want")), on, tol, True, check_id)


def ordering(df: DataFrame, by: Sequence[str], key: str, small: str, large: str, val: str, check_id: str = "J10") -> DataFrame:
    at = lambda k: F.max(F.when(F.col(key) == k, F.col(val)))
    t = df.groupBy(*by).agg(at(small).alias("lo"), at(large).alias("hi"))
    return result(t, check_id, by, "lo", "hi", 0.0, ok=F.col("lo") < F.col("hi"))


def rate_in_band(df: DataFrame, by: Sequence[str], val: str, year: int, lo: float, hi: float, slack: float = 0.5, check_id: str = "J11") -> DataFrame:
    from massweave.operators.windows import next_rate
    t = next_rate(df, by, "year", val, year).withColumn("pct", F.col("rate") * 100.0)
    return result(t, check_id, by, "pct", (lo + hi) / 2, slack, ok=F.col("pct").between(lo - slack, hi + slack))


def share_within(df: DataFrame, by: Sequence[str], part: Column, val: str, want: float, tol: float, check_id: str = "J12") -> DataFrame:
    t = df.groupBy(*by).agg((F.lit(100.0) * F.sum(F.when(part, F.col(val)).otherwise(0.0)) / F.sum(val)).alias("pct"))
    return result(t, check_id, by, "pct", want, tol)


def weighted_mean(df: DataFrame, by: Sequence[str], val: str, weight: str, want: float, tol: float, check_id: str = "J13") -> DataFrame:
    t = df.groupBy(*by).agg((F.sum(F.col(val) * F.col(weight)) / F.sum(weight)).alias("m"))
    return result(t, check_id, by, "m", want, tol)


def ratio_class(a: DataFrame, b: DataFrame, mapping_a: Column, mapping_b: Column, val: str, check_id: str = "J14") -> DataFrame:
    """Both sources on one axis, their ratio, and what a spread of that size means."""
    x = a.groupBy(mapping_a.alias("grp")).agg(F.sum(val).alias("got"))
    y = b.groupBy(mapping_b.alias("grp")).agg(F.sum(val).alias("want"))
    j = x.join(y, "grp").withColumn("ratio", F.greatest(F.col("got") / F.col("want"), F.col("want") / F.col("got")))
    cls = (F.when(F.col("ratio") <= 1.03, "noise").when(F.col("ratio") <= 1.6, "normal").when(F.col("ratio") <= 4.0, "structural")
           .when(F.col("ratio") <= 10.0, "wide").otherwise("error"))
    return result(j.withColumn("class", cls), check_id, ["grp", "class"], "got", "want", 10.0, ok=F.col("ratio") <= 10.0)


def ratio_target(a: DataFrame, b: DataFrame, on: Sequence[str], num: str, den: str, want: Column, tol: float = 0.15, check_id: str = "J15") -> DataFrame:
    j = a.select(*on, num).join(b.select(*on, den), list(on)).withColumn("ratio", F.col(num) / F.nullif(F.col(den), F.lit(0.0))).withColumn("target", want)
    return result(j, check_id, on, "ratio", "target", tol, rel=True)


def compound_growth(df: DataFrame, by: Sequence[str], val: str, y0: int, y1: int, want: float, tol: float, check_id: str = "J16") -> DataFrame:
    t = cv.pct_change(df, by, "year", val, y0, y1)
    t = t.withColumn("cagr", F.pow(F.col("v1") / F.nullif(F.col("v0"), F.lit(0.0)), F.lit(1.0 / (y1 - y0))) - F.lit(1.0))
    return result(t, check_id, by, "cagr", want, tol)
