"""Mergeable fixed-bin histograms and what is read from them.

State is (series keys, lo, width, bin, count): it adds up over chunks, files and
micro-batches, and its size does not depend on the number of draws.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators.groupwise import join_on
from massweave.plans.literals import N_COARSE_BINS, N_FINE_BINS, PILOT_PAD
from massweave.scale import checked_broadcast, stored


def finite(val: str) -> Column:
    """Not NULL, NaN or infinite."""
    v = F.col(val).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def not_binned(df: DataFrame, by: Sequence[str], val: str) -> DataFrame:
    """Rows per series that a histogram leaves out: NULL, and NaN or infinite."""
    null = F.col(val).isNull()
    return df.groupBy(*by).agg(F.count_if(null).alias("nulls"), F.count_if(~null & ~finite(val)).alias("not_finite"))


def pilot_range(df: DataFrame, by: Sequence[str], val: str, pilot: Column | None = None, pad: float = PILOT_PAD,
                bins: int = N_FINE_BINS) -> DataFrame:
    """Bin range per series: min/max of the pilot rows widened by `pad` of the span."""
    src = (df if pilot is None else df.filter(pilot)).filter(finite(val))
    g = src.groupBy(*by).agg(F.min(val).cast("double").alias("_mn"), F.max(val).cast("double").alias("_mx"))
    return _widen(g, by, pad, bins)


def _widen(g: DataFrame, by: Sequence[str], pad: float, bins: int, keep: Sequence[str] = ()) -> DataFrame:
    g = g.withColumn("_span", F.when(F.col("_mx") - F.col("_mn") <= 0, F.lit(1.0)).otherwise(F.col("_mx") - F.col("_mn")))
    half = F.lit(pad) * F.col("_span") / F.lit(2.0)
    g = g.select(*by, *keep, (F.col("_mn") - half).alias("lo"), (F.col("_mx") + half).alias("hi"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return g.withColumn("width", F.when(w <= 0, F.lit(1.0)).otherwise(w))


def moments_and_range(df: DataFrame, by: Sequence[str], val: str, pilot: Column | None = None, pad: float = PILOT_PAD,
                      bins: int = N_FINE_BINS) -> DataFrame:
    """Exact moments of all rows and the pilot's bin range, in one aggregation; kept, since the bin pass reads it too."""
    v = F.when(finite(val), F.col(val).cast("double"))
    pv = v if pilot is None else F.when(pilot, v)
    g = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
                            F.min(pv).alias("_mn"), F.max(pv).alias("_mx"))
    return _widen(g, by, pad, bins, ["n", "mean", "std", "min", "max"]).persist()


def fused_stats(df: DataFrame, by: Sequence[str], val: str | Sequence[tuple[Mapping[str, Column], Column]], pilot: Column, pad: float = PILOT_PAD,
                bins: int = N_FINE_BINS) -> tuple[DataFrame, DataFrame]:
    """Histogram and exact moments (n, mean, std, min, max) of each series, from one aggregation over all rows.

    The `pilot` rows are aggregated first and set each series' range and number.
    Then a value is a cell, which is its series' number and bin, and sums, so
    the key of the one large aggregation is a number and its result has at most
    `bins` rows a series. Values out of range are counted in the end bins. A
    series without a pilot row keeps its moments; it has one bin without a
    range, so its percentiles are NULL. NULL, NaN and infinite values do not count.

    `val` is a column, or the several values of a row as (labels, value): the
    labels are columns of `by` that replace the row's or come to it, and must
    tell its values' series apart. Such a row looks its ranges up once and
    carries none of its keys on.
    """
    c = F.col
    facets = [({}, c(val))] if isinstance(val, str) else list(val)
    own = [k for k in by if k in df.columns]
    wide = df.select(*own, pilot.alias("_p"), *[v.cast("double").alias(f"_v{j}") for j, (_, v) in enumerate(facets)],
                     *[F.struct(*[labels.get(k, c(k)).alias(k) for k in by]).alias(f"_k{j}") for j, (labels, _) in enumerate(facets)])
    first = wide.filter("_p").select(*own, F.explode(F.array(*[F.struct(F.lit(j).alias("_j"), c(f"_v{j}").alias("_v"), c(f"_k{j}").alias("_k")) for j in range(len(facets))])).alias("_e"))
    first = first.select(*own, "_e.*").filter(finite("_v")).groupBy(*own, "_j", "_k").agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    rng = _widen(first, [*own, "_j", "_k"], pad, bins)
    rng = stored(rng.select(*own, "_j", "_k", "lo", "width", F.row_number().over(W.orderBy(*own, "_j")).alias("_s")), "ranges")      # one row a series
    at = lambda j: F.max(F.when(c("_j") == j, F.struct("_s", "lo", "width"))).alias(f"_r{j}")
    t = join_on(wide, rng.groupBy(*own).agg(*[at(j) for j in range(len(facets))]), own, "left")

    def cell(j: int) -> Column:
        r, v = c(f"_r{j}"), c(f"_v{j}")
        i = F.least(F.greatest(F.floor((v - r["lo"]) / r["width"]), F.lit(-1)), F.lit(bins)) + 1                      # 0 and bins + 1: out of range
        return F.struct((r["_s"] * F.lit(bins + 2).cast("bigint") + i).alias("_cell"), (v - F.coalesce(r["lo"], F.lit(0.0))).alias("_u"),
                        F.when(r.isNull(), c(f"_k{j}")).alias("_other"))

    e = t.select(F.explode(F.array(*[cell(j) for j in range(len(facets))])).alias("_e")).select("_e.*").filter(finite("_u"))
    cells = e.groupBy("_cell", "_other").agg(F.count("*").alias("count"), F.sum("_u").alias("_s1"), F.sum(c("_u") * c("_u")).alias("_s2"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    i = c("_cell") % (bins + 2) - 1
    cells = cells.select("*", F.floor(c("_cell") / (bins + 2)).alias("_s"), F.least(F.greatest(i, F.lit(0)), F.lit(bins - 1)).cast("bigint").alias("bin"),
                         F.when(i < 0, c("count")).otherwise(0).alias("under"), F.when(i >= bins, c("count")).otherwise(0).alias("over"))
    cells = cells.join(rng.select("_s", "_k", "lo", "width"), "_s", "left").withColumn("_k", F.coalesce("_k", "_other"))
    cells = stored(cells.groupBy(*[c(f"_k.{k}").alias(k) for k in by], "lo", "width", "bin").agg(
        *[F.sum(x).alias(x) for x in ("count", "under", "over", "_s1", "_s2")], F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")), "cells")
    n, base = F.sum("count"), F.coalesce(F.first("lo"), F.lit(0.0))
    m = F.sum("_s1") / n
    moments = cells.groupBy(*by).agg(n.alias("n"), (base + m).alias("mean"), F.sqrt(F.greatest(F.sum("_s2") / n - m * m, F.lit(0.0))).alias("std"),
                                     (base + F.min("_lo")).alias("min"), (base + F.max("_hi")).alias("max"))
    return cells.select(*by, "lo", "width", "bin", "count", "under", "over"), moments


def exact_range(df: DataFrame, by: Sequence[str], val: str, bins: int) -> DataFrame:
    """Bin range from min to max; a constant series gets a unit range around it."""
    g = df.filter(finite(val)).groupBy(*by).agg(F.min(val).cast("double").alias("lo"), F.max(val).cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    g = g.select(*by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    return g.withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))


def hist_acc(df: DataFrame, by: Sequence[str], val: str, range_df: DataFrame, bins: int = N_FINE_BINS) -> DataFrame:
    """Counts per series and bin. Values out of range land in the end bins and are counted there.

    NULL, NaN and infinite values are in no bin; `not_binned` counts them.
    """
    rng = range_df.select(*by, "lo", "width")
    t = join_on(df.filter(finite(val)).select(*by, F.col(val).alias("_v")), checked_broadcast(rng), by, "inner")
    i = F.floor((F.col("_v") - F.col("lo")) / F.col("width"))
    t = t.withColumn("_i", i)
    b = F.least(F.greatest(F.col("_i"), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return (t.groupBy(*by, "lo", "width", b.alias("bin"))
            .agg(F.count("*").alias("count"), F.sum(F.when(F.col("_i") < 0, 1).otherwise(0)).alias("under"),
                 F.sum(F.when(F.col("_i") >= bins, 1).otherwise(0)).alias("over")))


def merge_hist(*hists: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add histograms that share their ranges."""
    h = hists[0]
    for other in hists[1:]:
        h = h.unionByName(other)
    return h.groupBy(*by, "lo", "width", "bin").agg(*[F.sum(c).alias(c) for c in ("count", "under", "over")])


def hist_percentiles(hist: DataFrame, by: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Percentiles (0-100): first bin whose cumulative count reaches the target, linear inside it.

    One row per series and q. The window runs over the bins of a series, of which
    there is a fixed number.
    """
    w = W.partitionBy(*by).orderBy("bin")
    t = hist.withColumns({"_cum": F.sum("count").over(w.rowsBetween(W.unboundedPreceding, 0)),
                          "_n": F.sum("count").over(W.partitionBy(*by))})
    t = t.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    t = t.withColumn("_t", F.col("q") / F.lit(100.0) * F.col("_n"))
    below = F.col("_cum") - F.col("count")
    t = t.filter(((F.col("_cum") >= F.col("_t")) & (below < F.col("_t"))) | ((F.col("_t") <= 0) & (below == 0) & (F.col("count") > 0)))
    frac = (F.col("_t") - (F.col("_cum") - F.col("count"))) / F.col("count")
    return t.select(*by, "q", (F.col("lo") + (F.col("bin") + frac) * F.col("width")).alias("value"))


def percentiles_wide(hist: DataFrame, by: Sequence[str], qs: dict[str, float]) -> DataFrame:
    p = hist_percentiles(hist, by, list(qs.values()))
    return p.groupBy(*by).agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(n) for n, q in qs.items()])


def coarse(hist: DataFrame, by: Sequence[str], n_out: int = N_COARSE_BINS, bins: int = N_FINE_BINS) -> DataFrame:
    """Fine bins summed to exactly `n_out`; empty bins are rows too."""
    if bins % n_out:
        raise ValueError(f"{bins} bins do not divide into {n_out}")
    k = bins // n_out
    got = hist.groupBy(*by, "lo", "width", F.floor(F.col("bin") / k).alias("bin")).agg(F.sum("count").alias("count"))
    zero = (hist.select(*by, "lo", "width").distinct()
            .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1)).cast("array<bigint>"))).withColumn("count", F.lit(0).cast("bigint")))
    t = got.unionByName(zero).groupBy(*by, "lo", "width", "bin").agg(F.sum("count").alias("count"))
    w = F.col("width") * k
    return t.select(*by, "bin", (F.col("lo") + F.col("bin") * w).alias("bin_left"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_right"), "count")


def hist_mode(hist: DataFrame, by: Sequence[str], n_out: int | None = None, bins: int = N_FINE_BINS, out: str = "mode") -> DataFrame:
    """Centre of the fullest bin, at fine or coarse resolution; the lowest bin wins a tie."""
    k = 1 if n_out is None else bins // n_out
    t = hist
    if k > 1:
        t = hist.groupBy(*by, "lo", "width", F.floor(F.col("bin") / k).alias("bin")).agg(F.sum("count").alias("count"))
    best = F.min_by(F.struct("lo", "width", "bin"), F.struct(-F.col("count"), F.col("bin"))).alias("_b")
    return t.groupBy(*by).agg(best).select(*by, (F.col("_b.lo") + (F.col("_b.bin") + 0.5) * (F.col("_b.width") * k)).alias(out))


def approx_mode(df: DataFrame, by: Sequence[str], val: str, bins: int = 200, out: str = "mode") -> DataFrame:
    """Mode from the series' own min-max histogram, last bin closed."""
    return hist_mode(hist_acc(df, by, val, exact_range(df, by, val, bins), bins), by, out=out)


def histogram(df: DataFrame, by: Sequence[str], val: str, bins: int = N_COARSE_BINS) -> DataFrame:
    """Min-max histogram with every bin a row: centre, edges, count, frequency, density."""
    h = hist_acc(df, by, val, exact_range(df, by, val, bins), bins)
    c = coarse(h, by, bins, bins)
    tot = checked_broadcast(h.groupBy(*by).agg(F.sum("count").alias("_n")))
    c = join_on(c, tot, by)
    return c.select(*by, "bin", ((F.col("bin_left") + F.col("bin_right")) / 2).alias("bin_center"), "bin_left", "bin_right", "count",
                    (F.col("count") / F.col("_n")).alias("frequency"),
                    (F.col("count") / (F.col("_n") * (F.col("bin_right") - F.col("bin_left")))).alias("density"))


def kde_mode(hist: DataFrame, moments: DataFrame, by: Sequence[str], grid: int = 1024, out: str = "mode") -> DataFrame:
    """Peak of a Gaussian kernel density (Scott bandwidth) on an even grid from min to max.

    The density is summed over bin counts, so a series costs bins x grid cells
    whatever the number of draws. `moments`: by..., n, std (sample), min, max.
    """
    h = F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("std")
    m = moments.select(*by, h.alias("_h"), F.col("min").alias("_mn"), F.col("max").alias("_mx"), F.col("std").alias("_sd"))
    t = join_on(hist, checked_broadcast(m), by, "inner")
    t = t.withColumn("_c", F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))
    t = t.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    t = t.withColumn("_g", F.col("_mn") + F.col("_k") * ((F.col("_mx") - F.col("_mn")) / F.lit(float(grid - 1))))
    z = (F.col("_g") - F.col("_c")) / F.greatest(F.col("_h"), F.lit(1e-300))
    d = t.groupBy(*by, "_k", "_g", "_sd", "_mn").agg(F.sum(F.col("count") * F.exp(F.lit(-0.5) * z * z)).alias("_d"))
    best = d.groupBy(*by).agg(F.max_by("_g", F.struct(F.round("_d", 9), -F.col("_k"))).alias("_g"), F.max("_sd").alias("_sd"), F.max("_mn").alias("_mn"))
    return best.select(*by, F.when(F.col("_sd") < 1e-12, F.col("_mn")).otherwise(F.col("_g")).alias(out))


def spill_report(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values that fell outside the pilot range, per series."""
    t = hist.groupBy(*by).agg(F.sum(F.col("under") + F.col("over")).alias("spilled"), F.sum("count").alias("total"))
    return t.withColumn("spilled_pct", F.lit(100.0) * F.col("spilled") / F.col("total"))


def box_stats(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    return percentiles_wide(hist, by, {"whisker_lo": 2.5, "q1": 25, "median": 50, "q3": 75, "whisker_hi": 97.5})


def year_stats(hist: DataFrame, moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long statistics table: exact moments plus percentiles and the 50-bin mode."""
    p = percentiles_wide(hist, by, {"p025": 2.5, "median": 50, "p975": 97.5})
    return moments.join(p, list(by)).join(hist_mode(hist, by, N_COARSE_BINS), list(by))
