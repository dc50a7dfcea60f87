"""Statistics over draws: moments, exact percentiles, ranks, sensitivity, bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.operators import histogram as hg
from massweave.operators.groupwise import join_on, share_of
from massweave.scale import checked_broadcast, stored


def moments(df: DataFrame, by: Sequence[str], val: str) -> DataFrame:
    """Exact n, mean, population variance and deviation, min, max in one aggregation."""
    return df.groupBy(*by).agg(F.count(val).alias("n"), F.avg(val).alias("mean"), F.greatest(F.var_pop(val), F.lit(0.0)).alias("var"),
                               F.stddev_pop(val).alias("std"), F.min(val).alias("min"), F.max(val).alias("max"))


def series_totals(draws: DataFrame, sets: Mapping[str, Sequence[str]], base: Sequence[str], val: str) -> DataFrame:
    """Sums per draw by type, by domain and overall, as rows (level, name).

    `sets` maps a level to its column ('' for the overall total). The rows are
    first summed over all level columns, so the grouping sets multiply the
    reduced rows and not the draws of every component.
    """
    cols = [c for c in sets.values() if c]
    fine = draws.groupBy(*base, *cols).agg(F.sum(val).alias("_v"))
    groups = [[*base, c] if c else list(base) for c in sets.values()]
    t = fine.groupingSets([[F.col(x) for x in g] for g in groups], *[F.col(c) for c in [*base, *cols]]).agg(
        F.sum("_v").alias(val), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    level = name = None
    for lv, c in sets.items():
        if not c:
            continue
        hit = F.col(f"_g_{c}") == 0
        level = F.when(hit, lv) if level is None else level.when(hit, lv)
        name = F.when(hit, F.col(c)) if name is None else name.when(hit, F.col(c))
    total = next((lv for lv, c in sets.items() if not c), "Total")
    return t.select(*base, level.otherwise(total).alias("level"), name.otherwise(F.lit(total.upper())).alias("name"), val)


# ---- exact order statistics ------------------------------------------------------
def in_cells(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "cells") -> DataFrame:
    """`df` in order of `by` and `order`, NULLs last, with `_cell` and `_at`, numbers that grow in this order.

    Spark's range partitioner cuts by row counts, so a cell is as large as any
    other whatever the values are; a long series spans several. The table is
    written once: a retried task finds the same cells.
    """
    keys = [F.col(c).asc_nulls_last() for c in [*by, *order]]
    t = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(t.withColumns({"_cell": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)


def offsets(cells: DataFrame, by: Sequence[str], size: Column, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per series and cell: `_off`, the sizes of the series' cells before. One row per series and task, so the window is small."""
    t = cells.groupBy(*by, "_cell").agg(size.alias("_t"), *[c.alias(k) for k, c in (extra or {}).items()])
    off = F.sum("_t").over(W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")
    return stored(t.select(*by, "_cell", off.alias("_off"), *(extra or {})), "offsets")


def value_ranks(df: DataFrame, by: Sequence[str], val: str) -> DataFrame:
    """Distinct known values with their count, the rows before them, and the average-tie rank; NaN is the largest value.

    A `rank()` over a whole series would sort it in one task. Copies collapse
    first (value counts), then values are added up within cells of equal size
    and shifted by the totals of the cells before.
    """
    vc = df.filter(F.col(val).isNotNull()).groupBy(*by, val).agg(F.count("*").alias("count"))
    vc = in_cells(vc, by, [val], "value_counts")
    cum = F.sum("count").over(W.partitionBy(*by, "_cell").orderBy(val).rowsBetween(W.unboundedPreceding, 0))
    t = join_on(vc.withColumn("_cum", cum), offsets(vc, by, F.sum("count")), [*by, "_cell"], "inner")
    b = F.col("_off") + F.col("_cum") - F.col("count")
    return t.select(*by, val, "count", b.alias("before"), (b + (F.col("count") + 1) / 2.0).alias("rank"))


def avg_rank(df: DataFrame, by: Sequence[str], val: str, out: str = "rank") -> DataFrame:
    """Average-tie rank on every row, NULL where the value is; a hot value's join is split by AQE."""
    return join_on(df, value_ranks(df, by, val).select(*by, val, F.col("rank").alias(out)), [*by, val], "left")


#: A percentile's bracket reaches so many times the error of the sketch to both sides.
BRACKET = 2


def exact_percentiles(df: DataFrame, by: Sequence[str], val: str, qs: Mapping[str, float], accuracy: int = 4000) -> DataFrame:
    """Exact percentiles (0-100) with linear interpolation, one column per name; NaN is the largest value, NULLs do not count.

    Selection without a sort: a mergeable quantile sketch of each series gives a
    bracket of values around every target. Values between brackets are only
    counted, those within (about 4 / `accuracy` of a series per target, copies
    once; a short series' whole) are ordered, and the two order statistics around
    the target are read off. (`percentile` would hold a series' whole value map in one task.) The
    sketch is written once, so both passes use the same brackets.
    """
    names, x = list(qs), F.nanvl(F.col(val).cast("double"), F.lit(float("inf")))
    known = df.filter(F.col(val).isNotNull()).select(*by, x.alias("_x"), F.col(val).cast("double").alias("_v"))
    share = [min(max(float(qs[k]) / 100.0 + side * BRACKET / accuracy, 0.0), 1.0) for k in names for side in (-1, 1)]
    cuts = known.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"),
                                  F.percentile_approx("_x", share, accuracy).alias("_q"))
    short = F.col("_n") <= 2 * BRACKET * accuracy             # a bracket would be narrower than a few rows
    ends = [(F.when(short | F.lit(share[2 * i] <= 0), F.col("_mn")).otherwise(F.col("_q")[2 * i]),
             F.when(short | F.lit(share[2 * i + 1] >= 1), F.col("_mx")).otherwise(F.col("_q")[2 * i + 1])) for i in range(len(names))]
    cuts = stored(cuts.select(*by, "_n", *[e.alias(f"_{side}{i}") for i, lh in enumerate(ends) for side, e in zip("lh", lh)]), "brackets")
    t = join_on(known, cuts, by, "inner")
    inside = reduce(lambda a, b: a | b, [(F.col("_x") >= F.col(f"_l{i}")) & (F.col("_x") <= F.col(f"_h{i}")) for i in range(len(names))])
    gap = sum((F.when(F.col("_x") > F.col(f"_h{i}"), 1).otherwise(0) for i in range(len(names))), F.lit(0))
    t = t.groupBy(*by, F.when(~inside, gap).alias("_gap"), F.when(inside, F.col("_v")).alias("_v")).agg(
        F.count("*").alias("count"), F.max("_x").alias("_o"), F.first("_n").alias("_n"))
    cum = F.sum("count").over(W.partitionBy(*by).orderBy("_o").rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("_before", cum - F.col("count"))
    pick = {}
    for i, k in enumerate(names):
        pos = F.lit(float(qs[k]) / 100.0) * (F.col("_n") - 1)
        low = F.floor(pos)
        holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("count"))
        pick |= {f"_a{i}": F.max(F.when(holds(low), F.col("_v"))), f"_b{i}": F.max(F.when(holds(F.least(low + 1, F.col("_n") - 1)), F.col("_v"))),
                 f"_f{i}": F.max(pos - low)}
    t = t.groupBy(*by).agg(*[c.alias(k) for k, c in pick.items()])
    between = lambda i: F.when(F.col(f"_f{i}") == 0, F.col(f"_a{i}")).otherwise(F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}")))
    return t.select(*by, *[between(i).alias(k) for i, k in enumerate(names)])


TEN = {"p025": 2.5, "p25": 25, "p50": 50, "p75": 75, "p975": 97.5}


def summary_stats(df: DataFrame, by: Sequence[str], val: str, variant: str = "ten", bins: int = 200) -> DataFrame:
    """Ten statistics; 'motor' takes the KDE mode, 'element' P05 / P50 / P95."""
    m = moments(df, by, val).drop("var")
    if variant == "element":
        return m.join(exact_percentiles(df, by, val, {"p05": 5, "p50": 50, "p95": 95}), list(by))
    p = exact_percentiles(df, by, val, TEN if variant == "ten" else {k: TEN[k] for k in ("p025", "p50", "p975")})
    if variant == "ten":
        mode = hg.approx_mode(df, by, val, bins)
    else:
        rng = hg.exact_range(df, by, val, 1000)
        sd = df.groupBy(*by).agg(F.count(val).alias("n"), F.stddev_samp(val).alias("std"), F.min(val).alias("min"), F.max(val).alias("max"))
        mode = hg.kde_mode(hg.hist_acc(df, by, val, rng, 1000), sd, by)
    return m.join(p, list(by)).join(mode, list(by))


# ---- sensitivity -----------------------------------------------------------------
def corr_with(df: DataFrame, by: Sequence[str], series: Sequence[str], ref: str) -> DataFrame:
    """Correlation of every series column with the reference column; no variance reads NULL."""
    flat = lambda c: F.var_pop(c) <= 0
    one = df.groupBy(*by).agg(*[F.when(flat(s) | flat(ref), F.lit(None)).otherwise(F.corr(s, ref)).alias(s) for s in series])
    return one.unpivot(list(by), list(series), "series", "corr")


def variance_share(df: DataFrame, by: Sequence[str], parts: Sequence[str], total: str) -> DataFrame:
    """var(part) / var(total); a constant total reads NULL."""
    t = F.var_pop(total)
    one = df.groupBy(*by).agg(*[(F.var_pop(p) / F.nullif(t, F.lit(0.0))).alias(p) for p in parts])
    return one.unpivot(list(by), list(parts), "part", "share")


def ranked(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(by..., column, value, rank): average-tie ranks of all `cols`, from one ordered pass over their value counts."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_val")) for i, c in enumerate(cols)])).alias("_e"))
    return value_ranks(long.select(*by, "_e.*"), [*by, "_col"], "_val")


def _rhos(df: DataFrame, by: Sequence[str], drivers: Sequence[str], result: str) -> DataFrame:
    """(by..., driver, rho) of complete rows: equal (driver, result) pairs are one weighted row, ranks are joined on once for all drivers."""
    ranks = ranked(df, by, [*drivers, result]).select(*by, "_col", "_val", "rank")
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(d).cast("double").alias("_val")) for i, d in enumerate(drivers)])).alias("_e")
    w = df.select(*by, F.col(result).cast("double").alias("_y"), pair).select(*by, "_y", "_e.*").groupBy(*by, "_col", "_val", "_y").agg(F.count("*").alias("_w"))
    rx = ranks.filter(F.col("_col") < len(drivers)).withColumnRenamed("rank", "_rx")
    ry = ranks.filter(F.col("_col") == len(drivers)).select(*by, F.col("_val").alias("_y"), F.col("rank").alias("_ry"))
    j = join_on(join_on(w, rx, [*by, "_col", "_val"], "inner"), ry, [*by, "_y"], "inner")
    wt, x, y = F.col("_w"), F.col("_rx"), F.col("_ry")
    t = j.groupBy(*by, "_col").agg(F.sum(wt).alias("_n"), *[F.sum(wt * a * b).alias(n) for n, a, b in (("_xy", x, y), ("_xx", x, x), ("_yy", y, y))])
    mid = F.col("_n") * ((F.col("_n") + 1) / 2.0) * ((F.col("_n") + 1) / 2.0)      # ranks of any column have this mean
    spread = lambda c: F.when(F.col(c) - mid > mid * 1e-13, F.col(c) - mid)        # NULL where only rounding is left
    den = F.sqrt(spread("_xx") * spread("_yy"))
    name = F.element_at(F.array(*[F.lit(d) for d in drivers]), F.col("_col") + 1)
    return t.select(*by, name.alias("driver"), ((F.col("_xy") - mid) / den).alias("rho"))


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Correlation of average-tie ranks over the rows where both values are known."""
    return _rhos(df.select(*by, x, y).na.drop(subset=[x, y]), by, [x], y).select(*by, F.col("rho").alias(out))


def rho_shares(df: DataFrame, by: Sequence[str], drivers: Sequence[str], result: str) -> DataFrame:
    """Spearman rho of each driver with the result, and rho^2 over the sum of rho^2, over rows where all are known."""
    t = _rhos(df.select(*by, *drivers, result).na.drop(subset=[*drivers, result]), by, drivers, result)
    t = t.withColumn("_r2", F.coalesce(F.col("rho") * F.col("rho"), F.lit(0.0)))
    return share_of(t, by, "_r2", "share", bounded=True).drop("_r2")


# ---- tables ----------------------------------------------------------------------
def range_midpoints(df: DataFrame, by: Sequence[str], lo: str, hi: str, factor: str | None = None) -> DataFrame:
    """Average of the bounds per group, and the expected total with the factor."""
    f = F.col(factor) if factor else F.lit(1.0)
    return df.groupBy(*by).agg(((F.avg(lo) + F.avg(hi)) / 2.0).alias("avg_count"), F.sum((F.col(lo) + F.col(hi)) / 2.0 * f).alias("expected_total"))


def value_counts(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct])


def summary_matrix(df: DataFrame, measures: Mapping[str, Mapping[str, str]], total: str = "TOTAL") -> DataFrame:
    """Type x column table of sums with a TOTAL row: {type: {output column: input column}}."""
    outs = list(next(iter(measures.values())))
    one = df.agg(*[F.sum(c).alias(f"{t}|{o}") for t, m in measures.items() for o, c in m.items()])
    rows = F.array(*[F.struct(F.lit(t).alias("type"), *[F.col(f"`{t}|{o}`").alias(o) for o in outs]) for t in measures])
    long = one.select(F.explode(rows).alias("s")).select("s.*")
    return long.rollup("type").agg(*[F.sum(o).alias(o) for o in outs]).withColumn("type", F.coalesce("type", F.lit(total)))


def grand_totals(draws: DataFrame, segment: str, category: str, size: str, item: str, val: str) -> DataFrame:
    """Draw-wise totals: per size, per category ('all' sizes) and per segment ('TOTAL'); all-zero series are left out.

    The draws are summed once and these sums are written, since what follows
    and most readers pass over them several times.
    """
    base = [segment, item, "draw"]
    fine = stored(draws.groupBy(*base, category, size).agg(F.sum(val).alias(val)), "totals")
    c = F.col
    sets = [[c(x) for x in (*base, category, size)], [c(x) for x in (*base, size)], [c(x) for x in (*base, category)], [c(x) for x in base]]
    t = fine.groupingSets(sets, *[c(x) for x in (*base, category, size)]).agg(F.sum(val).alias(val))
    t = t.withColumns({category: F.coalesce(c(category), F.lit("TOTAL")), size: F.coalesce(c(size), F.lit("all"))})
    keys = [segment, category, size, item]
    live = t.groupBy(*keys).agg(F.max(F.abs(c(val))).alias("_m")).filter("_m > 0").drop("_m")
    return join_on(t, checked_broadcast(live), keys, "inner")


def compare_segments(df: DataFrame, segment: str, values: Sequence[str], stats: Mapping[str, Column], rows: Sequence[str] = ()) -> DataFrame:
    """One row per item, one column per segment and statistic."""
    aggs = []
    for v in values:
        for name, col in stats.items():
            aggs.append(F.max(F.when(F.col(segment) == v, col)).alias(f"{v}_{name}"))
    return df.groupBy(*rows).agg(*aggs)


def breakdown(df: DataFrame, by: Sequence[str], val: str, row: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(val).alias("total"), F.avg(val).alias("mean"), F.countDistinct(row).alias("n_locations"))


def collapse(df: DataFrame, by: Sequence[str], vals: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(v).alias(v) for v in vals])


def clip_band(df: DataFrame, mean: str, lo: str, hi: str) -> DataFrame:
    """Force lo <= mean <= hi; `clipped` marks the rows that needed it."""
    c = F.col
    return df.withColumns({"clipped": (c(lo) > c(mean)) | (c(hi) < c(mean)), lo: F.least(c(lo), c(mean)), hi: F.greatest(c(hi), c(mean))})


def sum_band(df: DataFrame, by: Sequence[str], vals: Sequence[str]) -> DataFrame:
    """Sum mean and bounds; the summed bounds are a comonotonic bound, not a band."""
    return collapse(df, by, vals).withColumn("band_meaning", F.lit("comonotonic bound"))


def band_width(mean: str, lo: str, hi: str) -> Column:
    return (F.col(hi) - F.col(lo)) / F.nullif(F.col(mean), F.lit(0.0)) * F.lit(100.0)


def cv_rank(df: DataFrame, by: Sequence[str], val: str) -> DataFrame:
    """Coefficient of variation per series and its rank, the most uncertain first; one row per series is ranked."""
    t = df.groupBy(*by).agg(F.avg(val).alias("mean"), F.stddev_pop(val).alias("std"))
    t = t.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)))
    return t.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("cv", 9)), *by)))


def overview(df: DataFrame, by: Sequence[str], y0: int, y1: int, kind: str, mean: str, lo: str, hi: str) -> DataFrame:
    at = lambda c, y: F.sum(F.when(F.col("year") == y, F.col(c)).otherwise(0.0))
    t = df.groupBy(*by).agg(at(mean, y0).alias("g_base"), at(lo, y0).alias("lo_base"), at(hi, y0).alias("hi_base"), at(mean, y1).alias("g_end"),
                            F.countDistinct(kind).alias("n_types"))
    return t.withColumns({"change_pct": (F.col("g_end") / F.nullif(F.col("g_base"), F.lit(0.0)) - 1.0) * 100.0,
                          "band_pct": band_width("g_base", "lo_base", "hi_base")})


def rollup_rounded(df: DataFrame, by: Sequence[str], vals: Sequence[str], years: Sequence[int], digits: int) -> DataFrame:
    return df.filter(F.col("year").isin(list(years))).groupBy(*by).agg(*[F.round(F.sum(v), digits).alias(v) for v in vals])


def mean_contribution(df: DataFrame, by: Sequence[str], vals: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in vals])


def mean_by_year(static: DataFrame, dynamic: DataFrame, by: Sequence[str], draws: DataFrame, y0: int, y1: int) -> DataFrame:
    """Static midpoint product plus the mean of the dynamic rows over all draws, per year.

    `static`: by..., lo, hi, unit; `dynamic`: by..., year, value; `draws`: one
    row per draw, counted, so a draw without a dynamic row counts as zero. The
    static part carries no year until it is one number per key.
    """
    s = static.groupBy(*by).agg(F.sum((F.col("lo") + F.col("hi")) / 2.0 * F.col("unit")).alias("_s"))
    s = s.withColumn("year", F.explode(F.sequence(F.lit(y0), F.lit(y1))))
    n = draws.agg(F.count("*").cast("double").alias("_n"))                     # one row
    d = dynamic.groupBy(*by, "year").agg(F.sum("value").alias("_d")).crossJoin(F.broadcast(n))
    j = s.join(d.select(*by, "year", (F.col("_d") / F.col("_n")).alias("_d")), [*by, "year"], "full")
    return j.select(*by, "year", (F.coalesce("_s", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0))).alias("mean"))
