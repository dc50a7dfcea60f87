"""G and W: aggregations, statistics, windows."""

from pyspark.sql import functions as F

from massweave.operators import curves as cv
from massweave.operators import groupwise as gw
from massweave.operators import histogram as hg
from massweave.operators import stats as st
from massweave.operators import windows as wn
from massweave.queries import curves as qc
from massweave.queries import draws as qd
from massweave.queries._base import (COMPONENTS_SQL, RANGES_SQL, SEG_SQL, components, query, r, ranges, segment_col, sql_at,
                                     sql_md5, sql_uni, table)

PRICES_SQL = "prices AS (SELECT " + SEG_SQL + " AS segment, l_linestatus AS name, CAST(year(l_shipdate) AS INTEGER) AS year, l_extendedprice AS v, l_quantity AS q, l_orderkey, l_suppkey FROM lineitem)"


def prices(spark, sf):
    return table(spark, sf, "lineitem").select(segment_col().alias("segment"), F.col("l_linestatus").alias("name"), F.year("l_shipdate").alias("year"),
                                               F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"), "l_orderkey", "l_suppkey")


KEY = ["segment", "name"]


def hist_sql(src, by, v, name="h", bins=1000, where="true"):
    """CTEs: range by min/max widened by 35 %, then bin counts."""
    on = " AND ".join(f"p.{k} = r.{k}" for k in by.split(", "))
    pk = ", ".join(f"p.{k}" for k in by.split(", "))
    return f"""{name}_mm AS (SELECT {by}, min({v}) AS mn, max({v}) AS mx FROM {src} WHERE {where} GROUP BY ALL),
 {name}_sp AS (SELECT *, CASE WHEN mx - mn <= 0 THEN 1.0::DOUBLE ELSE mx - mn END AS span FROM {name}_mm),
 {name}_r AS (SELECT {by}, mn - 0.35::DOUBLE * span / 2 AS lo, mx + 0.35::DOUBLE * span / 2 AS hi, ((mx + 0.35::DOUBLE * span / 2) - (mn - 0.35::DOUBLE * span / 2)) / {bins} AS width FROM {name}_sp),
 {name} AS (SELECT {pk}, lo, width, CAST(least(greatest(floor(({v} - lo) / width), 0), {bins - 1}) AS BIGINT) AS bin, count(*) AS count,
   CAST(sum(CASE WHEN floor(({v} - lo) / width) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS under, CAST(sum(CASE WHEN floor(({v} - lo) / width) >= {bins} THEN 1 ELSE 0 END) AS BIGINT) AS over
   FROM {src} p JOIN {name}_r r ON {on} GROUP BY ALL)"""


def pct_sql(h, by, qs, name="p"):
    """CTE with one column per percentile read off histogram `h`."""
    pick = ", ".join(f"max(CASE WHEN cum >= {q / 100.0!r}::DOUBLE * n AND cum - count < {q / 100.0!r}::DOUBLE * n THEN lo + (bin + ({q / 100.0!r}::DOUBLE * n - (cum - count)) / count) * width END) AS {c}" for c, q in qs.items())
    return f"""{name}_c AS (SELECT *, sum(count) OVER (PARTITION BY {by} ORDER BY bin) AS cum, sum(count) OVER (PARTITION BY {by}) AS n FROM {h}),
 {name} AS (SELECT {by}, {pick} FROM {name}_c GROUP BY ALL)"""


def mode_sql(h, by, k=1, name="m"):
    return f"""{name}_b AS (SELECT {by}, lo, width, bin // {k} AS b, sum(count) AS c FROM {h} GROUP BY ALL),
 {name} AS (SELECT {by}, arg_min(lo + (b + 0.5::DOUBLE) * (width * {k}), (-c, b)) AS mode FROM {name}_b GROUP BY ALL)"""


H_SQL = PRICES_SQL + ", " + hist_sql("prices", "segment, name", "v")


def fine_hist(spark, sf):
    p = prices(spark, sf)
    return hg.hist_acc(p, KEY, "v", hg.pilot_range(p, KEY, "v"))


@query("g01_series_totals", "WITH " + qd.COUNTS_SQL + """
SELECT segment, CAST(draw AS INTEGER) AS draw, 'SensorType' AS level, sensor_type AS name, round(sum(value), 3) AS value FROM counts GROUP BY ALL
UNION ALL SELECT segment, CAST(draw AS INTEGER), 'Domain', domain, round(sum(value), 3) FROM counts GROUP BY ALL
UNION ALL SELECT segment, CAST(draw AS INTEGER), 'Total', 'TOTAL', round(sum(value), 3) FROM counts GROUP BY ALL""")
def g01(spark, sf):
    t = st.series_totals(qd.counts(spark, sf), {"SensorType": "sensor_type", "Domain": "domain", "Total": ""}, ["segment", "draw"], "value")
    return t.withColumn("value", r("value", 3))


@query("g02_hist_acc", "WITH " + H_SQL + " SELECT segment, name, bin, count, under, over, round(lo, 6) AS lo, round(width, 6) AS width FROM h")
def g02(spark, sf):
    return fine_hist(spark, sf).withColumns({"lo": r("lo"), "width": r("width")})


@query("g03_pilot_range", "WITH " + qd.COUNTS_SQL + """, t AS (SELECT segment, domain, draw, sum(value) AS v FROM counts GROUP BY ALL), """
       + hist_sql("t", "segment, domain", "v", where="draw < 2") + " SELECT segment, domain, round(lo, 3) AS lo, round(hi, 3) AS hi, round(width, 5) AS width FROM h_r")
def g03(spark, sf):
    t = qd.counts(spark, sf).groupBy("segment", "domain", "draw").agg(F.sum("value").alias("v"))
    g = hg.pilot_range(t, ["segment", "domain"], "v", pilot=F.col("draw") < 2)       # the first draws are the pilot
    return g.select("segment", "domain", r("lo", 3).alias("lo"), r("hi", 3).alias("hi"), r("width", 5).alias("width"))


@query("g04_moments", "WITH " + PRICES_SQL + """ SELECT segment, name, count(v) AS n, round(avg(v), 5) AS mean, round(var_pop(v), 1) AS var, round(stddev_pop(v), 5) AS std, min(v) AS min, max(v) AS max FROM prices GROUP BY ALL""")
def g04(spark, sf):
    m = st.moments(prices(spark, sf), KEY, "v")
    return m.withColumns({"mean": r("mean", 5), "var": r("var", 1), "std": r("std", 5)})


QS = {"p025": 2.5, "p25": 25, "p50": 50, "p75": 75, "p975": 97.5}
QEX = "round(quantile_cont({v}, 0.025), 6) AS p025, round(quantile_cont({v}, 0.25), 6) AS p25, round(quantile_cont({v}, 0.5), 6) AS p50, round(quantile_cont({v}, 0.75), 6) AS p75, round(quantile_cont({v}, 0.975), 6) AS p975"


@query("g05_hist_percentile", "WITH " + H_SQL + ", " + pct_sql("h", "segment, name", QS) + " SELECT segment, name, " + ", ".join(f"round({c}, 7) AS {c}" for c in QS) + " FROM p")
def g05(spark, sf):
    p = hg.percentiles_wide(fine_hist(spark, sf), KEY, QS)
    return p.select(*KEY, *[r(c, 7).alias(c) for c in QS])


@query("g06_exact_percentiles", "WITH " + PRICES_SQL + " SELECT segment, name, " + QEX.format(v="v") + " FROM prices GROUP BY ALL")
def g06(spark, sf):
    p = st.exact_percentiles(prices(spark, sf), KEY, "v", QS)
    return p.select(*KEY, *[r(c).alias(c) for c in QS])


COARSE_SQL = H_SQL + """, grid AS (SELECT DISTINCT segment, name, lo, width, b FROM h, range(50) t(b)),
 c50 AS (SELECT segment, name, b AS bin, lo + b * (width * 20) AS bin_left, lo + (b + 1) * (width * 20) AS bin_right, n AS count FROM (
   SELECT g.segment, g.name, g.b, g.lo, g.width, CAST(coalesce(sum(h.count), 0) AS BIGINT) AS n
   FROM grid g LEFT JOIN h ON h.segment = g.segment AND h.name = g.name AND h.bin // 20 = g.b GROUP BY g.segment, g.name, g.b, g.lo, g.width))"""


@query("g07_coarse", "WITH " + COARSE_SQL + " SELECT segment, name, bin, round(bin_left, 7) AS bin_left, round(bin_right, 7) AS bin_right, count FROM c50")
def g07(spark, sf):
    c = hg.coarse(fine_hist(spark, sf), KEY)
    return c.withColumns({"bin_left": r("bin_left", 7), "bin_right": r("bin_right", 7)})


@query("g08_hist_mode", "WITH " + H_SQL + ", " + mode_sql("h", "segment, name", 1, "mf") + ", " + mode_sql("h", "segment, name", 20, "mc") + """
SELECT segment, name, round(mf.mode, 7) AS fine, round(mc.mode, 7) AS coarse FROM mf JOIN mc USING (segment, name)""")
def g08(spark, sf):
    h = fine_hist(spark, sf)
    a, b = hg.hist_mode(h, KEY, out="fine"), hg.hist_mode(h, KEY, 50, out="coarse")
    return a.join(b, KEY).select(*KEY, r("fine", 7).alias("fine"), r("coarse", 7).alias("coarse"))


def exact_hist_sql(src, by, v, k, name="x"):
    pk = ", ".join(f"p.{c}" for c in by.split(", "))
    on = " AND ".join(f"p.{c} = r.{c}" for c in by.split(", "))
    return f"""{name}_r AS (SELECT {by}, CASE WHEN min({v}) = max({v}) THEN min({v}) - 0.5 ELSE min({v}) END AS lo, CASE WHEN min({v}) = max({v}) THEN max({v}) + 0.5 ELSE max({v}) END AS hi FROM {src} GROUP BY ALL),
 {name} AS (SELECT {pk}, lo, (hi - lo) / {k} AS width, CAST(least(floor(({v} - lo) / ((hi - lo) / {k})), {k - 1}) AS BIGINT) AS bin, count(*) AS count FROM {src} p JOIN {name}_r r ON {on} GROUP BY ALL)"""


@query("g09_approx_mode", "WITH " + PRICES_SQL + ", " + exact_hist_sql("prices", "segment, name", "v", 200) + ", " + mode_sql("x", "segment, name") + " SELECT segment, name, round(mode, 7) AS mode FROM m")
def g09(spark, sf):
    return hg.approx_mode(prices(spark, sf), KEY, "v", 200).withColumn("mode", r("mode", 7))


EXPORT_SQL = PRICES_SQL + ", " + exact_hist_sql("prices", "segment, name", "v", 50) + """, grid AS (SELECT DISTINCT segment, name, lo, width, b FROM x, range(50) t(b)), tot AS (SELECT segment, name, count(*) AS n FROM prices GROUP BY ALL),
 e AS (SELECT g.segment, g.name, g.b AS bin, g.lo + g.b * g.width AS l, g.lo + (g.b + 1) * g.width AS rr, CAST(coalesce(sum(x.count), 0) AS BIGINT) AS count FROM grid g LEFT JOIN x ON x.segment = g.segment AND x.name = g.name AND x.bin = g.b GROUP BY g.segment, g.name, g.b, g.lo, g.width)"""


@query("g10_histogram", "WITH " + EXPORT_SQL + " SELECT segment, name, bin, round((l + rr) / 2, 7) AS bin_center, round(l, 7) AS bin_left, round(rr, 7) AS bin_right, count, round(count / n, 9) AS frequency FROM e JOIN tot USING (segment, name)")
def g10(spark, sf):
    h = hg.histogram(prices(spark, sf), KEY, "v", 50)
    return h.select(*KEY, "bin", r("bin_center", 7).alias("bin_center"), r("bin_left", 7).alias("bin_left"), r("bin_right", 7).alias("bin_right"), "count", r("frequency", 9).alias("frequency"))


@query("g11_histogram_density", "WITH " + EXPORT_SQL + " SELECT segment, name, bin, count, round(count / (n * (rr - l)), 12) AS density FROM e JOIN tot USING (segment, name)")
def g11(spark, sf):
    return hg.histogram(prices(spark, sf), KEY, "v", 50).select(*KEY, "bin", "count", r("density", 12).alias("density"))


AREA_TOTAL_SQL = qd.area_sql(20) + ", tot AS (SELECT brand, draw, sum(area_small) AS small, sum(area_medium) AS medium, sum(area_large) AS large, sum(area_small) + sum(area_medium) + sum(area_large) AS total FROM areas GROUP BY ALL)"


def area_totals(spark, sf):
    t = qd.areas(spark, sf).groupBy("brand", "draw").agg(*[F.sum(f"area_{s}").alias(s) for s in ("small", "medium", "large")])
    return t.withColumn("total", F.col("small") + F.col("medium") + F.col("large"))


@query("g12_corr_with", "WITH " + AREA_TOTAL_SQL + " " + " UNION ALL ".join(
    f"SELECT brand, '{s}' AS series, CASE WHEN var_pop({s}) <= 0 OR var_pop(total) <= 0 THEN NULL ELSE round(corr({s}, total), 7) END AS corr FROM tot GROUP BY brand" for s in ("small", "medium", "large")))
def g12(spark, sf):
    return st.corr_with(area_totals(spark, sf), ["brand"], ["small", "medium", "large"], "total").withColumn("corr", r("corr", 7))


@query("g13_variance_share", "WITH " + AREA_TOTAL_SQL + " " + " UNION ALL ".join(
    f"SELECT brand, '{s}' AS part, round(var_pop({s}) / nullif(var_pop(total), 0), 7) AS share FROM tot GROUP BY brand" for s in ("small", "medium", "large")))
def g13(spark, sf):
    return st.variance_share(area_totals(spark, sf), ["brand"], ["small", "medium", "large"], "total").withColumn("share", r("share", 7))


def spearman_sql(src, by, x, y, name):
    a = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE"
    return f"{name}_k AS (SELECT {by}, {a(x)} AS rx, {a(y)} AS ry FROM {src}), {name} AS (SELECT {by}, corr(rx, ry) AS rho FROM {name}_k GROUP BY ALL)"


@query("g14_spearman", "WITH li AS (SELECT *, " + SEG_SQL + " AS segment FROM lineitem), " + spearman_sql("li", "segment", "l_quantity", "l_extendedprice", "a") + ", " + spearman_sql("li", "segment", "l_discount", "l_extendedprice", "b") + """,
 u AS (SELECT 'l_quantity' AS driver, * FROM a UNION ALL SELECT 'l_discount', * FROM b)
SELECT segment, driver, round(rho, 8) AS rho, round(rho * rho / sum(rho * rho) OVER (PARTITION BY segment), 8) AS share FROM u""")
def g14(spark, sf):
    li = table(spark, sf, "lineitem").select(segment_col().alias("segment"), "l_quantity", "l_discount", "l_extendedprice")
    return st.rho_shares(li, ["segment"], ["l_quantity", "l_discount"], "l_extendedprice").withColumns({"rho": r("rho", 8), "share": r("share", 8)})


KDE_SQL = exact_hist_sql("prices", "segment, name", "v", 1000, "kx") + """, km AS (SELECT segment, name, pow(CAST(count(*) AS DOUBLE), -0.2::DOUBLE) * stddev_samp(v) AS hh, min(v) AS mn, max(v) AS mx FROM prices GROUP BY ALL),
 kd AS (SELECT x.segment, x.name, k, mn + k * ((mx - mn) / 1023) AS g, round(sum(count * exp(-0.5::DOUBLE * pow((mn + k * ((mx - mn) / 1023) - (lo + (bin + 0.5::DOUBLE) * width)) / hh, 2))), 9) AS d FROM kx x JOIN km m ON x.segment = m.segment AND x.name = m.name, range(1024) t(k) GROUP BY ALL),
 kde AS (SELECT segment, name, arg_max(g, (d, -k)) AS mode FROM kd GROUP BY ALL)"""


@query("g15_kde_mode", "WITH " + PRICES_SQL + ", " + KDE_SQL + " SELECT segment, name, round(mode, 7) AS mode FROM kde")
def g15(spark, sf):
    p = prices(spark, sf)
    h = hg.hist_acc(p, KEY, "v", hg.exact_range(p, KEY, "v", 1000), 1000)
    m = p.groupBy(*KEY).agg(F.count("v").alias("n"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return hg.kde_mode(h, m, KEY).withColumn("mode", r("mode", 7))


@query("g16_range_midpoints", "WITH " + RANGES_SQL + " SELECT segment, domain, round((avg(lo) + avg(hi)) / 2, 7) AS avg_count, round(sum((lo + hi) / 2 * (p_size / 50.0::DOUBLE)), 2) AS expected_total FROM ranges GROUP BY ALL")
def g16(spark, sf):
    x = ranges(spark, sf).withColumn("f", F.col("p_size") / F.lit(50.0))
    return st.range_midpoints(x, ["segment", "domain"], "lo", "hi", "f").withColumns({"avg_count": r("avg_count", 7), "expected_total": r("expected_total", 2)})


@query("g17_value_counts", "SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS n_p_brand, count(DISTINCT p_name) AS n_p_name FROM part GROUP BY 1")
def g17(spark, sf):
    return st.value_counts(table(spark, sf, "part"), ["p_type"], ["p_brand", "p_name"])


@query("g18_summary_matrix", "WITH " + COMPONENTS_SQL + """, x AS (SELECT 'Stepper' AS type, sum(step_min) AS lo, sum(step_max) AS hi FROM components UNION ALL SELECT 'DC small', sum(dcs_min), sum(dcs_max) FROM components UNION ALL SELECT 'DC medium', sum(dcm_min), sum(dcm_max) FROM components)
SELECT * FROM x UNION ALL SELECT 'TOTAL', sum(lo), sum(hi) FROM x""")
def g18(spark, sf):
    return st.summary_matrix(components(spark, sf), {"Stepper": {"lo": "step_min", "hi": "step_max"}, "DC small": {"lo": "dcs_min", "hi": "dcs_max"}, "DC medium": {"lo": "dcm_min", "hi": "dcm_max"}})


# element mass draws by category (brand) and size class
GT_SQL = qd.area_sql(20) + """, el AS (SELECT domain AS segment, brand AS category, 'small' AS size, CASE WHEN p_size % 2 = 0 THEN 'Cu' ELSE 'Au' END AS element, draw, area_small * p_size / 1000 AS mass FROM areas
  UNION ALL SELECT domain, brand, 'medium', CASE WHEN p_size % 2 = 0 THEN 'Cu' ELSE 'Au' END, draw, area_medium * p_size / 1000 FROM areas
  UNION ALL SELECT domain, brand, 'large', CASE WHEN p_size % 2 = 0 THEN 'Cu' ELSE 'Au' END, draw, area_large * p_size / 1000 FROM areas),
 gt0 AS (SELECT segment, category, size, element, draw, sum(mass) AS mass FROM el GROUP BY ALL UNION ALL SELECT segment, 'TOTAL', size, element, draw, sum(mass) FROM el GROUP BY ALL
  UNION ALL SELECT segment, category, 'all', element, draw, sum(mass) FROM el GROUP BY ALL UNION ALL SELECT segment, 'TOTAL', 'all', element, draw, sum(mass) FROM el GROUP BY ALL),
 gt AS (SELECT * FROM gt0 JOIN (SELECT segment, category, size, element FROM gt0 GROUP BY ALL HAVING max(abs(mass)) > 0) USING (segment, category, size, element))"""


def element_draws(spark, sf):
    a = qd.areas(spark, sf).withColumn("element", F.when(F.col("p_size") % 2 == 0, "Cu").otherwise("Au"))
    parts = F.array(*[F.struct(F.lit(s).alias("size"), (F.col(f"area_{s}") * F.col("p_size") / 1000).alias("mass")) for s in ("small", "medium", "large")])
    return a.select(F.col("domain").alias("segment"), F.col("brand").alias("category"), "element", "draw", F.explode(parts).alias("p")).select(
        "segment", "category", "element", "draw", "p.size", "p.mass")


def totals(spark, sf):
    return st.grand_totals(element_draws(spark, sf), "segment", "category", "size", "element", "mass")


@query("g19_grand_totals", "WITH " + GT_SQL + " SELECT segment, category, size, element, count(*) AS n, round(avg(mass), 6) AS mean, round(max(mass), 6) AS max, round(quantile_cont(mass, 0.5), 6) AS p50 FROM gt GROUP BY ALL")
def g19(spark, sf):
    t, key = totals(spark, sf), ["segment", "category", "size", "element"]
    m = st.moments(t, key, "mass").select(*key, "n", r("mean").alias("mean"), r("max").alias("max"))
    return gw.join_on(m, st.exact_percentiles(t, key, "mass", {"p50": 50}), key).withColumn("p50", r("p50"))


@query("g20_summary_stats", "WITH " + PRICES_SQL + ", " + exact_hist_sql("prices", "segment, name", "v", 200) + ", " + mode_sql("x", "segment, name") + """,
 s AS (SELECT segment, name, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, min(v) AS min, max(v) AS max, """ + QEX.format(v="v") + """ FROM prices GROUP BY ALL)
SELECT s.*, round(m.mode, 7) AS mode FROM s JOIN m USING (segment, name)""")
def g20(spark, sf):
    s = st.summary_stats(prices(spark, sf), KEY, "v")
    return s.withColumns({"mean": r("mean", 5), "std": r("std", 5), "mode": r("mode", 7), **{c: r(c) for c in QS}})


@query("g21_summary_variants", "WITH " + PRICES_SQL + ", " + KDE_SQL + """
SELECT segment, name, count(*) AS n, round(avg(v), 5) AS mean, round(quantile_cont(v, 0.025), 6) AS p025, round(quantile_cont(v, 0.975), 6) AS p975, any_value(round(mode, 7)) AS kde_mode,
 round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, round(avg(q / 50), 9) AS mean_fraction FROM prices JOIN kde USING (segment, name) GROUP BY ALL""")
def g21(spark, sf):
    p = prices(spark, sf)
    a = st.summary_stats(p, KEY, "v", "motor").select(*KEY, "n", r("mean", 5).alias("mean"), r("p025").alias("p025"), r("p975").alias("p975"), r("mode", 7).alias("kde_mode"))
    b = st.summary_stats(p, KEY, "v", "element").select(*KEY, r("p05").alias("p05"), r("p95").alias("p95"))
    f = p.groupBy(*KEY).agg(r(F.avg(F.col("q") / 50), 9).alias("mean_fraction"))
    return a.join(b, KEY).join(f, KEY)


Y_SQL = PRICES_SQL + ", " + hist_sql("prices", "segment, name, year", "v") + ", " + pct_sql("h", "segment, name, year", {"p025": 2.5, "median": 50, "p975": 97.5}) + ", " + mode_sql("h", "segment, name, year", 20) + """,
 ys AS (SELECT segment, name, year, n, mean, std, p025, median, p975, mode FROM (SELECT segment, name, year, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM prices GROUP BY ALL) JOIN p USING (segment, name, year) JOIN m USING (segment, name, year))"""


def yearly_stats(spark, sf):
    p, key = prices(spark, sf), [*KEY, "year"]
    m = hg.moments_and_range(p, key, "v")
    return hg.year_stats(hg.hist_acc(p, key, "v", m), m.select(*key, "n", "mean", "std"), key)


YCOLS = {"mean": 5, "std": 5, "p025": 6, "median": 6, "p975": 6, "mode": 7}


@query("g22_year_stats", "WITH " + Y_SQL + " SELECT segment, name, year, n, " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in YCOLS.items()) + " FROM ys")
def g22(spark, sf):
    return yearly_stats(spark, sf).withColumns({c: r(c, n) for c, n in YCOLS.items()})


SEGS = ["AB", "CD", "EF"]


@query("g23_compare_segments", "WITH " + PRICES_SQL + ", s AS (SELECT segment, name, avg(v) AS mean, stddev_pop(v) AS std FROM prices GROUP BY ALL) SELECT name, " + ", ".join(
    f'round(max(CASE WHEN segment = \'{s}\' THEN {c} END), 5) AS "{s}_{c}"' for s in SEGS for c in ("mean", "std")) + " FROM s GROUP BY 1")
def g23(spark, sf):
    s = st.moments(prices(spark, sf), KEY, "v")
    c = st.compare_segments(s, "segment", SEGS, {"mean": F.col("mean"), "std": F.col("std")}, ["name"])
    return c.withColumns({x: r(x, 5) for x in c.columns if x != "name"})


@query("g24_breakdown", "WITH " + RANGES_SQL + " SELECT segment, sensor_type, round(sum(mode), 2) AS total, round(avg(mode), 7) AS mean, count(DISTINCT comp_id) AS n_locations FROM ranges GROUP BY ALL")
def g24(spark, sf):
    return st.breakdown(ranges(spark, sf), ["segment", "sensor_type"], "mode", "comp_id").withColumns({"total": r("total", 2), "mean": r("mean", 7)})


@query("g25_collapse", "WITH " + RANGES_SQL + " SELECT segment, domain, sensor_type, year, round(sum(lo), 3) AS lo, round(sum(mode), 3) AS mode, round(sum(hi), 3) AS hi FROM ranges GROUP BY ALL")
def g25(spark, sf):
    c = st.collapse(ranges(spark, sf), ["segment", "domain", "sensor_type", "year"], ["lo", "mode", "hi"])
    return c.withColumns({x: r(x, 3) for x in ("lo", "mode", "hi")})


@query("g26_clip_band", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS mean, least(l_quantity, 25) AS hi_was, least(25.0::DOUBLE, l_quantity) AS lo, greatest(30.0::DOUBLE, l_quantity) AS hi, 25 > l_quantity OR 30 < l_quantity AS clipped FROM lineitem".replace("least(l_quantity, 25) AS hi_was, ", ""))
def g26(spark, sf):
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("mean"), F.lit(25.0).alias("lo"), F.lit(30.0).alias("hi"))
    return st.clip_band(x, "mean", "lo", "hi")


@query("g27_sum_band", "WITH " + Y_SQL + " SELECT segment, year, 'comonotonic bound' AS band_meaning, round(sum(mean), 4) AS mean, round(sum(p025), 4) AS p025, round(sum(p975), 4) AS p975 FROM ys GROUP BY ALL")
def g27(spark, sf):
    s = st.sum_band(yearly_stats(spark, sf), ["segment", "year"], ["mean", "p025", "p975"])
    return s.withColumns({c: r(c, 4) for c in ("mean", "p025", "p975")})


@query("g28_band_width", "WITH " + Y_SQL + " SELECT segment, name, year, round((p975 - p025) / mean * 100, 6) AS band_pct FROM ys")
def g28(spark, sf):
    return yearly_stats(spark, sf).select(*KEY, "year", r(st.band_width("mean", "p025", "p975")).alias("band_pct"))


@query("g29_cv_rank", "WITH " + RANGES_SQL + ", c AS (SELECT segment, sensor_type, avg(mode) AS m, stddev_pop(mode) AS s FROM ranges GROUP BY ALL)"
       " SELECT segment, sensor_type, round(m, 7) AS mean, round(s, 7) AS std, round(s / m, 8) AS cv, CAST(row_number() OVER (ORDER BY round(s / m, 9) DESC, segment, sensor_type) AS INTEGER) AS rank FROM c")
def g29(spark, sf):
    return st.cv_rank(ranges(spark, sf), ["segment", "sensor_type"], "mode").withColumns({"mean": r("mean", 7), "std": r("std", 7), "cv": r("cv", 8)})


@query("g30_overview", "WITH " + RANGES_SQL + """, o AS (SELECT segment, domain, sum(CASE WHEN year = 1995 THEN mode ELSE 0 END) AS g_base, sum(CASE WHEN year = 1995 THEN lo ELSE 0 END) AS lo_base, sum(CASE WHEN year = 1995 THEN hi ELSE 0 END) AS hi_base,
  sum(CASE WHEN year = 2000 THEN mode ELSE 0 END) AS g_end, count(DISTINCT sensor_type) AS n_types FROM ranges GROUP BY ALL)
SELECT segment, domain, round(g_base, 3) AS g_base, round(lo_base, 3) AS lo_base, round(hi_base, 3) AS hi_base, round(g_end, 3) AS g_end, n_types, round((g_end / g_base - 1) * 100, 7) AS change_pct, round((hi_base - lo_base) / g_base * 100, 7) AS band_pct FROM o""")
def g30(spark, sf):
    o = st.overview(ranges(spark, sf), ["segment", "domain"], 1995, 2000, "sensor_type", "mode", "lo", "hi")
    return o.withColumns({**{c: r(c, 3) for c in ("g_base", "lo_base", "hi_base", "g_end")}, "change_pct": r("change_pct", 7), "band_pct": r("band_pct", 7)})


@query("g31_rollup_rounded", "WITH " + RANGES_SQL + " SELECT year, segment, domain, round(sum(mode), 1) AS mode, round(sum(lo), 1) AS lo FROM (SELECT * REPLACE (lo + 0.00013 AS lo) FROM ranges) WHERE year IN (1995, 1998, 2001) GROUP BY ALL")
def g31(spark, sf):
    # the offset keeps sums away from exact rounding ties
    x = ranges(spark, sf).withColumn("lo", F.col("lo") + F.lit(0.00013))
    return st.rollup_rounded(x, ["year", "segment", "domain"], ["mode", "lo"], [1995, 1998, 2001], 1)


@query("g32_mean_contribution", "WITH " + RANGES_SQL + ", s AS (SELECT segment, domain, sensor_type, sum(mode) AS v FROM ranges GROUP BY ALL) SELECT domain, sensor_type, round(avg(v), 5) AS v FROM s GROUP BY ALL")
def g32(spark, sf):
    s = st.collapse(ranges(spark, sf), ["segment", "domain", "sensor_type"], ["mode"]).withColumnRenamed("mode", "v")
    return st.mean_contribution(s, ["domain", "sensor_type"], ["v"]).withColumn("v", r("v", 5))


BOX = {"whisker_lo": 2.5, "q1": 25, "median": 50, "q3": 75, "whisker_hi": 97.5}


@query("g33_box_stats", "WITH " + H_SQL + ", " + pct_sql("h", "segment, name", BOX) + " SELECT segment, name, " + ", ".join(f"round({c}, 7) AS {c}" for c in BOX) + " FROM p")
def g33(spark, sf):
    return hg.box_stats(fine_hist(spark, sf), KEY).select(*KEY, *[r(c, 7).alias(c) for c in BOX])


TD_SQL = "td AS (SELECT segment, draw, " + sql_uni(sql_at("h"), "lo", "hi") + " AS v FROM (SELECT *, " + sql_md5(42, "count", "segment", "sensor_type", "comp_id") + " AS h FROM sensors), range(60) t(draw))"


def sensor_draws(spark, sf, n=60):
    from massweave.functions import draws as dr
    from massweave.operators.joins import expand_draws
    d = expand_draws(dr.with_streams(qd.sensor_rows(spark, sf), 42, ["segment", "sensor_type", "comp_id"], ["count"]), n)
    return d.select("segment", "sensor_type", "comp_id", "draw", dr.uniform(dr.at("u_count"), "lo", "hi").alias("v"))


@query("g34_spill_report", "WITH " + qd.SENSOR_SQL + ", " + TD_SQL + ", " + hist_sql("td", "segment", "v", where="draw < 1").replace("0.35::DOUBLE", "0.0::DOUBLE") + """
SELECT segment, CAST(sum(under + over) AS BIGINT) AS spilled, CAST(sum(count) AS BIGINT) AS total, round(100.0::DOUBLE * sum(under + over) / sum(count), 7) AS spilled_pct FROM h GROUP BY 1""")
def g34(spark, sf):
    d = sensor_draws(spark, sf)
    rng = hg.pilot_range(d, ["segment"], "v", pilot=F.col("draw") < 1, pad=0.0)       # a pilot that is too narrow, to see the spill
    return hg.spill_report(hg.hist_acc(d, ["segment"], "v", rng), ["segment"]).withColumn("spilled_pct", r("spilled_pct", 7))


@query("g35_merge_hist", "WITH " + H_SQL + " SELECT segment, name, bin, count, under, over FROM h")
def g35(spark, sf):
    """Two chunks folded on their own and added equal one pass."""
    p = prices(spark, sf)
    rng = hg.pilot_range(p, KEY, "v")
    a = hg.hist_acc(p.filter("q <= 25"), KEY, "v", rng)
    b = hg.hist_acc(p.filter("q > 25"), KEY, "v", rng)
    return hg.merge_hist(a, b, by=KEY).select(*KEY, "bin", "count", "under", "over")


#: Unit area of a board by size.
UNIT = {"small": 5.0, "medium": 12.5, "large": 30.0}
YEARS_SQL = qd.CALIB_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT brand AS comp, '{z}' AS size, sum(({z}_min + {z}_max) / 2 * {u}::DOUBLE) AS s FROM components GROUP BY 1" for z, u in UNIT.items()) + """),
 units(size, unit) AS (VALUES """ + ", ".join(f"('{z}', {u}::DOUBLE)" for z, u in UNIT.items()) + """),
 k AS (SELECT comp, size, year, sum(presence * 2 * unit) / (SELECT count(*) FROM vehicles) AS d FROM calib CROSS JOIN units GROUP BY ALL),
 k2 AS (SELECT 'Brand#' || (ix + 1) AS comp, size, year, d FROM k JOIN t_vec USING (comp)),
 my AS (SELECT s.comp, s.size, CAST(y AS INTEGER) AS year, s + coalesce(d, 0) AS mean FROM s CROSS JOIN range(1993, 2005) t(y) LEFT JOIN k2 ON k2.comp = s.comp AND k2.size = s.size AND k2.year = y)"""


def year_parts(spark, sf):
    """Static and dynamic part of the board area by component and size, and the vehicles that were drawn."""
    per = lambda f: F.explode(F.array(*[f(z, u) for z, u in UNIT.items()])).alias("e")
    static = components(spark, sf).select(F.col("brand").alias("comp"), per(lambda z, u: F.struct(
        F.lit(z).alias("size"), F.col(f"{z}_min").alias("lo"), F.col(f"{z}_max").alias("hi"), F.lit(u).alias("unit")))).select("comp", "e.*")
    names = F.create_map(*[F.lit(x) for i, n, *_ in qd.PRES_ROWS for x in (n, f"Brand#{i + 1}")])
    # the year curve of a component is averaged once; sizes multiply the small result
    dyn = qd.calibrated(spark, sf).groupBy("comp", "year").agg(F.sum("presence").alias("p")).select(
        F.try_element_at(names, F.col("comp")).alias("comp"), "year", "p", per(lambda z, u: F.struct(F.lit(z).alias("size"), F.lit(2 * u).alias("unit"))))
    return static, dyn.select("comp", "e.size", "year", (F.col("p") * F.col("e.unit")).alias("value")), qc.vehicles(spark, sf)


@query("g36_mean_by_year", "WITH " + YEARS_SQL + " SELECT comp, size, year, round(mean, 5) AS mean FROM my")
def g36(spark, sf):
    return st.mean_by_year(*year_parts(spark, sf)[:2], ["comp", "size"], qc.vehicles(spark, sf), 1993, 2004).withColumn("mean", r("mean", 5))


# ---- W ---------------------------------------------------------------------------
@query("w01_running_sum", "WITH " + PRICES_SQL + """ SELECT segment, CAST(q AS BIGINT) AS q, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY segment ORDER BY q) AS BIGINT) AS running FROM prices GROUP BY segment, q""")
def w01(spark, sf):
    n = prices(spark, sf).groupBy("segment", F.col("q").cast("bigint").alias("q")).agg(F.count("*").alias("n"))
    return wn.running_sum(n, ["segment"], "q", "n")


@query("w02_neighbour", "WITH " + RANGES_SQL + ", y AS (SELECT segment, domain, year, avg(mode) AS v FROM ranges GROUP BY ALL) SELECT segment, domain, year, round(v - lag(v) OVER w, 8) + 0.0 AS slope_in, round(lead(v) OVER w - v, 8) + 0.0 AS slope_out FROM y WINDOW w AS (PARTITION BY segment, domain ORDER BY year)")
def w02(spark, sf):
    y = ranges(spark, sf).groupBy("segment", "domain", "year").agg(F.avg("mode").alias("v"))
    return wn.neighbour(y, ["segment", "domain"], "year", "v").select("segment", "domain", "year", r("slope_in", 8).alias("slope_in"), r("slope_out", 8).alias("slope_out"))


@query("w03_row_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_id FROM orders")
def w03(spark, sf):
    return wn.row_id(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [], "o_totalprice", ["o_orderkey"]).select("o_orderkey", "row_id")


@query("w04_first_per_key", "SELECT o_custkey, min(o_orderkey) AS first_order, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1")
def w04(spark, sf):
    o = table(spark, sf, "orders")
    return wn.first_per_key(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("o_orderpriority").alias("priority"))


@query("w05_avg_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem")
def w05(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return wn.avg_rank(li, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank")


@query("w06_at_base", "WITH " + PRICES_SQL + ", y AS (SELECT segment, year, avg(v) AS v FROM prices GROUP BY ALL) SELECT segment, year, round(v, 5) AS v, round(max(CASE WHEN year = 1996 THEN v END) OVER (PARTITION BY segment), 5) AS base FROM y")
def w06(spark, sf):
    y = prices(spark, sf).groupBy("segment", "year").agg(F.avg("v").alias("v"))
    return wn.at_base(y, ["segment"], "year", "v", 1996).withColumns({"v": r("v", 5), "base": r("base", 5)})


@query("w07_next_rate", "WITH " + PRICES_SQL + ", y AS (SELECT segment, name, year, avg(v) AS v FROM prices GROUP BY ALL) SELECT segment, name, round(max(CASE WHEN year = 1997 THEN v END) / max(CASE WHEN year = 1996 THEN v END) - 1, 8) + 0.0 AS rate FROM y GROUP BY ALL")
def w07(spark, sf):
    y = prices(spark, sf).groupBy(*KEY, "year").agg(F.avg("v").alias("v"))
    return wn.next_rate(y, KEY, "year", "v", 1996).withColumn("rate", r("rate", 8))


@query("w08_share_of", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey), 9) AS share FROM lineitem")
def w08(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return wn.share_of(li, ["l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("share", 9).alias("share"))
