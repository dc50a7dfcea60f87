"""K: end-to-end tables."""

from pyspark.sql import functions as F

from massweave.operators import groupwise as gw
from massweave.operators import joins as jn
from massweave.operators import ranking as rk
from massweave.operators import sampling as sp
from massweave.operators import stats as st
from massweave.plans import literals as lit
from massweave.plans import tables as tb
from massweave.queries import curves as qc
from massweave.queries import draws as qd
from massweave.queries import stats as qs
from massweave.queries._base import (RANGES_SQL, SEG_SQL, components, query, r, ranges, segment_col, sql_at,
                                     sql_keyed, sql_md5, sql_norm, sql_tri, sql_uni, table)
from massweave.queries.cleaning import classify_sql
from massweave.queries.reshape import FACTORS_SQL, SIZES
from massweave.scale import stored


@query("k01_classified_components", "WITH " + FACTORS_SQL + ", t AS (SELECT *, lower(trim(domain)) AS d, lower(trim(component)) AS c, lower(trim(domain)) || ' ' || lower(trim(component)) AS b FROM factors) SELECT comp_id, domain, component, label_ab, label_cd, label_ef, "
       + classify_sql("d", "c") + " AS category, f_ab, f_cd, f_ef, " + ", ".join(f"coalesce({m}, 0.0::DOUBLE) * f_{s} AS {s}_{m}" for s in ("ab", "cd", "ef") for m in SIZES) + " FROM t")
def k01(spark, sf):
    return tb.build_classified(components(spark, sf))


_M = ", ".join(f"CASE WHEN step_{b} = -1 THEN {s}_{b} ELSE step_{b} * f_{s} END AS {s}_step_{b}, dcs_{b} * f_{s} AS {s}_dcs_{b}, dcm_{b} * f_{s} AS {s}_dcm_{b}" for s in ("ab", "cd", "ef") for b in ("min", "max"))
_T = ", ".join(f"{s}_step_{b} + {s}_dcs_{b} + {s}_dcm_{b} AS {s}_total_{b}" for s in ("ab", "cd", "ef") for b in ("min", "max"))


@query("k02_motor_distribution", "WITH " + FACTORS_SQL + f", m AS (SELECT comp_id, domain, {_M} FROM factors), t AS (SELECT *, {_T} FROM m) SELECT * FROM t WHERE greatest(ab_total_min, ab_total_max, cd_total_min, cd_total_max, ef_total_min, ef_total_max) > 0")
def k02(spark, sf):
    return tb.build_motor_distribution(components(spark, sf))


# ---- sensor counts ---------------------------------------------------------------
N3, PILOT3 = 400, 100
COMP_ARRAY = [row[0] for row in lit.PRESENCE_PER_TIER]
COMP_CASE = "CASE (CAST(substr(sensor_type, 7) AS INTEGER) - 1) % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(COMP_ARRAY)) + " END"
SENSOR_PARAMS_SQL = "sp0 AS (SELECT segment, domain, sensor_type, avg(lo) AS lo, avg(hi) AS hi, avg(CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END) AS factor FROM ranges GROUP BY ALL), sparams AS (SELECT *, " + COMP_CASE + " AS component FROM sp0)"
K03_SQL = RANGES_SQL + ", " + SENSOR_PARAMS_SQL + ", " + qc.COMPOSED_SQL + ", volt AS (SELECT segment, year, share FROM shares WHERE state = 'H3')" + f""",
 hp AS MATERIALIZED (SELECT *, {sql_md5(42, 'count', 'segment', 'domain', 'sensor_type')} AS h, {sql_md5(42, 'volt', 'segment')} AS hv, {sql_md5(42, 'uplift', 'segment')} AS hu FROM sparams),
 dd AS (SELECT segment, domain, sensor_type, component, draw, hv, hu, CASE WHEN domain = 'PROMO' THEN {sql_uni(sql_at('h'), 'lo', 'hi')} ELSE {sql_uni(sql_at('h'), 'lo * factor', 'hi * factor')} END AS v FROM hp, range({N3}) t(draw)),
 yy AS (SELECT d.segment, d.domain, d.sensor_type, d.draw, CAST(y AS INTEGER) AS year, CASE WHEN d.domain = 'PROMO' THEN d.v * p.presence
     WHEN d.sensor_type = 'Brand#3' THEN d.v + d.v * CASE WHEN {sql_at('hv')} < vo.share THEN {sql_tri(sql_at('hu'), '1.8::DOUBLE', '1.9::DOUBLE', '2.0::DOUBLE')} - 1 ELSE 0 END ELSE d.v END AS v
   FROM dd d CROSS JOIN range({qc.Y0}, {qc.Y1 + 1}) t(y) LEFT JOIN composed p ON d.domain = 'PROMO' AND p.component = d.component AND p.segment = d.segment AND p.year = y
   LEFT JOIN volt vo ON vo.segment = d.segment AND vo.year = y),
 ser AS (SELECT segment, 'SensorType' AS level, sensor_type AS name, year, draw, sum(v) AS v FROM yy GROUP BY ALL UNION ALL SELECT segment, 'Domain', domain, year, draw, sum(v) FROM yy GROUP BY ALL
   UNION ALL SELECT segment, 'Total', 'TOTAL', year, draw, sum(v) FROM yy GROUP BY ALL), """ + qs.hist_sql("ser", "segment, level, name, year", "v", where=f"draw < {PILOT3}") + ", " + \
    qs.pct_sql("h", "segment, level, name, year", {"p025": 2.5, "median": 50, "p975": 97.5}) + ", " + qs.mode_sql("h", "segment, level, name, year", 20) + """,
 sensor_years AS (SELECT * FROM (SELECT segment, level, name, year, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM ser GROUP BY ALL) JOIN p USING (segment, level, name, year) JOIN m USING (segment, level, name, year))"""


def sensor_params(spark, sf):
    x = ranges(spark, sf).groupBy("segment", "domain", "sensor_type").agg(F.avg("lo").alias("lo"), F.avg("hi").alias("hi"), F.avg(F.expr(qd.FACTOR).cast("double")).alias("factor"))
    return x.withColumn("component", F.expr(COMP_CASE))


def sensor_counts(spark, sf):
    volt = qc.shares(spark, sf).filter("state = 'H3'").select("segment", "year", "share")
    return tb.build_sensor_counts(stored(sensor_params(spark, sf), "sensors"), stored(qc.composed(spark, sf), "presence"), stored(volt, "volt"), N3, (qc.Y0, qc.Y1), "PROMO", "Brand#3", (1.8, 1.9, 2.0), PILOT3)


# binned values may move by a little where a sum lands on an edge: compared to two digits
@query("k03_sensor_counts", "WITH " + K03_SQL + " SELECT segment, level, name, year, n, round(mean, 6) AS mean, round(std, 6) AS std, round(p025, 2) AS p025, round(median, 2) AS median, round(p975, 2) AS p975, round(mode, 2) AS mode FROM sensor_years")
def k03(spark, sf):
    k = sensor_counts(spark, sf)
    return k.select("segment", "level", "name", "year", "n", r("mean").alias("mean"), r("std").alias("std"), *[r(c, 2).alias(c) for c in ("p025", "median", "p975", "mode")])


# ---- sensor elements -------------------------------------------------------------
TEN = ["mean", "std", "min", "max", *st.TEN, "mode"]


def ten_sql(v):
    return ", ".join(f"quantile_cont({v}, {q / 100!r}) AS {c}" for c, q in st.TEN.items())


K04_SQL = qd.MASS_SQL.replace("range(4)", "range(12)") + """, f AS (SELECT segment, element, sensor_type, draw, sum(value) AS v FROM masses GROUP BY ALL),
 s AS (SELECT * FROM f UNION ALL SELECT segment, element, 'ALL', draw, sum(v) FROM f GROUP BY ALL),
 m AS (SELECT segment, element, sensor_type, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, var_pop(v) AS var, min(v) AS min, max(v) AS max, """ + ten_sql("v") + """ FROM s GROUP BY ALL), """ + qs.exact_hist_sql("s", "segment, element, sensor_type", "v", 200, "x4") + ", " + qs.mode_sql("x4", "segment, element, sensor_type", name="m4") + """,
 loc AS (SELECT segment, element, sensor_type, count(DISTINCT comp_id) AS n_locations FROM masses GROUP BY ALL)"""


@query("k04_sensor_elements", "WITH " + K04_SQL + """ SELECT m.segment, m.element, m.sensor_type, n, """ + ", ".join(f"round({c}, 4) AS {c}" for c in TEN) + """, n_locations,
 round(var / max(CASE WHEN m.sensor_type = 'ALL' THEN var END) OVER (PARTITION BY m.segment, m.element), 7) AS variance_share FROM m JOIN m4 USING (segment, element, sensor_type) LEFT JOIN loc ON loc.segment = m.segment AND loc.element = m.element AND loc.sensor_type = m.sensor_type""")
def k04(spark, sf):
    t = tb.build_sensor_elements(qd.masses(spark, sf, 12))
    return t.select("segment", "element", "sensor_type", "n", *[r(c, 4).alias(c) for c in TEN], "n_locations", r("variance_share", 7).alias("variance_share"))


# ---- board area ------------------------------------------------------------------
K05_SQL = qs.AREA_TOTAL_SQL.replace("range(20)", "range(60)") + ", long AS (" + " UNION ALL ".join(f"SELECT brand, draw, '{s}' AS size, {s} AS v FROM tot" for s in ("small", "medium", "large", "total")) + "), " + qs.hist_sql("long", "brand, size", "v", where="draw < 20") + ", " + \
    qs.pct_sql("h", "brand, size", {"p025": 2.5, "median": 50, "p975": 97.5}) + """, mo AS (SELECT brand, size, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM long GROUP BY ALL),
 vs AS (""" + " UNION ALL ".join(f"SELECT brand, '{s}' AS size, var_pop({s}) / nullif(var_pop(total), 0) AS variance_share, CASE WHEN var_pop({s}) <= 0 OR var_pop(total) <= 0 THEN NULL ELSE corr({s}, total) END AS corr FROM tot GROUP BY brand" for s in ("small", "medium", "large")) + ")"


@query("k05_board_area", "WITH " + K05_SQL + " SELECT mo.brand, mo.size, n, round(mean, 5) AS mean, round(std, 5) AS std, round(p025, 1) AS p025, round(median, 1) AS median, round(p975, 1) AS p975, round(variance_share, 7) AS variance_share, round(corr, 7) AS corr FROM mo JOIN p ON p.brand = mo.brand AND p.size = mo.size LEFT JOIN vs ON vs.brand = mo.brand AND vs.size = mo.size")
def k05(spark, sf):
    t = tb.build_area(qd.areas(spark, sf, 60), ["brand"], 20)
    return t.select("brand", "size", "n", r("mean", 5).alias("mean"), r("std", 5).alias("std"), *[r(c, 1).alias(c) for c in ("p025", "median", "p975")], r("variance_share", 7).alias("variance_share"), r("corr", 7).alias("corr"))


YSCALE_SQL = qs.YEARS_SQL + ", yscale AS (SELECT comp, size, year, mean, mean / max(CASE WHEN year = 1997 THEN mean END) OVER (PARTITION BY comp, size) AS scale FROM my)"


def year_scale(spark, sf):
    static, dyn, vehicles = qs.year_parts(spark, sf)
    return tb.build_year_scale(static, dyn, ["comp", "size"], vehicles, (1993, 2004), 1997)


@query("k05_year_scale", "WITH " + YSCALE_SQL + " SELECT comp, size, year, round(mean, 5) AS mean, round(scale, 9) AS scale FROM yscale")
def k05_scale(spark, sf):
    return year_scale(spark, sf).select("comp", "size", "year", r("mean", 5).alias("mean"), r("scale", 9).alias("scale"))


# ---- board elements --------------------------------------------------------------
K06_SQL = qs.GT_SQL + """, e6 AS (SELECT segment, category, size, element, count(*) AS n, avg(mass) AS mean, stddev_pop(mass) AS std, min(mass) AS min, max(mass) AS max, """ + ten_sql("mass") + " FROM gt GROUP BY ALL), " + qs.exact_hist_sql("gt", "segment, category, size, element", "mass", 200, "x6") + ", " + qs.mode_sql("x6", "segment, category, size, element", name="m6")


def board_elements(spark, sf):
    return st.summary_stats(stored(qs.totals(spark, sf), "board_totals"), ["segment", "category", "size", "element"], "mass")


@query("k06_board_elements", "WITH " + K06_SQL + " SELECT segment, category, size, element, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in TEN) + " FROM e6 JOIN m6 USING (segment, category, size, element)")
def k06(spark, sf):
    return board_elements(spark, sf).select("segment", "category", "size", "element", "n", *[r(c).alias(c) for c in TEN])


def rhos_sql(src, by, drivers, result, digits=7):
    parts = [qs.spearman_sql(src, by, d, result, f"rho_{d}") for d in drivers]
    rows = " UNION ALL ".join(f"SELECT {by}, '{d}' AS driver, rho FROM rho_{d}" for d in drivers)
    return ", ".join(parts) + f", rhos AS ({rows}) SELECT {by}, driver, round(rho, {digits}) AS rho, round(coalesce(rho * rho / nullif(sum(rho * rho) OVER (PARTITION BY {by}), 0), 0), {digits}) AS share FROM rhos"


@query("k06_board_sensitivity", "WITH " + qd.EMASS_SQL + ", " + rhos_sql("emass2", "segment, element", ["area", "conc"], "mass_g"))
def k06_sensitivity(spark, sf):
    t = st.rho_shares(stored(qd.element_masses(spark, sf), "element_masses"), ["segment", "element"], ["area", "conc"], "mass_g")
    return t.select("segment", "element", "driver", r("rho", 7).alias("rho"), r("share", 7).alias("share"))


@query("k06_board_elements_by_year", "WITH " + qd.EMASS_SQL + ", st_ AS (SELECT segment, element, avg(mass_g) AS mean, stddev_pop(mass_g) AS std FROM emass2 GROUP BY ALL), " + RANGES_SQL + """,
 y AS (SELECT segment, year, avg(mode) AS v FROM ranges GROUP BY ALL), sc AS (SELECT segment, year, v / max(CASE WHEN year = 1997 THEN v END) OVER (PARTITION BY segment) AS scale FROM y),
 by_ AS (SELECT segment, element, year, mean * scale AS mean, std * scale AS std FROM st_ JOIN sc USING (segment))
SELECT segment, element, year, round(mean, 8) AS mean, round(std, 8) AS std, round((mean / max(CASE WHEN year = 1997 THEN mean END) OVER (PARTITION BY segment, element) - 1) * 100, 7) + 0.0 AS change_pct FROM by_""")
def k06_year(spark, sf):
    s = qd.element_masses(spark, sf).groupBy("segment", "element").agg(F.avg("mass_g").alias("mean"), F.stddev_pop("mass_g").alias("std"))
    y = ranges(spark, sf).groupBy("segment", "year").agg(F.avg("mode").alias("v"))
    y = gw.index_to_base(y, ["segment"], "year", "v", 1997, "scale")
    b = gw.index_to_base(jn.apply_year_scale(s, y, ["segment"], ["mean", "std"]), ["segment", "element"], "year", "mean", 1997, "ix")
    return b.select("segment", "element", "year", r("mean", 8).alias("mean"), r("std", 8).alias("std"), r((F.col("ix") - 1.0) * 100.0, 7).alias("change_pct"))


# ---- motors ----------------------------------------------------------------------
HEADROOM = {"European": (1.05, 1.15, 1.25), "Mixed": (1.15, 1.30, 1.45), "Executive": (1.30, 1.50, 1.70)}
HWEIGHTS = {"European": 0.4, "Mixed": 0.35, "Executive": 0.25}
MYEARS = [2020, 2025, 2026, 2030, 2040, 2050, 2070]
_H = lambda i: "CASE scenario " + " ".join(f"WHEN '{n}' THEN {t[i]}::DOUBLE" for n, t in HEADROOM.items()) + " END"
K07_SQL = qd.MASSD_SQL + f""", mt AS (SELECT segment, draw, sum(count) AS count, sum(mass_kg) AS mass FROM motor_mass GROUP BY ALL),
 sc AS (SELECT *, CASE WHEN {sql_keyed(42, 'scenario', 'segment', 'draw')} < 0.4 THEN 'European' WHEN {sql_keyed(42, 'scenario', 'segment', 'draw')} < 0.75 THEN 'Mixed' ELSE 'Executive' END AS scenario FROM mt),
 gr AS (SELECT *, {sql_tri(sql_keyed(42, 'headroom', 'segment', 'draw'), _H(0), _H(1), _H(2))} AS h, {sql_tri(sql_keyed(42, 'tau', 'segment', 'draw'), '20.0::DOUBLE', '30.0::DOUBLE', '50.0::DOUBLE')} AS tau FROM sc),
 gy AS (SELECT segment, draw, CAST(y AS INTEGER) AS year, count, mass, greatest(h - (h - 1) * exp(-(y - 2025) / tau), 0) AS g FROM gr, (SELECT unnest({MYEARS}) AS y)),
 gq AS (SELECT segment, year, 'count' AS quantity, count * g AS v FROM gy UNION ALL SELECT segment, year, 'mass', mass * g FROM gy),
 motor_years AS (SELECT segment, quantity, year, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.025) AS p025, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.975) AS p975 FROM gq GROUP BY ALL)"""


def motor_years(spark, sf):
    d = qd.motor_mass(spark, sf).groupBy("segment", "draw").agg(F.sum("count").alias("count"), F.sum("mass_kg").alias("mass"))
    return tb.build_motor_years(d, HEADROOM, HWEIGHTS, MYEARS, 2025)


@query("k07_motor_years", "WITH " + K07_SQL + " SELECT segment, quantity, year, n, round(mean, 6) AS mean, round(std, 6) AS std, round(p025, 6) AS p025, round(p50, 6) AS p50, round(p975, 6) AS p975 FROM motor_years")
def k07(spark, sf):
    return motor_years(spark, sf).select("segment", "quantity", "year", "n", *[r(c).alias(c) for c in ("mean", "std", "p025", "p50", "p975")])


@query("k07_motor_sensitivity", "WITH " + qd.MASSD_SQL + ", " + rhos_sql("motor_mass", "segment, motor", ["count", "unit_mass_g"], "mass_kg"))
def k07_sensitivity(spark, sf):
    t = st.rho_shares(stored(qd.motor_mass(spark, sf), "motor_mass"), ["segment", "motor"], ["count", "unit_mass_g"], "mass_kg")
    return t.select("segment", "motor", "driver", r("rho", 7).alias("rho"), r("share", 7).alias("share"))


@query("k07_motor_materials", "WITH " + qd.MATD_SQL + """, g AS (SELECT segment, material, draw, sum(mass_kg) AS v, avg(ratio) AS ratio FROM matd GROUP BY ALL)
SELECT segment, material, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 5) AS std, round(quantile_cont(v, 0.5), 4) AS p50, round(avg(ratio), 8) AS mean_ratio FROM g GROUP BY ALL""")
def k07_materials(spark, sf):
    g = qd.material_rows(spark, sf).groupBy("segment", "material", "draw").agg(F.sum("mass_kg").alias("v"), F.avg("ratio").alias("ratio"))
    key = ["segment", "material"]
    m = g.groupBy(*key).agg(F.count("*").alias("n"), r(F.avg("v"), 4).alias("mean"), r(F.stddev_pop("v"), 5).alias("std"), r(F.avg("ratio"), 8).alias("mean_ratio"))
    return gw.join_on(m, st.exact_percentiles(g, key, "v", {"p50": 50}), key).withColumn("p50", r("p50", 4))


# ---- motor elements by stream ----------------------------------------------------
K08_SQL = qd.HIST_SQL.replace("range(4000)", "range(400)") + ", mass8 AS (SELECT segment, draw, bin_left + v * (bin_right - bin_left) AS value FROM resampled), " + qd.GRADES_SQL.replace("range(100)", "range(400)") + """,
 x8 AS (SELECT g.segment, g.element, value * fraction AS em, fraction FROM mass8 m JOIN gfull g ON g.segment = m.segment AND g.draw = m.draw),
 stream_elements AS (SELECT segment, element, 'Electrical Steel' AS stream, avg(em) AS mean_mass_kg, stddev_pop(em) AS std_mass_kg, avg(fraction) AS mean_fraction, quantile_cont(em, 0.05) AS p05_mass_kg, quantile_cont(em, 0.5) AS p50_mass_kg, quantile_cont(em, 0.95) AS p95_mass_kg FROM x8 GROUP BY ALL)"""
ECOLS = ["mean_mass_kg", "std_mass_kg", "mean_fraction", "p05_mass_kg", "p50_mass_kg", "p95_mass_kg"]


def stream_elements(spark, sf):
    mass = sp.resample(qd.hist(spark, sf), ["segment"], 400, within=True)
    return tb.build_stream_elements(mass, qd.grade_fractions(spark, sf, 400), ["segment"], "Electrical Steel")


@query("k08_stream_elements", "WITH " + K08_SQL + " SELECT segment, element, stream, " + ", ".join(f"round({c}, 8) AS {c}" for c in ECOLS) + " FROM stream_elements")
def k08(spark, sf):
    return stream_elements(spark, sf).select("segment", "element", "stream", *[r(c, 8).alias(c) for c in ECOLS])


# all four streams: motor by supplier, stream by line number, a grade's ranges from one part brand; the type PROMO is given in parts of a million
N8 = 60
MOTORS = ("small", "medium")
STREAMS = ("Copper", "Electrical Steel", "NdFeB", "Cast Fe Steel")
W8 = tb.stream_weights(MOTORS, ("AB", "CD", "EF"))
GRADES8 = sorted({g for *_, g, _ in W8})
_MOTOR8 = "CASE l_suppkey % 2 WHEN 0 THEN 'small' ELSE 'medium' END"
_STREAM8 = "CASE l_linenumber % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(STREAMS[:3])) + f" ELSE '{STREAMS[3]}' END"
_B8 = "stream, motor, segment"
K08_STREAMS_SQL = "w8(stream, motor, segment, grade, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{g}', {w!r}::DOUBLE)" for a, b, c, g, w in W8) + """),
 n8(grade, brand) AS (VALUES """ + ", ".join(f"('{g}', 'Brand#{i % 25 + 1}')" for i, g in enumerate(GRADES8)) + f"""),
 g8 AS (SELECT grade, p_type AS element, min(p_size) / 1000.0::DOUBLE * f AS lo, max(p_size) / 400.0::DOUBLE * f AS hi FROM (SELECT *, CASE WHEN p_type = 'PROMO' THEN 1e-6::DOUBLE ELSE 1.0::DOUBLE END AS f FROM part) JOIN n8 ON p_brand = brand GROUP BY grade, p_type, f),
 wn8 AS (SELECT {_B8}, grade, weight / sum(weight) OVER (PARTITION BY {_B8}) AS weight FROM w8),
 d8 AS (SELECT {_B8}, element, CAST(draw AS INTEGER) AS draw, weight * """ + sql_uni(sql_at("h"), "lo", "hi") + " AS x FROM (SELECT *, " + sql_md5(42, "grade", "stream", "motor", "segment", "grade", "element") + f""" AS h FROM wn8 JOIN g8 USING (grade)), range({N8}) t(draw)),
 m8 AS (SELECT {_B8}, draw, element, sum(x) AS fraction FROM d8 GROUP BY ALL),
 f8 AS (SELECT * FROM m8 UNION ALL SELECT {_B8}, draw, 'Fe', least(greatest(1 - sum(fraction), 0), 1) FROM m8 WHERE stream IN ('Electrical Steel', 'Cast Fe Steel') GROUP BY ALL
   UNION ALL SELECT DISTINCT {_B8}, draw, 'TotalMass', 1.0::DOUBLE FROM m8),
 h8 AS (SELECT {_STREAM8} AS stream, {_MOTOR8} AS motor, {SEG_SQL} AS segment, floor(l_quantity / 1.25) * 1.25 AS bin_left, count(*) AS count FROM lineitem GROUP BY ALL),
 c8 AS (SELECT *, CAST(sum(count) OVER (PARTITION BY {_B8} ORDER BY bin_left) AS DOUBLE) AS c_hi, CAST(sum(count) OVER (PARTITION BY {_B8}) AS DOUBLE) AS tot FROM h8),
 r8 AS (SELECT {_B8}, CAST(draw AS INTEGER) AS draw, """ + sql_at(sql_md5(42, "bin", "stream", "motor", "segment")) + " AS u, " + sql_at(sql_md5(42, "inside", "stream", "motor", "segment")) + f""" AS v FROM (SELECT DISTINCT {_B8} FROM h8), range({N8}) t(draw)),
 v8 AS (SELECT r8.stream, r8.motor, r8.segment, draw, bin_left + v * 1.25 AS value FROM r8 JOIN c8 ON r8.stream = c8.stream AND r8.motor = c8.motor AND r8.segment = c8.segment AND u * tot >= c_hi - count AND u * tot < c_hi),
 e8 AS (SELECT {_B8}, element, draw, value * fraction AS em, value AS sm FROM v8 JOIN f8 USING (stream, motor, segment, draw)),
 a8 AS (SELECT * FROM e8 UNION ALL SELECT stream, 'ALL', segment, element, draw, sum(em), sum(sm) FROM e8 GROUP BY ALL)"""


def streams(spark, sf):
    f = F.when(F.col("p_type") == "PROMO", F.lit("_ppm")).otherwise(F.lit(""))
    names = F.create_map(*[F.lit(x) for i in range(25) for x in (f"Brand#{i + 1}", "|".join(g for j, g in enumerate(GRADES8) if j % 25 == i))])
    g = table(spark, sf, "part").groupBy("p_brand", F.concat("p_type", f).alias("element")).agg((F.min("p_size").cast("double") / 1000).alias("lo"), (F.max("p_size").cast("double") / 400).alias("hi"))
    g = g.withColumn("grade", F.explode(F.split(F.try_element_at(names, F.col("p_brand")), "[|]"))).drop("p_brand").filter("grade <> ''")
    w = spark.createDataFrame(W8, "stream string, motor string, segment string, grade string, weight double")
    left = F.floor(F.col("l_quantity") / 1.25) * 1.25
    h = table(spark, sf, "lineitem").groupBy(F.expr(_STREAM8).alias("stream"), F.expr(_MOTOR8).alias("motor"), segment_col().alias("segment"), left.alias("bin_left")).agg(F.count("*").alias("count"))
    mass = sp.resample(h.withColumn("bin_right", F.col("bin_left") + 1.25), ["stream", "motor", "segment"], N8, within=True)
    return tb.build_streams(mass, g, w, N8)


@query("k08_streams", "WITH " + K08_STREAMS_SQL + f""" SELECT {_B8}, element, count(*) AS n, round(avg(em), 7) AS mean_mass_kg, round(stddev_pop(em), 7) AS std_mass_kg, round(avg(em / sm), 7) AS mean_fraction,
 round(quantile_cont(em, 0.05), 7) AS p05_mass_kg, round(quantile_cont(em, 0.5), 7) AS p50_mass_kg, round(quantile_cont(em, 0.95), 7) AS p95_mass_kg FROM a8 GROUP BY ALL""")
def k08_streams(spark, sf):
    return streams(spark, sf).select(*_B8.split(", "), "element", "n", *[r(c, 7).alias(c) for c in ECOLS])


# ---- wiring ----------------------------------------------------------------------
UPLIFT = {"AB": 2485 / 1392, "CD": 4144 / 2486, "EF": 4610 / 3546}
CALIBRATION = {"AB": 1.0, "CD": 1.0, "EF": 3546 / 3646}
#: Vehicles of a segment that set the bins.
PILOT9 = 1000
J_SEGMENTS = {"AB": "JA-JB", "CD": "JC-JD", "EF": "JE-JF"}
_seg = lambda m: "CASE segment " + " ".join(f"WHEN '{s}' THEN {v!r}::DOUBLE" for s, v in m.items()) + " END"
_V = lambda v, *k: sql_keyed(42, v, *k)
# the vehicle CTEs are shared by both parts, so each is stated once
_slen = qd.SENSOR_LEN_SQL
K09_SQL = _slen + ", " + qd.CATS_SQL + f""",
 h3 AS (SELECT segment, year, share, max(CASE WHEN year = 1997 THEN share END) OVER (PARTITION BY segment) AS base FROM shares WHERE state = 'H3'),
 bs AS (SELECT segment, avg(Conventional) AS b0, avg(Transitional) AS b1, avg(SDV_Zonal) AS b2 FROM arch WHERE year = 1997 GROUP BY 1),
 lm AS (SELECT segment, avg(CASE WHEN year = 1997 THEN length_m END) AS lm FROM slen GROUP BY 1),
 vy AS (SELECT a.segment, a.vehicle, a.year, a.state, s.length_m / greatest(lm.lm, 1e-9::DOUBLE) AS sscale,
   (1 - CASE WHEN {_V('volt', 'a.vehicle')} < h3.share THEN {sql_tri(_V('red', 'a.vehicle'), '0.40::DOUBLE', '0.425::DOUBLE', '0.45::DOUBLE')} ELSE 0 END) / greatest(1 - CASE WHEN {_V('volt', 'a.vehicle')} < h3.base THEN {sql_tri(_V('red', 'a.vehicle'), '0.40::DOUBLE', '0.425::DOUBLE', '0.45::DOUBLE')} ELSE 0 END, 1e-12::DOUBLE) AS hv
   FROM arch a JOIN slen s ON s.vehicle = a.vehicle AND s.year = a.year JOIN lm ON lm.segment = a.segment JOIN h3 ON h3.segment = a.segment AND h3.year = a.year),
 vc0 AS (SELECT v.segment, vehicle, category, grp, base_m, sdv, g_lo, g_hi, b0, b1, b2, {sql_tri(_V('depth', 'vehicle'), '0.4::DOUBLE', '0.7::DOUBLE', '1.0::DOUBLE')} AS depth,
   CAST(substr(category, 7) AS INTEGER) AS ix, {sql_md5(42, 'cat1', 'vehicle')} AS h1, {sql_md5(42, 'cat2', 'vehicle')} AS h2, {sql_md5(42, 'gauge', 'vehicle')} AS hg FROM vehicles v JOIN bs ON bs.segment = v.segment, cats),
 vc1 AS (SELECT *, CASE WHEN grp = 'ADAS / Sensor' THEN 1.0::DOUBLE ELSE {_seg(UPLIFT)} END AS l0, 1.0::DOUBLE AS l1, CASE WHEN sdv < 1 THEN greatest(0, 1 - (1 - sdv) * depth) ELSE sdv END AS l2 FROM vc0),
 vc AS (SELECT segment, vehicle, category, grp, l0 / e AS a0, l1 / e AS a1, l2 / e AS a2, base_m * {_seg(CALIBRATION)} * greatest({sql_norm(_V('veh1', 'vehicle'), _V('veh2', 'vehicle'), '1.0::DOUBLE', '0.1::DOUBLE')} * {sql_norm(sql_at('h1', 'ix'), sql_at('h2', 'ix'), '1.0::DOUBLE', f'{qd.CV_IND!r}::DOUBLE')}, 0.05::DOUBLE) AS metres,
   {sql_tri(sql_at('hg', 'ix'), 'g_lo', '((g_lo + g_hi) / 2)', 'greatest(g_hi, g_lo + 1e-9::DOUBLE)')} * 8.96::DOUBLE AS rate FROM (SELECT *, greatest(b0 * l0 + b1 * l1 + b2 * l2, 1e-12::DOUBLE) AS e FROM vc1)),
 wl AS (SELECT y.segment, y.vehicle, y.year, category, grp, greatest(metres * CASE WHEN grp = 'ADAS / Sensor' THEN sscale ELSE CASE state WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END END, 0) AS length, rate * CASE WHEN grp = 'HV Power' THEN hv ELSE 1 END / 1000 AS cu
   FROM vc JOIN vy y ON y.segment = vc.segment AND y.vehicle = vc.vehicle),
 w0 AS (SELECT segment, vehicle, year, category, grp, length, length * cu AS copper FROM wl),
 wires AS (SELECT * FROM w0 UNION ALL SELECT CASE segment WHEN 'AB' THEN 'JA-JB' WHEN 'CD' THEN 'JC-JD' ELSE 'JE-JF' END, vehicle, year, category, grp, length * (1 + ad), copper * (1 + ad)
   FROM (SELECT *, {sql_tri(_V('height', 'vehicle'), '0.05::DOUBLE', '0.1::DOUBLE', '0.15::DOUBLE')} AS ad FROM w0)),
 wlv AS (SELECT segment, vehicle, year, 'Category' AS level, category AS code, grp AS functional_group, length, copper FROM wires
   UNION ALL SELECT segment, vehicle, year, 'Group', grp, grp, sum(length), sum(copper) FROM wires GROUP BY ALL
   UNION ALL SELECT segment, vehicle, year, 'Total', 'TOTAL', 'TOTAL', sum(length), sum(copper) FROM wires GROUP BY ALL),
 wm AS (SELECT segment, vehicle, year, level, code, functional_group, 'Length (m)' AS metric, length AS v FROM wlv UNION ALL SELECT segment, vehicle, year, level, code, functional_group, 'Cu (kg)', copper FROM wlv)"""


def wiring_rows(spark, sf):
    volt = gw.at_base(qc.shares(spark, sf).filter("state = 'H3'").drop("state"), ["segment"], "year", "share", 1997)
    cats = qd.categories(spark, sf).withColumn("ix", F.substring("category", 7, 10).cast("int"))
    return tb.wiring_rows(stored(tb.with_pilot(qd.sensor_lengths(spark, sf), 1997, PILOT9), "fleet"), stored(cats, "cats"), stored(volt, "volt"), UPLIFT, CALIBRATION, 1997)


K9 = "segment, year, level, code, functional_group, metric"
K09_STATS_SQL = K09_SQL + f""",
 pv AS (SELECT segment AS s0, vehicle FROM (SELECT segment, vehicle, row_number() OVER (PARTITION BY segment ORDER BY vehicle) AS rn FROM vehicles) WHERE rn <= {PILOT9}),
 wp AS (SELECT wm.*, pv.vehicle IS NOT NULL AS pilot FROM wm LEFT JOIN pv ON pv.vehicle = wm.vehicle), """ + qs.hist_sql("wp", K9, "v", where="pilot") + ", " + \
    qs.pct_sql("h", K9, {"p025": 2.5, "median": 50, "p975": 97.5}) + ", " + qs.mode_sql("h", K9, 20)
K9COLS = {"mean": 6, "std": 6, "p025": 5, "median": 5, "p975": 5, "mode": 5}


@query("k09_wiring", "WITH " + K09_STATS_SQL + f""" SELECT {K9}, n_iter, """ + ", ".join(f"round({c}, {n}) AS {c}" for c, n in K9COLS.items()) + f"""
 FROM (SELECT {K9}, count(*) AS n_iter, avg(v) AS mean, stddev_pop(v) AS std FROM wm GROUP BY ALL) JOIN p USING ({K9}) JOIN m USING ({K9})""")
def k09(spark, sf):
    w = tb.build_wiring(wiring_rows(spark, sf), J_SEGMENTS)
    return w.select(*K9.split(", "), "n_iter", *[r(c, n).alias(c) for c, n in K9COLS.items()])


# ---- composition -----------------------------------------------------------------
SIZE_CASE = "CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END"
ELEM_CASE = "CASE l_linenumber % 2 WHEN 0 THEN 'Cu' ELSE 'Au' END"
K10_SQL = K08_SQL + ", " + RANGES_SQL + f""",
 kw AS (SELECT segment, domain AS code, year, avg(mode) AS mean, avg(lo) AS lo, avg(hi) AS hi FROM ranges GROUP BY ALL),
 kp AS (SELECT segment, domain AS category, {SIZE_CASE} AS size, {ELEM_CASE} AS element, year, avg(mode) AS mean, avg(lo) AS lo, avg(hi) AS hi FROM ranges GROUP BY ALL),
 km0 AS (SELECT segment, year, avg(mode) AS mean, avg(lo) AS lo, avg(hi) AS hi FROM ranges GROUP BY ALL),
 km AS (SELECT *, max(CASE WHEN year = 1997 THEN mean END) OVER (PARTITION BY segment) AS b FROM km0),
 ks AS (SELECT segment, sensor_type, year, avg(mode) AS mean, avg(lo) AS lo, avg(hi) AS hi FROM ranges GROUP BY ALL),
 kc AS (SELECT p_brand AS sensor_type, p_type AS element, (avg(p_size) - 24) * 0.001::DOUBLE AS mg FROM part GROUP BY ALL),
 comp0 AS (SELECT year, segment, 'Wiring' AS domain, code AS ctype, 'Cu' AS element, mean * 1000 AS mean, lo * 1000 AS lo, hi * 1000 AS hi, 'modelled' AS basis, 'full model band' AS band, 'wiring/histograms' AS hist FROM kw
  UNION ALL SELECT year, segment, 'PCB', category || ' / ' || size, element, mean, lo, hi, 'modelled', 'full model band', 'pcb/histogram_' || segment || '_' || category || '_' || size || '_area' FROM kp
  UNION ALL SELECT year, e.segment, 'Motors', stream, element, mean_mass_kg * 1000 * mean / b, mean_mass_kg * 1000 * lo / b, mean_mass_kg * 1000 * hi / b, 'scaled', 'motor count/mass only; composition fixed', 'motors/hist_' || e.segment || '_' || stream || '_mass' FROM stream_elements e JOIN km ON km.segment = e.segment
  UNION ALL SELECT year, segment, 'Sensors', sensor_type, element, mean * mg, lo * mg, hi * mg, 'modelled', 'sensor count only; composition fixed', 'sensors/year_stats' FROM ks JOIN kc USING (sensor_type) WHERE mg > 0),
 comp1 AS (SELECT year, segment, domain, ctype, element, basis, band, hist, sum(mean) AS mean, sum(lo) AS lo, sum(hi) AS hi FROM comp0 GROUP BY ALL),
 kcomp AS (SELECT year, segment, domain, ctype, element, basis, band, hist, mean, least(lo, mean) AS lo, greatest(hi, mean) AS hi, lo > mean OR hi < mean AS clipped FROM comp1)"""


def composition(spark, sf):
    x = ranges(spark, sf)
    band = [F.avg(a).alias(b) for a, b in (("mode", "mean"), ("lo", "lo"), ("hi", "hi"))]
    w = x.groupBy("segment", F.col("domain").alias("code"), "year").agg(*band).withColumns({"level": F.lit("Group"), "metric": F.lit("Cu (kg)")})
    p = x.groupBy("segment", F.col("domain").alias("category"), F.expr(SIZE_CASE).alias("size"), F.expr(ELEM_CASE).alias("element"), "year").agg(*band)
    m = x.groupBy("segment", "year").agg(*band)
    e = stream_elements(spark, sf).withColumnRenamed("stream", "motor")
    s = x.groupBy("segment", "sensor_type", "year").agg(*band)
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("sensor_type"), F.col("p_type").alias("element")).agg((F.avg("p_size") - 24).alias("mg"))
    return tb.build_composition(w, p, m, e, s, c, 1997)


@query("k10_composition", "WITH " + K10_SQL + """ SELECT year AS "Year", segment AS "Segment", domain AS "Domain", ctype AS "Component_Type", element AS "Element", round(mean, 8) AS "Mass_g_per_vehicle", round(lo, 8) AS "P2_5_g", round(hi, 8) AS "P97_5_g",
 basis AS "Basis", band AS "Band_meaning", hist AS "Histogram_File", clipped FROM kcomp""")
def k10(spark, sf):
    return composition(spark, sf).withColumns({c: r(c, 8) for c in ("Mass_g_per_vehicle", "P2_5_g", "P97_5_g")})


def lower(df):
    return df.select(F.col("Year").alias("year"), F.col("Segment").alias("segment"), F.col("Domain").alias("domain"), F.col("Component_Type").alias("ctype"),
                     F.col("Element").alias("element"), F.col("Mass_g_per_vehicle").alias("mean"), F.col("P2_5_g").alias("lo"), F.col("P97_5_g").alias("hi"))


@query("k11_overview", "WITH " + K10_SQL + """, o AS (SELECT segment, domain, sum(CASE WHEN year = 1997 THEN mean ELSE 0 END) AS g_base, sum(CASE WHEN year = 1997 THEN lo ELSE 0 END) AS lo_base, sum(CASE WHEN year = 1997 THEN hi ELSE 0 END) AS hi_base,
  sum(CASE WHEN year = 2001 THEN mean ELSE 0 END) AS g_end, count(DISTINCT ctype) AS n_types FROM kcomp GROUP BY ALL)
SELECT segment, domain, round(g_base, 5) AS g_base, round(lo_base, 5) AS lo_base, round(hi_base, 5) AS hi_base, round(g_end, 5) AS g_end, n_types, round((g_end / g_base - 1) * 100, 7) AS change_pct, round((hi_base - lo_base) / g_base * 100, 7) AS band_pct FROM o""")
def k11_overview(spark, sf):
    o = st.overview(lower(composition(spark, sf)), ["segment", "domain"], 1997, 2001, "ctype", "mean", "lo", "hi")
    return o.withColumns({**{c: r(c, 5) for c in ("g_base", "lo_base", "hi_base", "g_end")}, "change_pct": r("change_pct", 7), "band_pct": r("band_pct", 7)})


@query("k11_snapshot", "WITH " + K10_SQL + " SELECT year, segment, domain, round(sum(mean), 4) AS mean, round(sum(lo), 4) AS lo, round(sum(hi), 4) AS hi FROM kcomp WHERE year IN (1997, 1999, 2001) GROUP BY ALL")
def k11_snapshot(spark, sf):
    return st.rollup_rounded(lower(composition(spark, sf)), ["year", "segment", "domain"], ["mean", "lo", "hi"], [1997, 1999, 2001], 4)


@query("k11_detail", "WITH " + K10_SQL + " SELECT year, segment, domain, ctype, element, round(sum(mean), 6) AS mean, round(sum(lo), 6) AS lo, round(sum(hi), 6) AS hi FROM kcomp WHERE year IN (1997, 2001) GROUP BY ALL")
def k11_detail(spark, sf):
    return st.rollup_rounded(lower(composition(spark, sf)), ["year", "segment", "domain", "ctype", "element"], ["mean", "lo", "hi"], [1997, 2001], 6)


@query("k11_change", "WITH " + K10_SQL + """, d AS (SELECT domain, ctype, round(sum(CASE WHEN year = 1997 THEN mean ELSE 0 END), 5) AS value_a, round(sum(CASE WHEN year = 2001 THEN mean ELSE 0 END), 5) AS value_b,
  round(sum(CASE WHEN year = 2001 THEN mean ELSE 0 END) - sum(CASE WHEN year = 1997 THEN mean ELSE 0 END), 5) AS delta FROM kcomp WHERE segment = 'EF' AND year IN (1997, 2001) GROUP BY ALL)
SELECT * FROM d ORDER BY abs(delta) DESC, domain, ctype LIMIT 16""")
def k11_change(spark, sf):
    d = jn.period_delta(lower(composition(spark, sf)).filter("segment = 'EF'"), ["domain", "ctype"], "year", "mean", 1997, 2001)
    return rk.top_changes(d.withColumns({c: r(c, 5) for c in ("value_a", "value_b", "delta")}), "delta", 16, ["domain", "ctype"])


@query("k11_change_table", "WITH " + K10_SQL + " SELECT segment, domain, ctype, " + ", ".join(f"round(sum(CASE WHEN year = 1997 THEN {c} ELSE 0 END), 5) AS {c}_a, round(sum(CASE WHEN year = 2001 THEN {c} ELSE 0 END), 5) AS {c}_b" for c in ("mean", "lo", "hi"))
       + ", round(sum(CASE WHEN year = 2001 THEN mean ELSE 0 END) - sum(CASE WHEN year = 1997 THEN mean ELSE 0 END), 5) AS delta FROM kcomp WHERE year IN (1997, 2001) GROUP BY ALL")
def k11_change_table(spark, sf):
    t = jn.period_table(lower(composition(spark, sf)), ["segment", "domain", "ctype"], "year", ["mean", "lo", "hi"], 1997, 2001)
    t = t.withColumn("delta", F.col("mean_b") - F.col("mean_a"))
    return t.withColumns({c: r(c, 5) for c in t.columns[3:]})


# ---- consolidated templates ------------------------------------------------------
@query("k12_board_template", """
WITH src AS (SELECT p_partkey, p_type, p_name, CASE WHEN contains(upper(p_brand), '#1') THEN 'AB' WHEN contains(upper(p_brand), '#2') THEN 'CD' ELSE 'EF' END AS segment FROM part),
 s AS (SELECT p_type, CASE WHEN contains(upper(p_brand), '#1') THEN 'AB' WHEN contains(upper(p_brand), '#2') THEN 'CD' ELSE 'EF' END AS segment, avg(p_size) AS m, stddev_pop(p_size) AS u FROM part WHERE p_type <> 'LARGE' GROUP BY ALL)
SELECT 'Electronics' AS system, segment, p_type, p_name, coalesce(printf('%.4f', m), 'N/A') AS value, coalesce(printf('%.4f', 2 * u), 'N/A') AS uncertainty, CAST(NULL AS VARCHAR) AS remark, CAST(p_partkey AS VARCHAR) AS part
FROM src LEFT JOIN s USING (p_type, segment)""")
def k12_boards(spark, sf):
    from massweave.functions import text as tx
    p = table(spark, sf, "part").withColumn("segment", F.coalesce(tx.segment_from_text("p_brand", [("#1", "AB"), ("#2", "CD")]), F.lit("EF")))
    s = p.filter("p_type <> 'LARGE'").groupBy("p_type", "segment").agg(F.avg("p_size").alias("mean"), F.stddev_pop("p_size").alias("std"))
    src = p.select("p_type", "p_name", "segment", F.col("p_partkey").cast("string").alias("part"))
    return tb.build_consolidated(src, s, ["p_type", "segment"], ["mean"], ["system", "segment", "p_type", "p_name", "value", "uncertainty", "remark", "part"],
                                 {"system": "Electronics"}, ["p_name", "part"])


@query("k12_motor_template", """
WITH src AS (SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' WHEN 'MACHINERY' THEN 'EF' END AS segment FROM customer),
 s AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' ELSE 'EF' END AS segment, avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS u FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' GROUP BY 1)
SELECT 'Motors' AS system, coalesce(segment, 'N/A') AS segment, c_mktsegment, printf('%.2f', m) AS value, printf('%.2f', 2 * u) AS uncertainty, CAST(c_custkey AS VARCHAR) AS part FROM src JOIN s USING (segment)""".replace("%.2f", "%.4f"))
def k12_motors(spark, sf):
    from massweave.operators import cleaning as cl
    m = {"AUTOMOBILE": "AB", "BUILDING": "AB", "FURNITURE": "CD", "MACHINERY": "EF"}
    c = cl.map_code(table(spark, sf, "customer"), "c_mktsegment", m, "segment").filter(F.col("segment").isNotNull())       # unknown codes are skipped
    s = c.groupBy("segment").agg(F.avg("c_acctbal").alias("mean"), F.stddev_pop("c_acctbal").alias("std"))
    src = c.select("segment", "c_mktsegment", F.col("c_custkey").cast("string").alias("part"))
    return tb.build_consolidated(src, s, ["segment"], ["mean"], ["system", "segment", "c_mktsegment", "value", "uncertainty", "part"], {"system": "Motors"}, ["part"])


TIER_SQL = qc.SHARES_SQL + ", tw AS (SELECT segment, year, " + ", ".join(f"coalesce(sum(CASE WHEN state = '{t}' THEN share END), 0.0::DOUBLE) AS {t}" for t in lit.TIERS) + " FROM shares GROUP BY ALL)"


@query("k13_tier_table", "WITH " + TIER_SQL + " SELECT segment, year, " + ", ".join(f"round({t}, 9) AS \"{t}\"" for t in lit.TIERS) + ", round(" + " + ".join(lit.TIERS) + ", 9) AS sum, round(" + " + ".join(f"{t} * {lit.TIER_RANGING[t]}::DOUBLE" for t in lit.TIERS) + ", 9) AS ranging_derived FROM tw")
def k13(spark, sf):
    t = tb.build_tier_table(qc.shares(spark, sf).withColumnRenamed("state", "tier"))
    return t.withColumns({c: r(c, 9) for c in [*lit.TIERS, "sum", "ranging_derived"]})


@query("k13_scenario_table", "WITH " + qc.SCEN_SQL + " scen2 AS (SELECT * FROM scen WHERE year >= 1998), " + qc.sql_curve("scen2", "scenario", "year", "mult", "curve", clip=False) + """,
 wts AS (SELECT o_orderpriority AS scenario, count(*) / sum(count(*)) OVER () AS weight FROM orders GROUP BY o_orderpriority)
SELECT scenario, """ + ", ".join(f"max(CASE WHEN year = {y} THEN CASE WHEN year <= 1998 THEN 1.0 ELSE round(greatest(mult, 0), 9) END END) AS m{y}" for y in (1998, 2000, 2002)) + ", any_value(round(weight, 9)) AS weight FROM curve JOIN wts USING (scenario) GROUP BY 1")
def k13_scenarios(spark, sf):
    from massweave.operators import reshape as rs
    m = rs.to_wide(qc.scenario_multiplier(spark, sf).filter("year IN (1998, 2000, 2002)"), ["scenario"], "year", "mult", [1998, 2000, 2002])
    n = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(F.count("*").cast("double").alias("n"))
    w = gw.share_of(n, [], "n", "weight").select("scenario", r("weight", 9).alias("weight"))
    return m.select("scenario", *[r(F.col(str(y)), 9).alias(f"m{y}") for y in (1998, 2000, 2002)]).join(w, "scenario")
