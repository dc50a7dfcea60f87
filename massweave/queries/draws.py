"""F: draw columns. Every row of the bound table makes its own draws."""

from pyspark.sql import functions as F

from massweave.functions import draws as dr
from massweave.functions import text as tx
from massweave.operators import cleaning as cl
from massweave.operators import curves as cv
from massweave.operators import groupwise as gw
from massweave.operators import sampling as sp
from massweave.operators.joins import expand_draws
from massweave.plans import literals as lit
from massweave.queries import curves as qc
from massweave.queries._base import (COMPONENTS_SQL, RANGES_SQL, SEG_SQL, STATES, anchors, components, query,
                                     r, ranges, segment_col, sql_at, sql_keyed, sql_md5, sql_norm, sql_tri, sql_uni, table)
from massweave.scale import checked_broadcast

ROW = ["l_orderkey", "l_linenumber", "comp_id", "l_suppkey"]
N = 8


def drawn_sql(*variables: str, n: int = N, src: str = "ranges", base: str = RANGES_SQL, keys=ROW) -> str:
    """base, then `d`: every row of `src` with a digest per variable, times n draws."""
    h = ", ".join(f"{sql_md5(42, v, *keys)} AS h_{v}" for v in variables)
    return f"{base}, hashed AS MATERIALIZED (SELECT *, {h} FROM {src}), d AS (SELECT * FROM hashed, range({n}) t(draw))"


def drawn(df, variables, n=N, keys=ROW):
    return expand_draws(dr.with_streams(df, 42, keys, variables), n)


def moments(df, by, val, nd=6):
    return df.groupBy(*by).agg(F.count("*").alias("n"), r(F.avg(val), nd).alias("mean"), r(F.var_pop(val), nd - 1).alias("variance"),
                               r(F.min(val), nd).alias("lo"), r(F.max(val), nd).alias("hi"))


def moments_sql(by, val, src="d", nd=6):
    return (f"SELECT {by}, count(*) AS n, round(avg({val}), {nd}) + 0.0 AS mean, round(var_pop({val}), {nd - 1}) + 0.0 AS variance, "
            f"round(min({val}), {nd}) + 0.0 AS lo, round(max({val}), {nd}) + 0.0 AS hi FROM {src} GROUP BY ALL")


@query("f01_keyed_uniform", "WITH " + drawn_sql("u") + f""", v AS (SELECT segment, domain, {sql_keyed(42, 'once', *ROW)} AS once, {sql_at('h_u')} AS u FROM d)
SELECT segment, domain, count(*) AS n, round(avg(u), 9) AS mean, round(var_pop(u), 9) AS variance, round(min(u), 9) AS lo, round(max(u), 9) AS hi, round(avg(once), 9) AS mean_once FROM v GROUP BY ALL""")
def f01(spark, sf):
    d = drawn(ranges(spark, sf).withColumn("once", dr.keyed_uniform(42, "once", *ROW)), ["u"]).withColumn("u", dr.at("u_u"))
    return d.groupBy("segment", "domain").agg(
        F.count("*").alias("n"), r(F.avg("u"), 9).alias("mean"), r(F.var_pop("u"), 9).alias("variance"),
        r(F.min("u"), 9).alias("lo"), r(F.max("u"), 9).alias("hi"), r(F.avg("once"), 9).alias("mean_once"))


@query("f02_uniform", "WITH " + drawn_sql("u") + ", v AS (SELECT segment, domain, " + sql_uni(sql_at("h_u"), "lo", "hi") + " AS x FROM d) " + moments_sql("segment, domain", "x", "v"))
def f02(spark, sf):
    return moments(drawn(ranges(spark, sf), ["u"]).withColumn("x", dr.uniform(dr.at("u_u"), "lo", "hi")), ["segment", "domain"], "x")


@query("f03_triangular", "WITH " + drawn_sql("u") + ", v AS (SELECT segment, domain, " + sql_tri(sql_at("h_u"), "lo", "mode", "hi") + " AS x FROM d) " + moments_sql("segment, domain", "x", "v"))
def f03(spark, sf):
    return moments(dr.draw_uniforms(drawn(ranges(spark, sf), ["u"]), {"_u": ("u_u", "draw")}).withColumn("x", dr.triangular("_u", "lo", "mode", "hi")), ["segment", "domain"], "x")


@query("f04_normal", "WITH " + drawn_sql("a", "b") + ", v AS (SELECT segment, domain, greatest(" + sql_norm(sql_at("h_a"), sql_at("h_b"), "1.0::DOUBLE", "0.3::DOUBLE") + ", 0.05::DOUBLE) AS x FROM d) " + moments_sql("segment, domain", "x", "v"))
def f04(spark, sf):
    return moments(drawn(ranges(spark, sf), ["a", "b"]).withColumn("x", dr.normal(dr.at("u_a"), dr.at("u_b"), 1.0, 0.3, floor=0.05)), ["segment", "domain"], "x")


@query("f05_bernoulli", "WITH " + drawn_sql("u") + f"""
SELECT segment, domain, count(*) AS n, CAST(sum(CASE WHEN {sql_at('h_u')} < mode / 50 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(mode / 50), 9) AS expected FROM d GROUP BY ALL""")
def f05(spark, sf):
    d = drawn(ranges(spark, sf), ["u"])
    hit = dr.bernoulli(dr.at("u_u"), F.col("mode") / 50)
    return d.groupBy("segment", "domain").agg(F.count("*").alias("n"), F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), r(F.avg(F.col("mode") / 50), 9).alias("expected"))


@query("f06_pick", "WITH " + drawn_sql("u") + f"""
SELECT segment, CASE WHEN u < 0.25 THEN 'S1' WHEN u < 0.75 THEN 'S2' ELSE 'S3' END AS scenario, 'S2' AS pinned, count(*) AS n FROM (SELECT segment, {sql_at('h_u')} AS u FROM d) GROUP BY ALL""")
def f06(spark, sf):
    weights = {k: w for k, (_, w) in lit.SCENARIOS.items()}
    d = drawn(ranges(spark, sf), ["u"]).withColumn("scenario", dr.pick(dr.at("u_u"), weights)).withColumn("pinned", dr.pick(dr.at("u_u"), weights, "S2"))
    return d.groupBy("segment", "scenario", "pinned").agg(F.count("*").alias("n"))


STATE_SQL = "least(" + " + ".join(f"CASE WHEN u > {' + '.join(STATES[:i + 1])} THEN 1 ELSE 0 END" for i in range(5)) + ", 4)"
TIERED_SQL = qc.SHIFT_SQL + f", tiered AS (SELECT segment, vehicle, year, CAST({STATE_SQL} AS INTEGER) AS tier FROM shifted)"


def tiered(spark, sf):
    return qc.shifted(spark, sf).select("segment", "vehicle", "year", dr.comonotonic_state("u", STATES).cast("int").alias("tier"))


@query("f07_comonotonic_state", "WITH " + TIERED_SQL + " SELECT segment, year, tier, count(*) AS n FROM tiered GROUP BY ALL")
def f07(spark, sf):
    return tiered(spark, sf).groupBy("segment", "year", "tier").agg(F.count("*").alias("n"))


Y0, Y1 = qc.Y0, qc.Y1
BANDS = ["b_lo", "b_mode", "b_hi"]
LIDAR_SQL = qc.CURVE_SQL + f""", lid AS (SELECT segment, year, greatest(share - 0.1, 0) AS b_lo, share AS b_mode, least(share + 0.2, 1) AS b_hi FROM curve WHERE state = 'H4'),
 lid2 AS (SELECT *, {', '.join(f'coalesce(lead({b}) OVER (PARTITION BY segment ORDER BY year), {b}) AS {b}_next' for b in BANDS)} FROM lid),
 veh AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END AS segment, c_custkey AS vehicle,
   {sql_keyed(42, 'band', 'c_custkey')} AS w, {sql_keyed(42, 'equipped', 'c_custkey')} AS e,
   {sql_norm(sql_keyed(42, 'lag1', 'c_custkey'), sql_keyed(42, 'lag2', 'c_custkey'), '0.0::DOUBLE', '3.0::DOUBLE')} AS lag FROM customer),
 lpos AS (SELECT v.segment, vehicle, w, e, CAST(y AS INTEGER) AS year, least(greatest(y - lag, {Y0}), {Y1}) - {Y0} AS pos FROM veh v, range({Y0}, {Y1 + 1}) t(y)),
 lix AS (SELECT *, least(floor(pos), {Y1 - Y0 - 1}) AS i, pos - least(floor(pos), {Y1 - Y0 - 1}) AS f FROM lpos),
 lraw AS (SELECT x.segment, vehicle, w, e, x.year, {', '.join(f'greatest({b} * (1 - f) + {b}_next * f, 0) AS {b}' for b in BANDS)} FROM lix x JOIN lid2 l ON x.segment = l.segment AND l.year = {Y0} + i),
 lidar AS (SELECT segment, vehicle, year, e, CASE WHEN w < 0.3333333333333333::DOUBLE THEN b_lo WHEN w < 0.6666666666666666::DOUBLE THEN b_mode ELSE b_hi END AS share FROM lraw)"""


def lidar_bands(spark, sf):
    c = cv.monotone_curve(anchors(spark, sf), ["segment", "state"], "year", "share", Y0, Y1).filter("state = 'H4'")
    x = F.col("share")
    bands = c.select("segment", "year", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), e.alias("v")) for b, e in zip(
        BANDS, (F.greatest(x - 0.1, F.lit(0.0)), x, F.least(x + 0.2, F.lit(1.0))))])).alias("s")).select("segment", "year", "s.*")
    return cv.wide_curve(bands, ["segment"], "band", "v", BANDS)


def with_lidar(d, spark, sf):
    """Equipped share per vehicle and year: one band and one lag per vehicle."""
    out = cv.shift_curve(d, lidar_bands(spark, sf), ["segment"], "lag", (Y0, Y1), BANDS, normal=False)
    return out.withColumn("lidar_share", dr.band_pick("w", *BANDS)).drop(*BANDS, "w", "lag")


def lidar_vehicles(spark, sf):
    k = lambda v: dr.keyed_uniform(42, v, "vehicle")
    return qc.vehicles(spark, sf).withColumns({"w": k("band"), "e": k("equipped"), "lag": dr.normal(k("lag1"), k("lag2"), 0.0, 3.0)})


def over_years(d):
    return d.withColumn("year", F.explode(F.sequence(F.lit(Y0), F.lit(Y1))))


def lidar(spark, sf):
    return with_lidar(over_years(lidar_vehicles(spark, sf)), spark, sf).select("segment", "vehicle", "year", "e", F.col("lidar_share").alias("share"))


@query("f08_band_pick", "WITH " + LIDAR_SQL + " SELECT segment, year, round(avg(share), 9) AS share, CAST(sum(CASE WHEN e < share THEN 1 ELSE 0 END) AS BIGINT) AS equipped FROM lidar GROUP BY ALL")
def f08(spark, sf):
    d = lidar(spark, sf)
    return d.groupBy("segment", "year").agg(r(F.avg("share"), 9).alias("share"), F.sum(F.when(dr.bernoulli("e", "share"), 1).otherwise(0)).alias("equipped"))


FACTOR = "CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0.0 END"
COUNTS_SQL = drawn_sql("count", n=4) + f""", v AS (SELECT *, CAST({FACTOR} AS DOUBLE) AS factor FROM d), counts AS (SELECT segment, domain, sensor_type, year, draw, l_orderkey, l_linenumber, comp_id, l_suppkey,
  CASE WHEN domain = 'PROMO' THEN {sql_uni(sql_at('h_count'), 'lo', 'hi')} * 0.4 ELSE {sql_uni(sql_at('h_count'), 'lo * factor', 'hi * factor')} END AS value FROM v)"""


def counts(spark, sf, n=4):
    x = ranges(spark, sf).withColumn("factor", F.expr(FACTOR).cast("double")).withColumn("presence", F.lit(0.4))
    return sp.range_draws(x, n, ROW, governed=F.col("domain") == "PROMO", presence="presence")


@query("f09_range_draws", "WITH " + COUNTS_SQL + " SELECT segment, domain, CAST(draw AS INTEGER) AS draw, round(sum(value), 3) AS total FROM counts GROUP BY ALL")
def f09(spark, sf):
    return counts(spark, sf).groupBy("segment", "domain", "draw").agg(r(F.sum("value"), 3).alias("total"))


SIZES = {"small": ("small_min", "small_max", (2.0, 3.0, 5.0), (1.0, 2.0, 4.0)),
         "medium": ("medium_min", "medium_max", (5.0, 8.0, 12.0), (4.0, 6.0, 9.0)),
         "large": ("large_min", "large_max", (12.0, 16.0, 24.0), (8.0, 12.0, 18.0))}


def _area_sql(s):
    a, b, ln, wd = SIZES[s]
    n = sql_uni(sql_at(f"h_{s}_n"), f"coalesce({a}, 0)", f"coalesce({b}, 0)")
    t = lambda v, p: sql_tri(sql_at(f"h_{s}_{v}"), *[f"{x}::DOUBLE" for x in p])
    return f"{n} AS n_{s}, CASE WHEN {n} > 0 THEN {n} * {t('l', ln)} * {t('w', wd)} ELSE 0.0 END AS area_{s}"


def area_sql(n):
    return drawn_sql(*[f"{s}_{v}" for s in SIZES for v in "nlw"], n=n, src="components", base=COMPONENTS_SQL, keys=["comp_id"]) + \
        ", areas AS (SELECT comp_id, domain, brand, p_size, CAST(draw AS INTEGER) AS draw, " + ", ".join(_area_sql(s) for s in SIZES) + " FROM d)"


def areas(spark, sf, n=20):
    return sp.area_draws(components(spark, sf), n, ["comp_id"], SIZES)


@query("f10_area_draws", "WITH " + area_sql(20) + " SELECT domain, draw, " + ", ".join(f"round(sum(n_{s}), 5) AS n_{s}, round(sum(area_{s}), 4) AS area_{s}" for s in SIZES) + " FROM areas GROUP BY ALL")
def f10(spark, sf):
    return areas(spark, sf).groupBy("domain", "draw").agg(*[e for s in SIZES for e in (
        r(F.sum(f"n_{s}"), 5).alias(f"n_{s}"), r(F.sum(f"area_{s}"), 4).alias(f"area_{s}"))])


COMP_SQL = """comp AS (SELECT p_brand AS sensor_type, p_type AS element, CAST(min(p_size) AS DOUBLE) AS mass_lo, avg(p_size) AS mass_mode, CAST(max(p_size) AS DOUBLE) AS mass_hi FROM part GROUP BY ALL)"""


def composition(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("sensor_type"), F.col("p_type").alias("element")).agg(
        F.min("p_size").cast("double").alias("mass_lo"), F.avg("p_size").alias("mass_mode"), F.max("p_size").cast("double").alias("mass_hi"))


# sensor rows: one per supplier, brand and segment, with the range its line items span
SENSOR_SQL = RANGES_SQL + ", sensors AS (SELECT segment, sensor_type, l_suppkey AS comp_id, min(lo) AS lo, max(hi) AS hi FROM ranges GROUP BY ALL), " + COMP_SQL
MASS_SQL = SENSOR_SQL + f""", hashed AS MATERIALIZED (SELECT *, {sql_md5(42, 'count', 'segment', 'sensor_type', 'comp_id')} AS h_count, {sql_md5(42, 'mass', 'segment', 'sensor_type', 'comp_id', 'element')} AS h_mass
  FROM sensors JOIN comp USING (sensor_type) WHERE mass_hi > 0),
 masses AS (SELECT segment, sensor_type, comp_id, element, draw, {sql_uni(sql_at('h_count'), 'lo', 'hi')} * {sql_tri(sql_at('h_mass'), 'mass_lo', 'mass_mode', 'mass_hi')} AS value FROM hashed, range(4) t(draw))"""


def sensor_rows(spark, sf):
    return ranges(spark, sf).groupBy("segment", "sensor_type", F.col("l_suppkey").alias("comp_id")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def masses(spark, sf, n=4):
    return sp.count_times_mass(sensor_rows(spark, sf), composition(spark, sf), ["sensor_type"], n, ["segment", "sensor_type", "comp_id"])


@query("f11_count_times_mass", "WITH " + MASS_SQL + " SELECT segment, element, CAST(draw AS INTEGER) AS draw, round(sum(value), 2) AS mass FROM masses GROUP BY ALL")
def f11(spark, sf):
    return masses(spark, sf).groupBy("segment", "element", "draw").agg(r(F.sum("value"), 2).alias("mass"))


@query("f12_apply_uplift", "WITH " + RANGES_SQL + f""", x AS (SELECT segment, domain, mode AS value, {sql_keyed(42, 'volt', 'l_orderkey')} < 0.5 AS flag,
   {sql_tri(sql_keyed(42, 'uplift', 'l_orderkey'), '1.8::DOUBLE', '1.9::DOUBLE', '2.0::DOUBLE')} AS up FROM ranges)
SELECT segment, domain, count(*) AS n, round(avg(CASE WHEN domain = 'LARGE' THEN value * (1 + CASE WHEN flag THEN 1 ELSE 0 END * (up - 1)) ELSE value END), 7) AS mean FROM x GROUP BY ALL""")
def f12(spark, sf):
    x = ranges(spark, sf).withColumn("value", F.col("mode"))
    x = sp.apply_uplift(x, F.col("domain") == "LARGE", F.lit(0.5), (1.8, 1.9, 2.0), ["l_orderkey"])
    return x.groupBy("segment", "domain").agg(F.count("*").alias("n"), r(F.avg("value"), 7).alias("mean"))


H4_SQL = qc.SHARES_SQL + ", h4 AS (SELECT segment, year, share, max(CASE WHEN year = 1997 THEN share END) OVER (PARTITION BY segment) AS base FROM shares WHERE state = 'H4')"


@query("f13_apply_reduction", "WITH " + H4_SQL + ", " + qc.VEHICLES_SQL + f""", x AS (SELECT v.segment, vehicle, year, {sql_keyed(42, 'volt', 'vehicle')} AS uv,
   {sql_tri(sql_keyed(42, 'red', 'vehicle'), '0.40::DOUBLE', '0.425::DOUBLE', '0.45::DOUBLE')} AS red, share, base FROM vehicles v JOIN h4 ON v.segment = h4.segment)
SELECT segment, year, count(*) AS n, round(avg(8.96::DOUBLE * (1 - CASE WHEN uv < share THEN red ELSE 0 END) / greatest(1 - CASE WHEN uv < base THEN red ELSE 0 END, 1e-12::DOUBLE)), 7) AS rate FROM x GROUP BY ALL""")
def f13(spark, sf):
    h4 = gw.at_base(qc.shares(spark, sf).filter("state = 'H4'").drop("state"), ["segment"], "year", "share", 1997)
    x = qc.vehicles(spark, sf).select("segment", "vehicle").join(h4, "segment").withColumn("rate", F.lit(lit_rho()))
    x = sp.apply_reduction(x, "rate", F.col("share"), F.col("base"), lit.HV_CU_REDUCTION, ["vehicle"])
    return x.groupBy("segment", "year").agg(F.count("*").alias("n"), r(F.avg("rate"), 7).alias("rate"))


def lit_rho():
    return tx.COPPER_DENSITY_G_PER_CM3


# three architecture states: the yearly shares of the order status per segment
ARCH_SQL = """arch_src AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END AS segment,
   CASE o_orderstatus WHEN 'F' THEN 'Conventional' WHEN 'O' THEN 'Transitional' ELSE 'SDV_Zonal' END AS state, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS n
   FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 arch_anchor AS (SELECT segment, state, year, n / sum(n) OVER (PARTITION BY segment, year) AS share FROM arch_src), """ + qc.sql_curve("arch_anchor", "segment, state", "year", "share", "arch_curve") + """,
 arch_share AS (SELECT segment, state, year, share / greatest(sum(share) OVER (PARTITION BY segment, year), 1e-12::DOUBLE) AS share FROM arch_curve),
 arch_wide AS (SELECT segment, year, """ + ", ".join(f"coalesce(max(CASE WHEN state = '{s}' THEN share END), 0.0::DOUBLE) AS {s}" for s in lit.ARCH_STATES) + """ FROM arch_share GROUP BY ALL),
 arch_wide2 AS (SELECT *, """ + ", ".join(f"coalesce(lead({s}) OVER (PARTITION BY segment ORDER BY year), {s}) AS {s}_next" for s in lit.ARCH_STATES) + " FROM arch_wide), " + qc.VEHICLES_SQL + f""",
 adrv AS (SELECT segment, vehicle, {sql_keyed(42, 'state', 'vehicle')} AS u, {sql_norm(sql_keyed(42, 'a1', 'vehicle'), sql_keyed(42, 'a2', 'vehicle'), '0.0::DOUBLE', '5.0::DOUBLE')} AS delta FROM vehicles),
 apos AS (SELECT v.segment, vehicle, u, CAST(y AS INTEGER) AS year, least(greatest(y - delta, {Y0}), {Y1}) - {Y0} AS pos FROM adrv v, range({Y0}, {Y1 + 1}) t(y)),
 aix AS (SELECT *, least(floor(pos), {Y1 - Y0 - 1}) AS i, pos - least(floor(pos), {Y1 - Y0 - 1}) AS f FROM apos),
 araw AS (SELECT x.segment, vehicle, u, x.year, """ + ", ".join(f"greatest({s} * (1 - f) + {s}_next * f, 0) AS {s}" for s in lit.ARCH_STATES) + f""" FROM aix x JOIN arch_wide2 w ON x.segment = w.segment AND w.year = {Y0} + i),
 ashift AS (SELECT segment, vehicle, u, year, """ + ", ".join(f"{s} / greatest({' + '.join(lit.ARCH_STATES)}, 1e-12::DOUBLE) AS {s}" for s in lit.ARCH_STATES) + """ FROM araw),
 arch AS (SELECT *, CAST(least(CASE WHEN u > Conventional THEN 1 ELSE 0 END + CASE WHEN u > Conventional + Transitional THEN 1 ELSE 0 END + CASE WHEN u > Conventional + Transitional + SDV_Zonal THEN 1 ELSE 0 END, 2) AS INTEGER) AS state FROM ashift)"""


def arch_shares(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = (o.join(c, o.o_custkey == c.c_custkey).groupBy(
        F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END").alias("segment"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Conventional' WHEN 'O' THEN 'Transitional' ELSE 'SDV_Zonal' END").alias("state"),
        F.year("o_orderdate").alias("year")).agg(F.count("*").cast("double").alias("n")))
    a = gw.share_of(n, ["segment", "year"], "n", "share", bounded=True)
    return cv.share_curves(a, ["segment"], "state", "year", "share", Y0, Y1)


def with_arch(d, spark, sf):
    wide = cv.wide_curve(arch_shares(spark, sf), ["segment"], "state", "share", lit.ARCH_STATES)
    s = cv.shift_curve(d, wide, ["segment"], "arch_delta", (Y0, Y1), lit.ARCH_STATES)
    return s.withColumn("state", dr.comonotonic_state("arch_u", lit.ARCH_STATES).cast("int")).drop("arch_u", "arch_delta")


def arch_streams(v):
    """The architecture has a state uniform and a timing offset of its own, apart from the tier's."""
    k = lambda name: dr.keyed_uniform(42, name, "vehicle")
    return v.withColumns({"arch_u": k("state"), "arch_delta": dr.normal(k("a1"), k("a2"), 0.0, lit.TIMING_SPREAD_Y)})


def arch(spark, sf):
    """Architecture state of every vehicle and year, with its shifted shares."""
    return with_arch(over_years(arch_streams(qc.vehicles(spark, sf))), spark, sf).drop("delta")


# the scenarios' years, laid over the years of the given tables
SCENARIO_SPAN = lit.SCENARIO_YEARS[-1] - lit.SCENARIO_YEARS[0]
AXIS_SQL = f"({float(lit.SCENARIO_YEARS[0])}::DOUBLE + (t.year - {Y0}) * {SCENARIO_SPAN / (Y1 - Y0)!r}::DOUBLE)"



def scenario_axis():
    return F.lit(float(lit.SCENARIO_YEARS[0])) + (F.col("year") - Y0) * F.lit(SCENARIO_SPAN / (Y1 - Y0))


def scenario_sql(u):
    """One row of the piecewise curve per scenario and stretch of years."""
    out, edge = [], 0.0
    for n, (v, w) in lit.SCENARIOS.items():
        edge += w
        x = lit.SCENARIO_YEARS
        steps = " ".join(f"WHEN {AXIS_SQL} < {float(x[i + 1])}::DOUBLE THEN {v[i]!r}::DOUBLE + ({AXIS_SQL} - {float(x[i])}::DOUBLE) / {float(x[i + 1] - x[i])}::DOUBLE * {v[i + 1] - v[i]!r}::DOUBLE" for i in range(len(x) - 1))
        out.append(f"WHEN {u} < {edge!r}::DOUBLE THEN CASE {steps} ELSE {v[-1]!r}::DOUBLE END")
    return "CASE " + " ".join(out) + " END"


def zonal_sql(state, u):
    f = sql_tri(u, *[f"{x}::DOUBLE" for x in lit.ZONAL_METRES])
    return f"CASE {state} WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1 - (1 - {f}) / 2 ELSE {f} END"


def fleet(spark, sf):
    """Tier, architecture state and lidar of every vehicle and year, on the same rows: no join between vehicles."""
    v = arch_streams(sp.sensor_streams(lidar_vehicles(spark, sf))).withColumns({f"u_{n}": dr.keyed_uniform(42, n, "vehicle") for n in ("scenario", "zonal")})
    wide = cv.wide_curve(qc.shares(spark, sf), ["segment"], "state", "share", STATES)
    d = cv.shift_curve(over_years(v), wide, ["segment"], "delta", (Y0, Y1), STATES)
    d = d.withColumn("tier", dr.comonotonic_state("u", STATES).cast("int")).drop(*STATES)
    d = with_lidar(with_arch(d, spark, sf), spark, sf)
    return d.withColumns({"equipped": F.when(dr.bernoulli("e", "lidar_share"), 1.0).otherwise(0.0),
                          "mult": sp.scenario_multiplier(F.col("u_scenario"), scenario_axis()), "arch_mult": sp.zonal_multiplier("u_zonal", F.col("state"))}
                         ).drop("e", "u", "delta", "lidar_share", "u_scenario", "u_zonal")


# wire categories: one per part brand, with a base length and a depth factor
CATS_SQL = """cats AS (SELECT p_brand AS category, CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) <= 4 THEN 'ADAS / Sensor' WHEN CAST(substr(p_brand, 7) AS INTEGER) <= 8 THEN 'HV Power'
   WHEN CAST(substr(p_brand, 7) AS INTEGER) <= 16 THEN 'LV Power' ELSE 'Signal / Comm' END AS grp, avg(p_retailprice) / 50 AS base_m, 0.5 + avg(p_size) / 50 AS sdv, CAST(min(p_size) AS DOUBLE) / 10 AS g_lo, CAST(max(p_size) AS DOUBLE) / 10 AS g_hi FROM part GROUP BY ALL)"""


def categories(spark, sf):
    num = F.substring("p_brand", 7, 10).cast("int")
    return table(spark, sf, "part").groupBy(
        F.col("p_brand").alias("category"),
        F.when(num <= 4, "ADAS / Sensor").when(num <= 8, "HV Power").when(num <= 16, "LV Power").otherwise("Signal / Comm").alias("grp")).agg(
        (F.avg("p_retailprice") / 50).alias("base_m"), (0.5 + F.avg("p_size") / 50).alias("sdv"),
        (F.min("p_size").cast("double") / 10).alias("g_lo"), (F.max("p_size").cast("double") / 10).alias("g_hi"))


@query("f14_state_factor", "WITH " + ARCH_SQL + ", " + CATS_SQL + f"""
SELECT segment, year, category, round(avg(CASE state WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE CASE WHEN sdv < 1 THEN greatest(0, 1 - (1 - sdv) * {sql_tri(sql_keyed(42, 'depth', 'vehicle'), '0.4::DOUBLE', '0.7::DOUBLE', '1.0::DOUBLE')}) ELSE sdv END END), 6) AS factor
FROM arch, cats GROUP BY ALL""")
def f14(spark, sf):
    depth = dr.triangular("_ud", F.lit(0.4), F.lit(0.7), F.lit(1.0))
    a = arch(spark, sf).withColumn("_ud", dr.keyed_uniform(42, "depth", "vehicle")).select("segment", "vehicle", "year", "state", depth.alias("depth"))
    cats = categories(spark, sf).select("category", "sdv")
    j = a.crossJoin(F.broadcast(cats))            # the categories of one harness: 25 brands
    f = sp.state_factor("state", F.lit(1.5), F.lit(1.0), "sdv", "depth")
    return j.groupBy("segment", "year", "category").agg(r(F.avg(f), 6).alias("factor"))


CV_IND = (lit.CV_CATEGORY ** 2 - lit.CV_VEHICLE ** 2) ** 0.5


def var_sql(vehicle, category):
    return ("greatest(" + sql_norm(sql_keyed(42, "veh1", vehicle), sql_keyed(42, "veh2", vehicle), "1.0::DOUBLE", f"{lit.CV_VEHICLE}::DOUBLE") + " * "
            + sql_norm(sql_keyed(42, "cat1", vehicle, category), sql_keyed(42, "cat2", vehicle, category), "1.0::DOUBLE", f"{CV_IND!r}::DOUBLE") + f", {lit.VARIABILITY_FLOOR}::DOUBLE)")


@query("f15_variability", "WITH v AS (SELECT l_linenumber AS category, " + var_sql("l_orderkey", "l_linenumber") + " AS x FROM lineitem) " + moments_sql("category", "x", "v", 7))
def f15(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("category"), sp.variability(["l_orderkey"], ["l_linenumber"]).alias("x"))
    return moments(v, ["category"], "x", 7)


COUNT_TABLE_SQL = "tcounts(segment, tier, sensor, n_lo, n_mode, n_hi) AS (VALUES " + ", ".join(
    f"('{seg}', {lit.TIERS.index(t)}, '{st}', {float(v[2 * i])}::DOUBLE, {(v[2 * i] + v[2 * i + 1]) / 2.0}::DOUBLE, {max(float(v[2 * i + 1]), v[2 * i] + 1e-9)!r}::DOUBLE)"
    for (seg, t), v in lit.TIER_COUNTS.items() for i, st in enumerate(lit.TIER_COUNT_TYPES)) + ")"
METRES_SQL = "metres AS (SELECT " + SEG_SQL + """ AS segment, CASE l_linenumber % 4 WHEN 0 THEN 'camera' WHEN 1 THEN 'radar' WHEN 2 THEN 'ultrasonic' ELSE 'lidar' END AS sensor,
   min(l_quantity) AS m_lo, avg(l_quantity) AS m_mode, max(l_quantity) AS m_hi FROM lineitem GROUP BY ALL)"""
SENSOR_LEN_SQL = TIERED_SQL + ", " + LIDAR_SQL.split("anchors AS", 1)[0] + LIDAR_SQL[len(qc.CURVE_SQL) + 2:] + ", " + ARCH_SQL[:ARCH_SQL.index(qc.VEHICLES_SQL)] + ARCH_SQL[ARCH_SQL.index(qc.VEHICLES_SQL) + len(qc.VEHICLES_SQL) + 1:].lstrip() + ", " + COUNT_TABLE_SQL + ", " + METRES_SQL + f""",
 eq AS (SELECT vehicle, year, CASE WHEN e < share THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS equipped FROM lidar),
 slen AS (SELECT t.segment, t.vehicle, t.year, sum({sql_tri(sql_at(sql_md5(42, 'sensors', 't.vehicle', 'c.sensor'), 't.tier'), 'n_lo', 'n_mode', 'n_hi')} * CASE WHEN c.sensor = 'lidar' THEN equipped ELSE 1.0::DOUBLE END
   * {scenario_sql(sql_keyed(42, 'scenario', 't.vehicle'))} * {sql_tri(sql_at(sql_md5(42, 'metres', 't.vehicle', 'c.sensor'), '0'), 'm_lo', 'm_mode', 'm_hi')} * {zonal_sql('a.state', sql_keyed(42, 'zonal', 't.vehicle'))}) AS length_m
   FROM tiered t JOIN eq ON eq.vehicle = t.vehicle AND eq.year = t.year JOIN arch a ON a.vehicle = t.vehicle AND a.year = t.year JOIN tcounts c ON c.segment = t.segment AND c.tier = t.tier JOIN metres m ON m.segment = c.segment AND m.sensor = c.sensor GROUP BY ALL)"""


def metres(spark, sf):
    kind = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'camera' WHEN 1 THEN 'radar' WHEN 2 THEN 'ultrasonic' ELSE 'lidar' END")
    q = lambda s: F.when(kind == s, F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy(segment_col().alias("segment")).agg(*[e for s in lit.TIER_COUNT_TYPES for e in (
        F.min(q(s)).alias(f"m_{s}_lo"), F.avg(q(s)).alias(f"m_{s}_mode"), F.max(q(s)).alias(f"m_{s}_hi"))])


def sensor_lengths(spark, sf):
    return sp.sensor_length(fleet(spark, sf), sp.tier_counts(spark), metres(spark, sf))


@query("f16_sensor_length", "WITH " + SENSOR_LEN_SQL + " SELECT segment, vehicle, year, round(length_m, 5) + 0.0 AS length_m FROM slen")
def f16(spark, sf):
    return sensor_lengths(spark, sf).select("segment", "vehicle", "year", r("length_m", 5).alias("length_m"))


@query("f17_derive_segments", "WITH x AS (SELECT " + SEG_SQL + """ AS segment, l_orderkey, sum(l_quantity) AS length FROM lineitem GROUP BY ALL)
SELECT segment, l_orderkey, length FROM x UNION ALL SELECT CASE segment WHEN 'AB' THEN 'JA-JB' WHEN 'CD' THEN 'JC-JD' ELSE 'JE-JF' END, l_orderkey,
 round(length * (1 + """ + sql_tri(sql_keyed(42, "height", "l_orderkey"), "0.05::DOUBLE", "0.1::DOUBLE", "0.15::DOUBLE") + "), 7) FROM x")
def f17(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(segment_col().alias("segment"), "l_orderkey").agg(F.sum("l_quantity").alias("length"))
    return sp.derive_segments(x, {"AB": "JA-JB", "CD": "JC-JD", "EF": "JE-JF"}, ["length"], ["l_orderkey"]).withColumn("length", r("length", 7))


PRES_ROWS = [(i, name, *t) for i, (name, t) in enumerate(lit.ARCH_PRESENCE.items())]
CALIB_SQL = ARCH_SQL + ", " + COMPONENTS_SQL + """, t_vec(ix, comp, t0, t1, t2) AS (VALUES """ + ", ".join(
    f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, n, a, b, c in PRES_ROWS) + """),
 lab AS (SELECT brand, avg(CASE label_ab WHEN 'Std' THEN 1.0 WHEN 'Opt' THEN 0.5 WHEN 'Rare' THEN 0.25 ELSE 0.0 END) AS x FROM components GROUP BY 1),
 obs AS (SELECT comp, t0, t1, t2, CAST(CASE WHEN x2 >= 0.75 THEN 1.0 WHEN x2 >= 0.375 THEN 0.5 WHEN x2 >= 0.125 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS o FROM (
   SELECT *, CASE WHEN ix < 3 THEN 0.0 ELSE x END AS x2 FROM t_vec JOIN lab ON brand = 'Brand#' || (ix + 1))),
 obs2 AS (SELECT *, CAST(CASE o WHEN 1.0 THEN 0.75 WHEN 0.5 THEN 0.375 WHEN 0.25 THEN 0.125 ELSE 0.0 END AS DOUBLE) AS o_lo, CAST(CASE o WHEN 1.0 THEN 1.0 WHEN 0.5 THEN 0.75 WHEN 0.25 THEN 0.375 ELSE 0.125 END AS DOUBLE) AS o_hi FROM obs),
 ab AS (SELECT vehicle, max(CASE WHEN year = 1997 THEN Conventional END) AS b0, max(CASE WHEN year = 1997 THEN Transitional END) AS b1, max(CASE WHEN year = 1997 THEN SDV_Zonal END) AS b2 FROM arch GROUP BY 1),
 cal0 AS (SELECT a.segment, a.vehicle, a.year, state, comp, t0, t1, t2, o, t0 * b0 + t1 * b1 + t2 * b2 AS c25,
   """ + sql_tri(sql_keyed(42, "label", "a.vehicle", "comp"), "o_lo", "o", "o_hi") + """ AS od FROM arch a JOIN ab ON ab.vehicle = a.vehicle, obs2),
 calib AS (SELECT segment, vehicle, year, comp, CASE state WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END * least(greatest(CASE WHEN c25 <= 1e-12 THEN 1 WHEN o <= 1e-12 AND c25 < 0.15 THEN 1 ELSE od / greatest(c25, 1e-12::DOUBLE) END, 0), 1) AS presence FROM cal0)"""


def calibrated(spark, sf):
    t = spark.createDataFrame(PRES_ROWS, "ix int, comp string, t0 double, t1 double, t2 double")
    lab = components(spark, sf).groupBy("brand").agg(F.avg(tx.factor_lenient("label_ab")).alias("x"))
    o = t.join(lab, F.col("brand") == F.concat(F.lit("Brand#"), F.col("ix") + 1)).withColumn(
        "o", cl.nearest_level(F.when(F.col("ix") < 3, F.lit(0.0)).otherwise(F.col("x"))))
    lo, hi = cl.label_bin("o")
    o = o.select("comp", "t0", "t1", "t2", "o", lo.alias("o_lo"), hi.alias("o_hi"))
    a = arch(spark, sf)
    at97 = lambda c, n: F.max(F.when(F.col("year") == 1997, F.col(c))).alias(n)
    base = a.groupBy("vehicle").agg(*[at97(s, f"b{i}") for i, s in enumerate(lit.ARCH_STATES)])
    j = a.select("segment", "vehicle", "year", "state").join(base, "vehicle").crossJoin(F.broadcast(o))   # 8 components
    j = j.withColumn("_ul", dr.keyed_uniform(42, "label", "vehicle", "comp"))
    od = dr.triangular("_ul", "o_lo", "o", "o_hi")
    c = F.col
    p = sp.calibrated_presence(c("state"), [c("t0"), c("t1"), c("t2")], [c("b0"), c("b1"), c("b2")], c("o"), od)
    return j.select("segment", "vehicle", "year", "comp", p.alias("presence"))


@query("f18_calibrated_presence", "WITH " + CALIB_SQL + " SELECT segment, year, comp, round(avg(presence), 8) + 0.0 AS presence FROM calib GROUP BY ALL")
def f18(spark, sf):
    return calibrated(spark, sf).groupBy("segment", "year", "comp").agg(r(F.avg("presence"), 8).alias("presence"))


# sub-segments of a group are the market segments of the order's customer
MOTOR_SQL = """motors AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END AS segment, c_mktsegment AS sub,
   o_orderpriority AS motor, o_custkey % 50 AS slot, CAST(min(o_orderkey % 7) AS DOUBLE) AS lo, CAST(max(o_orderkey % 7) AS DOUBLE) AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def motors(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(
        F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END").alias("segment"),
        F.col("c_mktsegment").alias("sub"), F.col("o_orderpriority").alias("motor"), (F.col("o_custkey") % 50).alias("slot")).agg(
        F.min(F.col("o_orderkey") % 7).cast("double").alias("lo"), F.max(F.col("o_orderkey") % 7).cast("double").alias("hi"))


MKEY = ["sub", "motor", "slot"]
GROUP_AVG_SQL = MOTOR_SQL + f""", gd AS (SELECT segment, motor, sub, CAST(draw AS INTEGER) AS draw, {sql_uni(sql_at('h'), 'lo', 'hi')} AS x FROM (SELECT *, {sql_md5(42, 'count', *MKEY)} AS h FROM motors WHERE hi > 0), range(200) t(draw)),
 gavg AS (SELECT segment, motor, draw, sum(x) / any_value(n) AS count FROM gd JOIN (SELECT segment, motor, count(DISTINCT sub) AS n FROM motors WHERE hi > 0 GROUP BY ALL) USING (segment, motor) GROUP BY ALL)"""


def group_counts(spark, sf, n=200):
    return sp.group_average_draws(motors(spark, sf), n, ["segment", "motor"], "sub", MKEY)


@query("f19_group_average_draws", "WITH " + GROUP_AVG_SQL + " SELECT segment, motor, draw, round(count, 7) AS count FROM gavg")
def f19(spark, sf):
    return group_counts(spark, sf).withColumn("count", r("count", 7))


MASSD_SQL = GROUP_AVG_SQL + f""", md AS (SELECT segment, motor, draw, count * CASE WHEN motor = '5-LOW' THEN 0.5 * {sql_uni(sql_keyed(42, 'gbp', 'segment', 'draw'), '0.3::DOUBLE', '0.6::DOUBLE')} ELSE 1 END AS count,
   {sql_uni(sql_keyed(42, 'unit', 'segment', 'motor', 'draw'), '60.0::DOUBLE', '180.0::DOUBLE')} AS unit_g, {sql_uni(sql_keyed(42, 'extra', 'segment', 'motor', 'draw'), '20.0::DOUBLE', '90.0::DOUBLE')} AS extra_g,
   motor = '5-LOW' OR {sql_keyed(42, 'gb', 'segment', 'motor', 'draw')} < {sql_uni(sql_keyed(42, 'gbp', 'segment', 'draw'), '0.3::DOUBLE', '0.6::DOUBLE')} AS geared FROM gavg),
 motor_mass AS (SELECT segment, motor, draw, count, unit_g + CASE WHEN geared THEN extra_g ELSE 0 END AS unit_mass_g, count * (unit_g + CASE WHEN geared THEN extra_g ELSE 0 END) / 1000 AS mass_kg FROM md)"""


def motor_mass(spark, sf, n=200):
    """One class is always geared and is split into two halves times the gear probability."""
    k = lambda v, *c: dr.keyed_uniform(42, v, *c)
    prob = dr.uniform(k("gbp", "segment", "draw"), F.lit(0.3), F.lit(0.6))
    three = ("segment", "motor", "draw")
    g = group_counts(spark, sf, n).withColumns({
        "prob": prob, "unit_g": dr.uniform(k("unit", *three), F.lit(60.0), F.lit(180.0)), "extra_g": dr.uniform(k("extra", *three), F.lit(20.0), F.lit(90.0))})
    low = F.col("motor") == "5-LOW"
    g = g.withColumns({"geared": low | dr.bernoulli(k("gb", *three), "prob"), "count": F.when(low, F.col("count") * (F.lit(0.5) * F.col("prob"))).otherwise(F.col("count"))})
    return g.select(*three, "count", (F.col("unit_g") + F.when(F.col("geared"), F.col("extra_g")).otherwise(0.0)).alias("unit_mass_g"),
                    sp.mass_draws("count", "unit_g", "extra_g", "geared").alias("mass_kg"))


@query("f20_mass_draws", "WITH " + MASSD_SQL + " SELECT segment, motor, draw, round(count, 7) AS count, round(mass_kg, 7) AS mass_kg FROM motor_mass")
def f20(spark, sf):
    return motor_mass(spark, sf).select("segment", "motor", "draw", r("count", 7).alias("count"), r("mass_kg", 7).alias("mass_kg"))


MATS = ["copper", "steel", "plastic", "aluminum_steel"]
MAT_COL = "CASE l_linenumber WHEN 1 THEN 'copper' WHEN 2 THEN 'copper' WHEN 3 THEN 'steel' WHEN 4 THEN 'steel' WHEN 5 THEN 'plastic' ELSE 'aluminum_steel' END"
MAT_SQL = "mats AS (SELECT " + SEG_SQL + " AS segment, l_suppkey, sum(l_quantity) AS mass, " + ", ".join(
    f"coalesce(min(CASE WHEN {MAT_COL} = '{m}' THEN l_quantity END), 0.0::DOUBLE) AS {m}_lo, coalesce(avg(CASE WHEN {MAT_COL} = '{m}' THEN l_quantity END), 0.0::DOUBLE) AS {m}_mode, coalesce(max(CASE WHEN {MAT_COL} = '{m}' THEN l_quantity END), 0.0::DOUBLE) AS {m}_hi"
    for m in MATS) + " FROM lineitem GROUP BY ALL)"
MATD_SQL = MAT_SQL + f""", hashed AS MATERIALIZED (SELECT *, {', '.join(f"{sql_md5(42, m, 'segment', 'l_suppkey')} AS h_{m}" for m in MATS)} FROM mats),
 mr AS (SELECT segment, l_suppkey, draw, mass, {', '.join(f"{sql_tri(sql_at(f'h_{m}'), f'{m}_lo', f'{m}_mode', f'{m}_hi')} AS r_{m}" for m in MATS)} FROM hashed, range(20) t(draw)),
 mt AS (SELECT *, CASE WHEN {' + '.join(f'r_{m}' for m in MATS)} = 0 THEN 1 ELSE {' + '.join(f'r_{m}' for m in MATS)} END AS t FROM mr),
 matd AS (""" + " UNION ALL ".join(f"SELECT segment, l_suppkey, draw, '{m}' AS material, mass * (r_{m} / t) AS mass_kg, r_{m} / t AS ratio FROM mt" for m in MATS) + ")"


def material_params(spark, sf):
    kind = F.expr(MAT_COL)
    pick = lambda m: F.when(kind == m, F.col("l_quantity"))
    z = lambda e: F.coalesce(e, F.lit(0.0))
    return table(spark, sf, "lineitem").groupBy(segment_col().alias("segment"), "l_suppkey").agg(
        F.sum("l_quantity").alias("mass"), *[e for m in MATS for e in (
            z(F.min(pick(m))).alias(f"{m}_lo"), z(F.avg(pick(m))).alias(f"{m}_mode"), z(F.max(pick(m))).alias(f"{m}_hi"))])


def material_rows(spark, sf, n=20):
    return sp.material_draws(material_params(spark, sf), n, ["segment", "l_suppkey"], MATS)


@query("f21_material_draws", "WITH " + MATD_SQL + """, s AS (SELECT segment, draw, material, mass_kg, ratio FROM matd WHERE material <> 'aluminum_steel'
 UNION ALL SELECT segment, draw, 'aluminum', mass_kg * 0.6::DOUBLE, ratio * 0.6::DOUBLE FROM matd WHERE material = 'aluminum_steel' UNION ALL SELECT segment, draw, 'steel', mass_kg * 0.4::DOUBLE, ratio * 0.4::DOUBLE FROM matd WHERE material = 'aluminum_steel')
SELECT segment, CAST(draw AS INTEGER) AS draw, material, round(sum(mass_kg), 4) AS mass_kg, round(sum(ratio), 6) AS ratio FROM s GROUP BY ALL""")
def f21(spark, sf):
    m = material_rows(spark, sf).select("segment", "draw", "material", "mass_kg", "ratio")
    split = F.when(F.col("material") == "aluminum_steel", F.array(
        F.struct(F.lit("aluminum").alias("n"), F.lit(0.6).alias("f")), F.struct(F.lit("steel").alias("n"), F.lit(0.4).alias("f")))).otherwise(
        F.array(F.struct(F.col("material").alias("n"), F.lit(1.0).alias("f"))))
    m = m.withColumn("p", F.explode(split))
    return m.groupBy("segment", "draw", F.col("p.n").alias("material")).agg(
        r(F.sum(F.col("mass_kg") * F.col("p.f")), 4).alias("mass_kg"), r(F.sum(F.col("ratio") * F.col("p.f")), 6).alias("ratio"))


GRADES_SQL = """grades AS (SELECT p_brand AS grade, p_type AS element, CAST(min(p_size) AS DOUBLE) / 1000 AS lo, CAST(max(p_size) AS DOUBLE) / 400 AS hi FROM part GROUP BY ALL),
 gweights AS (SELECT """ + SEG_SQL + """ AS segment, p_brand AS grade, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 gw2 AS (SELECT segment, grade, weight / sum(weight) OVER (PARTITION BY segment) AS weight FROM gweights),
 gmix AS (SELECT segment, element, CAST(draw AS INTEGER) AS draw, sum(weight * """ + sql_uni(sql_at("h"), "lo", "hi") + ") AS fraction FROM (SELECT *, " + sql_md5(42, "grade", "segment", "grade", "element") + """ AS h FROM gw2 JOIN grades USING (grade)), range(100) t(draw) GROUP BY ALL),
 gfull AS (SELECT * FROM gmix UNION ALL SELECT segment, 'Fe', draw, least(greatest(1 - sum(fraction), 0), 1) FROM gmix GROUP BY ALL)"""


def grade_fractions(spark, sf, n=100):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("grade"), F.col("p_type").alias("element")).agg(
        (F.min("p_size").cast("double") / 1000).alias("lo"), (F.max("p_size").cast("double") / 400).alias("hi"))
    w = ranges(spark, sf).groupBy("segment", F.col("sensor_type").alias("grade")).agg(F.count("*").cast("double").alias("weight"))
    return sp.grade_mix(g, w, n, ["segment"])


@query("f22_grade_mix", "WITH " + GRADES_SQL + " SELECT segment, element, draw, round(fraction, 9) AS fraction FROM gfull")
def f22(spark, sf):
    return grade_fractions(spark, sf).select("segment", "element", "draw", r("fraction", 9).alias("fraction"))


HIST_SQL = "hist AS (SELECT " + SEG_SQL + """ AS segment, CAST(floor(l_quantity / 1.25) AS BIGINT) AS bin, floor(l_quantity / 1.25) * 1.25 AS bin_left, floor(l_quantity / 1.25) * 1.25 + 1.25 AS bin_right, count(*) AS count FROM lineitem GROUP BY ALL),
 cum AS (SELECT *, CAST(sum(count) OVER (PARTITION BY segment ORDER BY bin_left) AS DOUBLE) AS c_hi, CAST(sum(count) OVER (PARTITION BY segment) AS DOUBLE) AS tot FROM hist),
 rs AS (SELECT s.segment, CAST(draw AS INTEGER) AS draw, """ + sql_at(sql_md5(42, "bin", "s.segment")) + " AS u, " + sql_at(sql_md5(42, "inside", "s.segment")) + """ AS v FROM (SELECT DISTINCT segment FROM hist) s, range(4000) t(draw)),
 resampled AS (SELECT rs.segment, draw, v, bin_left, bin_right FROM rs JOIN cum ON rs.segment = cum.segment AND u * tot >= c_hi - count AND u * tot < c_hi)"""


def hist(spark, sf):
    b = F.floor(F.col("l_quantity") / 1.25)
    return table(spark, sf, "lineitem").groupBy(segment_col().alias("segment"), b.alias("bin")).agg(F.count("*").alias("count")).withColumns(
        {"bin_left": F.col("bin") * F.lit(1.25), "bin_right": F.col("bin") * F.lit(1.25) + F.lit(1.25)})


@query("f23_resample_centres", "WITH " + HIST_SQL + " SELECT segment, draw, (bin_left + bin_right) / 2 AS value FROM resampled")
def f23(spark, sf):
    return sp.resample(hist(spark, sf), ["segment"], 4000)


@query("f24_resample_bins", "WITH " + HIST_SQL + " SELECT segment, draw, round(bin_left + v * (bin_right - bin_left), 8) AS value FROM resampled")
def f24(spark, sf):
    return sp.resample(hist(spark, sf), ["segment"], 4000, within=True).withColumn("value", r("value", 8))


CONC_SQL = "conc AS (SELECT p_type AS element, CAST(min(p_size) AS DOUBLE) AS lo, avg(p_size) AS mode, CAST(max(p_size) AS DOUBLE) AS hi FROM part GROUP BY 1)"
EMASS_SQL = HIST_SQL + ", " + CONC_SQL + ", emass AS (SELECT segment, draw, element, (bin_left + bin_right) / 2 AS area, " + sql_tri(sql_at(sql_md5(42, "conc", "segment", "element")), "lo", "mode", "hi") + """ AS conc FROM resampled, conc),
 emass2 AS (SELECT *, conc * area / 1000 AS mass_g FROM emass)"""


def concentrations(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("element")).agg(
        F.min("p_size").cast("double").alias("lo"), F.avg("p_size").alias("mode"), F.max("p_size").cast("double").alias("hi"))


def element_masses(spark, sf, n=4000):
    h = hist(spark, sf)
    area = sp.resample(h, ["segment"], n).withColumnRenamed("value", "area")
    conc = h.select("segment").distinct().crossJoin(F.broadcast(concentrations(spark, sf)))        # series x elements
    conc = checked_broadcast(dr.with_streams(conc, 42, ["segment", "element"], ["conc"]))
    j = dr.draw_uniforms(area.join(conc, "segment"), {"_uc": ("u_conc", "draw")}).withColumn("conc", dr.triangular("_uc", "lo", "mode", "hi"))
    return j.select("segment", "draw", "element", "area", "conc", sp.element_mass("conc", "area").alias("mass_g"))


@query("f25_element_mass", "WITH " + EMASS_SQL + " SELECT segment, element, count(*) AS n, round(avg(mass_g), 8) AS mean_g, round(stddev_pop(mass_g), 8) AS std_g FROM emass2 GROUP BY ALL")
def f25(spark, sf):
    return element_masses(spark, sf).groupBy("segment", "element").agg(
        F.count("*").alias("n"), r(F.avg("mass_g"), 8).alias("mean_g"), r(F.stddev_pop("mass_g"), 8).alias("std_g"))
