"""E: curves and the year axis. Anchors are yearly shares found in orders."""

from pyspark.sql import functions as F

from massweave.functions import draws as dr
from massweave.operators import curves as cv
from massweave.operators import groupwise as gw
from massweave.plans import literals as lit
from massweave.queries._base import (ANCHORS_SQL, RANGES_SQL, STATES, anchors, query, r, ranges, sql_keyed, sql_norm,
                                     table)
from massweave.scale import spread

Y0, Y1 = 1993, 2004          # grid of the queries: two years beyond the anchors on both sides


def sql_curve(src: str, by: str, x: str, y: str, name: str, clip: bool = True, y0: int = Y0, y1: int = Y1) -> str:
    """Reference SQL of the monotone cubic, as CTEs ending in `name`."""
    def end(h0, h1, d0, d1):
        m = f"((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})"
        return (f"CASE WHEN {h1} IS NULL THEN {d0} WHEN sign({m}) <> sign({d0}) THEN 0 "
                f"WHEN sign({d0}) <> sign({d1}) AND abs({m}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {m} END")
    w = f"WINDOW w AS (PARTITION BY {by} ORDER BY x)"
    v = "CASE WHEN xn IS NULL THEN y ELSE (1 + 2 * s) * (1 - s) * (1 - s) * y + s * (1 - s) * (1 - s) * h * m + s * s * (3 - 2 * s) * yn + s * s * (s - 1) * h * mn END"
    if clip:
        v = f"least(greatest({v}, 0), 1)"
    return f"""{name}_a AS (SELECT {by}, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src}),
 {name}_b AS (SELECT *, lead(x) OVER w AS xn, lead(y) OVER w AS yn, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d FROM {name}_a {w}),
 {name}_c AS (SELECT *, lag(h) OVER w AS hp, lag(d) OVER w AS dp, lead(h) OVER w AS hn, lead(d) OVER w AS dn, lag(h, 2) OVER w AS hpp, lag(d, 2) OVER w AS dpp FROM {name}_b {w}),
 {name}_d AS (SELECT *, CASE WHEN dp IS NULL AND d IS NULL THEN 0 WHEN dp IS NULL THEN {end('h', 'hn', 'd', 'dn')}
   WHEN d IS NULL THEN {end('hp', 'hpp', 'dp', 'dpp')} WHEN dp * d <= 0 THEN 0
   ELSE (3 * h + 3 * hp) / ((2 * h + hp) / dp + (h + 2 * hp) / d) END AS m FROM {name}_c),
 {name}_e AS (SELECT *, lead(m) OVER w AS mn, min(x) OVER (PARTITION BY {by}) AS x0, max(x) OVER (PARTITION BY {by}) AS x1 FROM {name}_d {w}),
 {name}_f AS (SELECT {by}, CAST(g AS INTEGER) AS year, x, y, xn, yn, h, m, mn, (least(greatest(g, x0), x1) - x) / h AS s
   FROM {name}_e, range({y0}, {y1 + 1}) t(g) WHERE least(greatest(g, x0), x1) >= x AND (xn IS NULL OR least(greatest(g, x0), x1) < xn)),
 {name} AS (SELECT {by}, year, {v} AS {y} FROM {name}_f)"""


CURVE_SQL = ANCHORS_SQL + ", " + sql_curve("anchors", "segment, state", "year", "share", "curve")
SHARES_SQL = CURVE_SQL + """, shares AS (SELECT segment, state, year, share / greatest(sum(share) OVER (PARTITION BY segment, year), 1e-12::DOUBLE) AS share FROM curve)"""


def shares(spark, sf):
    return cv.share_curves(anchors(spark, sf), ["segment"], "state", "year", "share", Y0, Y1)


@query("e01_monotone_curve", "WITH " + CURVE_SQL + " SELECT segment, state, year, round(share, 9) AS share FROM curve")
def e01(spark, sf):
    return cv.monotone_curve(anchors(spark, sf), ["segment", "state"], "year", "share", Y0, Y1).withColumn("share", r("share", 9))


VEHICLES_SQL = f"""vehicles AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD'
     WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END AS segment, c_custkey AS vehicle,
   {sql_keyed(42, 'arch', 'c_custkey')} AS u,
   {sql_norm(sql_keyed(42, 'd1', 'c_custkey'), sql_keyed(42, 'd2', 'c_custkey'), '0.0::DOUBLE', '5.0::DOUBLE')} AS delta FROM customer)"""


def vehicles(spark, sf):
    """Every customer is one vehicle, with its own timing offset and state uniform."""
    return spread(table(spark, sf, "customer")).select(
        F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' "
               "WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END").alias("segment"),
        F.col("c_custkey").alias("vehicle"), dr.keyed_uniform(42, "arch", "c_custkey").alias("u"),
        dr.normal(dr.keyed_uniform(42, "d1", "c_custkey"), dr.keyed_uniform(42, "d2", "c_custkey"), 0.0, lit.TIMING_SPREAD_Y).alias("delta"))


WIDE_SQL = SHARES_SQL + ", wide AS (SELECT segment, year, " + ", ".join(
    f"coalesce(max(CASE WHEN state = '{s}' THEN share END), 0.0::DOUBLE) AS {s}" for s in STATES) + " FROM shares GROUP BY ALL), wide2 AS (SELECT *, " + ", ".join(
    f"coalesce(lead({s}) OVER (PARTITION BY segment ORDER BY year), {s}) AS {s}_next" for s in STATES) + " FROM wide)"
SHIFT_SQL = WIDE_SQL + ", " + VEHICLES_SQL + f""", pos AS (SELECT v.segment, vehicle, u, CAST(y AS INTEGER) AS year, least(greatest(y - delta, {Y0}), {Y1}) - {Y0} AS pos
   FROM vehicles v, range({Y0}, {Y1 + 1}) t(y)),
 ix AS (SELECT *, least(floor(pos), {Y1 - Y0 - 1}) AS i, pos - least(floor(pos), {Y1 - Y0 - 1}) AS f FROM pos),
 raw AS (SELECT ix.segment, vehicle, u, ix.year, """ + ", ".join(f"greatest({s} * (1 - f) + {s}_next * f, 0) AS {s}" for s in STATES) + f""" FROM ix JOIN wide2 w ON ix.segment = w.segment AND w.year = {Y0} + i),
 shifted AS (SELECT segment, vehicle, u, year, """ + ", ".join(f"{s} / greatest({' + '.join(STATES)}, 1e-12::DOUBLE) AS {s}" for s in STATES) + " FROM raw)"


def shifted(spark, sf):
    wide = cv.wide_curve(shares(spark, sf), ["segment"], "state", "share", STATES)
    d = vehicles(spark, sf).withColumn("year", F.explode(F.sequence(F.lit(Y0), F.lit(Y1))))
    return cv.shift_curve(d, wide, ["segment"], "delta", (Y0, Y1), STATES).drop("delta")


@query("e02_shift_curve", "WITH " + SHIFT_SQL + " SELECT vehicle, year, " + ", ".join(f"round({s}, 7) AS {s}" for s in STATES) + " FROM shifted")
def e02(spark, sf):
    return shifted(spark, sf).select("vehicle", "year", *[r(s, 7).alias(s) for s in STATES])


@query("e03_share_curves", "WITH " + ANCHORS_SQL + """, banded AS (SELECT segment, state, year, greatest(share - 0.03, 0) AS share_min, share AS share_mode, least(share + 0.05, 1) AS share_max FROM anchors), """
       + ", ".join(sql_curve("banded", "segment, state", "year", f"share_{b}", f"c_{b}") for b in ("min", "mode", "max"))
       + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS band, segment, state, year, round(share_{b} / greatest(sum(share_{b}) OVER (PARTITION BY segment, year), 1e-12::DOUBLE), 9) AS share FROM c_{b}" for b in ("min", "mode", "max")) + ")")
def e03(spark, sf):
    a = anchors(spark, sf)
    a = a.select("segment", "state", "year", F.greatest(F.col("share") - 0.03, F.lit(0.0)).alias("share_min"),
                 F.col("share").alias("share_mode"), F.least(F.col("share") + 0.05, F.lit(1.0)).alias("share_max"))
    out = None
    for b in ("min", "mode", "max"):
        c = cv.share_curves(a, ["segment"], "state", "year", f"share_{b}", Y0, Y1)
        c = c.select(F.lit(b).alias("band"), "segment", "state", "year", r("share", 9).alias("share"))
        out = c if out is None else out.unionByName(c)
    return out


PRESENCE_SQL = "presence(component, tier, cell) AS (VALUES " + ", ".join(
    "('%s', '%s', '%s')" % (row[0].replace("'", "''"), t, row[1 + i]) for row in lit.PRESENCE_PER_TIER for i, t in enumerate(lit.TIERS)) + ")"
LIDAR_SQL = """other AS (SELECT year, other FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS other FROM lineitem GROUP BY 1))"""


def presence(spark):
    df = spark.createDataFrame(lit.PRESENCE_PER_TIER, ["component", *lit.TIERS])
    return cv.presence_long(df, "component", lit.TIERS)


def other_driver(spark, sf):
    """A second driver's yearly share, found in lineitem."""
    return (table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year"))
            .agg(F.avg(F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)).alias("other")))


COMPOSED_SQL = SHARES_SQL + ", " + PRESENCE_SQL + ", " + LIDAR_SQL + """,
 filled AS (SELECT component, segment, s.year, share, CASE WHEN cell <> 'Driver B' THEN CAST(cell AS DOUBLE) WHEN tier = 'H3' THEN other ELSE greatest(other, 0.8::DOUBLE) END AS p
   FROM shares s JOIN presence ON tier = state LEFT JOIN other o ON o.year = s.year),
 composed AS (SELECT component, segment, year, least(greatest(sum(share * coalesce(p, 0)), 0), 1) AS presence FROM filled GROUP BY ALL)"""


def composed(spark, sf):
    return cv.compose_presence(shares(spark, sf).withColumnRenamed("state", "tier"), presence(spark), "component", ["segment"], other_driver(spark, sf))


@query("e04_compose_presence", "WITH " + SHARES_SQL + ", " + PRESENCE_SQL + """
SELECT component, segment, year, round(least(greatest(sum(share * CASE WHEN cell = 'Driver B' THEN 0.0::DOUBLE ELSE CAST(cell AS DOUBLE) END), 0), 1), 9) AS presence
FROM shares JOIN presence ON tier = state GROUP BY ALL""")
def e04(spark, sf):
    p = cv.compose_presence(shares(spark, sf).withColumnRenamed("state", "tier"), presence(spark), "component", ["segment"])
    return p.withColumn("presence", r("presence", 9))


@query("e05_substitute_marker", "WITH " + COMPOSED_SQL + " SELECT component, segment, year, round(presence, 9) AS presence FROM composed")
def e05(spark, sf):
    return composed(spark, sf).withColumn("presence", r("presence", 9))


SCEN_SQL = """scen_src AS (SELECT o_orderpriority AS scenario, CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
 scen AS (SELECT scenario, year, v / max(CASE WHEN year = 1998 THEN v END) OVER (PARTITION BY scenario) AS mult FROM scen_src), """


def scenario_multiplier(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v"))
    a = gw.index_to_base(a, ["scenario"], "year", "v", 1998, "mult")
    return cv.scenario_curve(a.filter("year >= 1998"), ["scenario"], "year", "mult", 1998, Y0, Y1)


@query("e06_scenario_curve", "WITH " + SCEN_SQL + " scen2 AS (SELECT * FROM scen WHERE year >= 1998), "
       + sql_curve("scen2", "scenario", "year", "mult", "curve", clip=False) +
       " SELECT scenario, year, CASE WHEN year <= 1998 THEN 1.0 ELSE round(greatest(mult, 0), 9) END AS mult FROM curve")
def e06(spark, sf):
    return scenario_multiplier(spark, sf).withColumn("mult", r("mult", 9))


@query("e07_saturating_growth", """
SELECT p_partkey, CAST(y AS INTEGER) AS year, round(greatest(h - (h - 1) * exp(-(y - 2025) / tau), 0), 7) + 0.0 AS growth
FROM (SELECT p_partkey, 0.5 + p_size / 25.0::DOUBLE AS h, 20 + p_size / 2.0::DOUBLE AS tau FROM part), range(2020, 2071, 5) t(y)""")
def e07(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.lit(0.5) + F.col("p_size") / 25.0).alias("h"), (F.lit(20) + F.col("p_size") / 2.0).alias("tau"),
                                        F.explode(F.sequence(F.lit(2020), F.lit(2070), F.lit(5))).alias("year"))
    return p.select("p_partkey", "year", r(dr.saturating_growth("h", "tau", "year"), 7).alias("growth"))


YEARLY_SQL = RANGES_SQL + ", yearly AS (SELECT segment, sensor_type, year, avg(mode) AS v FROM ranges GROUP BY ALL)"


def yearly(spark, sf):
    return ranges(spark, sf).groupBy("segment", "sensor_type", "year").agg(F.avg("mode").alias("v"))


@query("e08_index_to_base", "WITH " + YEARLY_SQL + """
SELECT segment, sensor_type, year, round(v / max(CASE WHEN year = 1997 THEN v END) OVER (PARTITION BY segment, sensor_type), 9) AS index FROM yearly""")
def e08(spark, sf):
    return gw.index_to_base(yearly(spark, sf), ["segment", "sensor_type"], "year", "v", 1997).select("segment", "sensor_type", "year", r("index", 9).alias("index"))


@query("e09_anchor_to_base", "WITH " + YEARLY_SQL + """,
 exp_ AS (SELECT segment, sensor_type, year, v / greatest(0.2::DOUBLE * 30 + 0.5::DOUBLE * 25 + 0.3::DOUBLE * 20, 1e-12::DOUBLE) AS expected FROM yearly),
 ens AS (SELECT segment, sensor_type, year, v * 100.0::DOUBLE / greatest(avg(CASE WHEN year = 1997 THEN v END) OVER (PARTITION BY segment), 1e-9::DOUBLE) AS ensemble FROM yearly),
 row_ AS (SELECT segment, sensor_type, year, v / greatest(max(CASE WHEN year = 1997 THEN v END) OVER (PARTITION BY segment, sensor_type), 1e-12::DOUBLE) AS per_row FROM yearly)
SELECT segment, sensor_type, year, round(expected, 9) AS expected, round(ensemble, 7) AS ensemble, round(per_row, 9) AS per_row
FROM exp_ JOIN ens USING (segment, sensor_type, year) JOIN row_ USING (segment, sensor_type, year)""")
def e09(spark, sf):
    y = yearly(spark, sf).withColumns({"expected": F.col("v"), "ensemble": F.col("v"), "per_row": F.col("v"), "target": F.lit(100.0)})
    y = y.withColumns({"s0": F.lit(0.2), "s1": F.lit(0.5), "s2": F.lit(0.3), "l0": F.lit(30.0), "l1": F.lit(25.0), "l2": F.lit(20.0)})
    y = cv.anchor_to_base(y, "expected", 1997, "expected", shares={"s0": "l0", "s1": "l1", "s2": "l2"})
    y = cv.anchor_to_base(y, "ensemble", 1997, "ensemble", ensemble=["segment"], target="target")
    y = cv.anchor_to_base(y, "per_row", 1997, "row", ensemble=["segment"], draw=["sensor_type"])
    return y.select("segment", "sensor_type", "year", r("expected", 9).alias("expected"), r("ensemble", 7).alias("ensemble"), r("per_row", 9).alias("per_row"))


@query("e10_pct_change", "WITH " + YEARLY_SQL + """,
 c AS (SELECT segment, sensor_type, max(CASE WHEN year = 1995 THEN v END) AS v0, max(CASE WHEN year = 2001 THEN v END) AS v1 FROM yearly GROUP BY ALL),
 y AS (SELECT segment, sensor_type, year, (v / lag(v) OVER (PARTITION BY segment, sensor_type ORDER BY year) - 1) * 100 AS yoy FROM yearly)
SELECT segment, sensor_type, year, round(yoy, 7) + 0.0 AS yoy_pct, round((v1 / v0 - 1) * 100, 7) + 0.0 AS change_pct FROM y JOIN c USING (segment, sensor_type)""")
def e10(spark, sf):
    y, key = yearly(spark, sf), ["segment", "sensor_type"]
    c = cv.pct_change(y, key, "year", "v", 1995, 2001).select(*key, "change_pct")
    return cv.year_on_year(y, key, "year", "v").join(c, key).select(*key, "year", r("yoy_pct", 7).alias("yoy_pct"), r("change_pct", 7).alias("change_pct"))


@query("e11_snapshots", "WITH " + CURVE_SQL + " SELECT segment, state, year, round(share, 9) AS share FROM curve WHERE year IN (1995, 1997, 2000, 2003)")
def e11(spark, sf):
    c = cv.monotone_curve(anchors(spark, sf), ["segment", "state"], "year", "share", Y0, Y1)
    return cv.snapshots(c, [1995, 1997, 2000, 2003]).withColumn("share", r("share", 9))


@query("e12_broadcast_year", "WITH " + RANGES_SQL + """,
 b AS (SELECT segment, domain, sum(mode) AS v FROM ranges WHERE domain <> 'PROMO' OR sensor_type <> 'Brand#1' GROUP BY ALL),
 d AS (SELECT segment, domain, year, sum(mode) AS v FROM ranges WHERE domain = 'PROMO' AND sensor_type = 'Brand#1' GROUP BY ALL)
SELECT b.segment, b.domain, CAST(y AS INTEGER) AS year, round(b.v + coalesce(d.v, 0), 4) AS v
FROM b CROSS JOIN range(1995, 2002) t(y) LEFT JOIN d ON d.segment = b.segment AND d.domain = b.domain AND d.year = y""")
def e12(spark, sf):
    x = ranges(spark, sf)
    driven = (F.col("domain") == "PROMO") & (F.col("sensor_type") == "Brand#1")
    base = x.filter(~driven).groupBy("segment", "domain").agg(F.sum("mode").alias("v"))
    delta = x.filter(driven).groupBy("segment", "domain", "year").agg(F.sum("mode").alias("v"))
    return cv.broadcast_year(base, delta, ["segment", "domain"], "v", 1995, 2001).withColumn("v", r("v", 4))
