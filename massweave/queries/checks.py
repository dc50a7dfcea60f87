"""J: reconciliation checks. A row that is not ok is a finding about the data, not a failure of the query."""

from pyspark.sql import functions as F

from massweave.functions import text as tx
from massweave.operators import checks as ck
from massweave.operators import curves as cv
from massweave.operators import histogram as hg
from massweave.operators import reshape as rs
from massweave.operators import stats as st
from massweave.queries import curves as qc
from massweave.queries import stats as qs
from massweave.queries import tables as qt
from massweave.queries._base import COMPONENTS_SQL, RANGES_SQL, STATES, components, query, r, ranges, table

YM = RANGES_SQL + ", ym AS (SELECT segment, year, avg(mode) AS v FROM ranges GROUP BY ALL), sm AS (SELECT segment, avg(mode) AS v FROM ranges GROUP BY ALL)"


def ym(spark, sf):
    return ranges(spark, sf).groupBy("segment", "year").agg(F.avg("mode").alias("v"))


def sm(spark, sf):
    return ranges(spark, sf).groupBy("segment").agg(F.avg("mode").alias("v"))


def rounded(df, n=8):
    return df.withColumns({"got": r("got", n), "want": r("want", n)})


@query("j01_tolerance", "WITH " + YM + " SELECT 'J01' AS check_id, segment, year, round(ym.v, 8) AS got, round(sm.v, 8) AS want, 0.03::DOUBLE AS tol, abs(ym.v - sm.v) / abs(sm.v) <= 0.03 AS ok FROM ym JOIN sm USING (segment)")
def j01(spark, sf):
    years = ym(spark, sf)
    want = years.select("segment", "year").join(sm(spark, sf), "segment").withColumnRenamed("v", "want")
    return rounded(ck.within(years.withColumnRenamed("v", "got"), want, ["segment", "year"], 0.03, True, "J01"))


@query("j02_sums_to_one", "WITH " + qc.SHARES_SQL + " SELECT 'J02' AS check_id, segment, year, round(sum(share), 8) AS got, 1.0::DOUBLE AS want, 1e-9::DOUBLE AS tol, abs(sum(share) - 1) <= 1e-9 AS ok FROM shares GROUP BY ALL")
def j02(spark, sf):
    return rounded(ck.sums_to_one(qc.shares(spark, sf), ["segment", "year"], "share"))


@query("j03_pinned_at", "WITH " + qc.SCEN_SQL + " scen2 AS (SELECT * FROM scen WHERE year >= 1998), " + qc.sql_curve("scen2", "scenario", "year", "mult", "curve", clip=False)
       + ", d AS (SELECT scenario, max(abs(greatest(mult, 0) - 1)) AS d FROM curve WHERE year = 1998 GROUP BY scenario) SELECT 'J03' AS check_id, scenario, round(d, 8) AS got, 0.0::DOUBLE AS want, 1e-9::DOUBLE AS tol, d <= 1e-9 AS ok FROM d")
def j03(spark, sf):
    return rounded(ck.pinned_at(qc.scenario_multiplier(spark, sf), ["scenario"], 1998, "mult", 1.0))


J04 = RANGES_SQL + ", b AS (SELECT segment, domain, avg((lo + hi) / 2) AS basis, avg(l_linenumber) / 7 AS share, 1 + avg(p_size) / 100 AS uplift, avg(hi) * 1.1 AS recorded FROM ranges GROUP BY ALL), c AS (SELECT *, basis * (1 + share * (uplift - 1)) AS got, domain = 'PROMO' AS asserted FROM b)"


@query("j04_round_trip", "WITH " + J04 + " SELECT 'J04' AS check_id, segment, domain, asserted, round(got, 8) AS got, round(recorded, 8) AS want, 0.05::DOUBLE AS tol, abs(got / recorded - 1) <= 0.05 OR NOT asserted AS ok FROM c")
def j04(spark, sf):
    b = ranges(spark, sf).groupBy("segment", "domain").agg(F.avg((F.col("lo") + F.col("hi")) / 2).alias("basis"), (F.avg("l_linenumber") / 7).alias("share"),
                                                           (1 + F.avg("p_size") / 100).alias("uplift"), (F.avg("hi") * 1.1).alias("recorded"))
    return rounded(ck.round_trip(b, ["segment", "domain"], "basis", "share", "uplift", "recorded", F.col("domain") == "PROMO"))


_AT = f"least(w.year - {qc.Y0}, {qc.Y1 - qc.Y0 - 1})"
_F = f"(w.year - {qc.Y0} - {_AT})"
J05 = (qc.WIDE_SQL + f", moved AS (SELECT w.segment, w.year, " + ", ".join(f"greatest(n.{s} * (1 - {_F}) + n.{s}_next * {_F}, 0) AS {s}" for s in STATES)
       + f" FROM wide2 w JOIN wide2 n ON n.segment = w.segment AND n.year = {qc.Y0} + {_AT}), d AS (SELECT max(greatest("
       + ", ".join(f"abs(m.{s} / greatest({' + '.join('m.' + x for x in STATES)}, 1e-12::DOUBLE) - w.{s})" for s in STATES)
       + ")) AS d FROM moved m JOIN wide w ON w.segment = m.segment AND w.year = m.year)")


@query("j05_same_curve", "WITH " + J05 + " SELECT 'J05' AS check_id, round(d, 8) AS got, 0.0::DOUBLE AS want, 1e-12::DOUBLE AS tol, d <= 1e-12 AS ok FROM d")
def j05(spark, sf):
    """Two consumers of the curve: the share reader, and the shifted curve read without a shift."""
    a = qc.shares(spark, sf)
    wide = cv.wide_curve(a, ["segment"], "state", "share", STATES)
    still = wide.select("segment", "year", F.lit(0.0).alias("delta"))
    moved = cv.shift_curve(still, wide, ["segment"], "delta", (qc.Y0, qc.Y1), STATES)
    b = moved.unpivot(["segment", "year"], STATES, "state", "share")
    return rounded(ck.same_curve(a, b, ["segment", "state", "year"], "share"))


J06 = qc.COMPOSED_SQL + ", " + COMPONENTS_SQL + ", lb AS (SELECT domain, avg(CASE label_ab WHEN 'Std' THEN 1.0 WHEN 'Opt' THEN 0.5 WHEN 'Rare' THEN 0.25 ELSE 0.0 END) AS label FROM components WHERE domain = 'PROMO' GROUP BY 1), x AS (SELECT component, segment, presence, label, CASE WHEN presence >= 0.75 THEN 1.0 WHEN presence >= 0.375 THEN 0.5 WHEN presence >= 0.125 THEN 0.25 ELSE 0.0 END AS lv FROM composed, lb WHERE year = 1997)"


@query("j06_against_label", "WITH " + J06 + " SELECT 'J06' AS check_id, component, segment, abs(presence - lv) > 0.15 AS exempt, round(presence, 8) AS got, round(label, 8) AS want, 0.15::DOUBLE AS tol, abs(presence - label) <= 0.15 OR abs(presence - lv) > 0.15 AS ok FROM x")
def j06(spark, sf):
    lb = components(spark, sf).filter("domain = 'PROMO'").agg(F.avg(tx.factor_lenient("label_ab")).alias("label"))        # one row
    c = qc.composed(spark, sf).filter("year = 1997").crossJoin(F.broadcast(lb))
    return rounded(ck.against_label(c, ["component", "segment"], "presence", "label"))


J07M = ["p025", "p50", "p975"]
J07 = qs.H_SQL + ", " + qs.pct_sql("h", "segment, name", {"p025": 2.5, "p50": 50, "p975": 97.5}) + ", ex AS (SELECT segment, name, quantile_cont(v, 0.025) AS p025, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.975) AS p975 FROM prices GROUP BY ALL), l AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, segment, name, p.{m} AS got, ex.{m} AS want FROM p JOIN ex USING (segment, name)" for m in J07M) + "), w AS (SELECT metric, arg_max(segment, (round(abs(got - want) / abs(want), 12), segment, name)) AS segment, arg_max(name, (round(abs(got - want) / abs(want), 12), segment, name)) AS name, arg_max(got, (round(abs(got - want) / abs(want), 12), segment, name)) AS got, arg_max(want, (round(abs(got - want) / abs(want), 12), segment, name)) AS want FROM l WHERE abs(want) > 1 GROUP BY 1)"


@query("j07_binned_against_exact", "WITH " + J07 + " SELECT 'J07' AS check_id, metric, segment, name, round(got, 6) AS got, round(want, 6) AS want, 0.03::DOUBLE AS tol, abs(got - want) / abs(want) <= 0.03 AS ok FROM w")
def j07(spark, sf):
    qn = {"p025": 2.5, "p50": 50, "p975": 97.5}
    binned = hg.percentiles_wide(qs.fine_hist(spark, sf), qs.KEY, qn)
    exact = st.exact_percentiles(qs.prices(spark, sf), qs.KEY, "v", qn)
    return rounded(ck.binned_against_exact(binned, exact, qs.KEY, J07M), 6)


@query("j08_ranges_overlap", "WITH " + RANGES_SQL + """, a AS (SELECT segment, sensor_type, avg(lo) AS lo, avg(hi) AS hi FROM ranges WHERE domain = 'PROMO' GROUP BY ALL), b AS (SELECT segment, sensor_type, avg(lo) AS lo, avg(hi) AS hi FROM ranges WHERE domain = 'LARGE' GROUP BY ALL)
SELECT 'J08' AS check_id, segment, sensor_type, round(least(a.hi, b.hi) - greatest(a.lo, b.lo), 8) + 0.0 AS got, 0.0::DOUBLE AS want, 0.0::DOUBLE AS tol, NOT (a.hi < b.lo OR b.hi < a.lo) AS ok FROM a JOIN b USING (segment, sensor_type)""")
def j08(spark, sf):
    x = ranges(spark, sf)
    side = lambda d: x.filter(F.col("domain") == d).groupBy("segment", "sensor_type").agg(F.avg("lo").alias("lo"), F.avg("hi").alias("hi"))
    return rounded(ck.ranges_overlap(side("PROMO"), side("LARGE"), ["segment", "sensor_type"]))


@query("j09_base_year", "WITH " + YM + " SELECT 'J09' AS check_id, segment, round(ym.v, 8) AS got, round(sm.v, 8) AS want, 0.03::DOUBLE AS tol, abs(ym.v - sm.v) / abs(sm.v) <= 0.03 AS ok FROM ym JOIN sm USING (segment) WHERE year = 1997")
def j09(spark, sf):
    return rounded(ck.base_year(ym(spark, sf), sm(spark, sf), ["segment"], "v", 1997))


@query("j10_ordering", "WITH " + YM + " SELECT 'J10' AS check_id, year, round(max(CASE WHEN segment = 'AB' THEN v END), 8) AS got, round(max(CASE WHEN segment = 'EF' THEN v END), 8) AS want, 0.0::DOUBLE AS tol, max(CASE WHEN segment = 'AB' THEN v END) < max(CASE WHEN segment = 'EF' THEN v END) AS ok FROM ym GROUP BY year")
def j10(spark, sf):
    return rounded(ck.ordering(ym(spark, sf), ["year"], "segment", "AB", "EF", "v"))


@query("j11_rate_in_band", "WITH " + YM + ", x AS (SELECT segment, (max(CASE WHEN year = 1998 THEN v END) / max(CASE WHEN year = 1997 THEN v END) - 1) * 100 AS pct FROM ym GROUP BY 1) SELECT 'J11' AS check_id, segment, round(pct, 8) + 0.0 AS got, 1.0::DOUBLE AS want, 0.5::DOUBLE AS tol, pct BETWEEN -0.5 AND 2.5 AS ok FROM x")
def j11(spark, sf):
    return rounded(ck.rate_in_band(ym(spark, sf), ["segment"], "v", 1997, 0.0, 2.0))


@query("j12_share_within", "WITH " + RANGES_SQL + ", x AS (SELECT segment, 100.0::DOUBLE * sum(CASE WHEN domain = 'PROMO' AND p_size <= 12 THEN mode ELSE 0 END) / sum(mode) AS pct FROM ranges GROUP BY 1) SELECT 'J12' AS check_id, segment, round(pct, 8) AS got, 3.9::DOUBLE AS want, 1.0::DOUBLE AS tol, abs(pct - 3.9) <= 1 AS ok FROM x")
def j12(spark, sf):
    return rounded(ck.share_within(ranges(spark, sf), ["segment"], (F.col("domain") == "PROMO") & (F.col("p_size") <= 12), "mode", 3.9, 1.0))


@query("j13_weighted_mean", "WITH " + qt.TIER_SQL + ", x AS (SELECT year, sum((H0 * 1.0::DOUBLE + H1 * 2.0::DOUBLE + H2 * 4.0::DOUBLE + H3 * 5.3::DOUBLE + H4 * 7.0::DOUBLE) * w) / sum(w) AS m FROM (SELECT *, CASE segment WHEN 'AB' THEN 30.0::DOUBLE WHEN 'CD' THEN 50.0::DOUBLE ELSE 20.0::DOUBLE END AS w FROM tw) GROUP BY year) SELECT 'J13' AS check_id, year, round(m, 8) AS got, 3.0::DOUBLE AS want, 1.0::DOUBLE AS tol, abs(m - 3) <= 1 AS ok FROM x")
def j13(spark, sf):
    from massweave.plans.tables import build_tier_table
    t = build_tier_table(qc.shares(spark, sf).withColumnRenamed("state", "tier"))
    t = t.withColumn("w", F.when(F.col("segment") == "AB", 30.0).when(F.col("segment") == "CD", 50.0).otherwise(20.0))
    return rounded(ck.weighted_mean(t, ["year"], "ranging_derived", "w", 3.0, 1.0))


@query("j14_ratio_class", """WITH a AS (SELECT 'G' || n_regionkey AS grp, sum(c_acctbal) AS got FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), b AS (SELECT 'G' || n_regionkey AS grp, sum(s_acctbal) AS want FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
 x AS (SELECT *, greatest(got / want, want / got) AS ratio FROM a JOIN b USING (grp))
SELECT 'J14' AS check_id, grp, CASE WHEN ratio <= 1.03 THEN 'noise' WHEN ratio <= 1.6 THEN 'normal' WHEN ratio <= 4 THEN 'structural' WHEN ratio <= 10 THEN 'wide' ELSE 'error' END AS class, round(got, 2) AS got, round(want, 2) AS want, 10.0::DOUBLE AS tol, ratio <= 10 AS ok FROM x""")
def j14(spark, sf):
    n = table(spark, sf, "nation")
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    a = c.join(n, c.c_nationkey == n.n_nationkey).withColumnRenamed("c_acctbal", "v")
    b = s.join(n, s.s_nationkey == n.n_nationkey).withColumnRenamed("s_acctbal", "v")
    grp = F.concat(F.lit("G"), F.col("n_regionkey"))
    return rounded(ck.ratio_class(a, b, grp, grp, "v"), 2)


@query("j15_ratio_target", """WITH a AS (SELECT l_suppkey AS key, sum(l_extendedprice) AS m FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey AS key, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT 'J15' AS check_id, key, round(m / q, 7) AS got, 2050.0::DOUBLE AS want, 0.15::DOUBLE AS tol, abs(m / q - 2050) / 2050 <= 0.15 AS ok FROM a JOIN b USING (key)""")
def j15(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "key")
    a, b = li.groupBy("key").agg(F.sum("l_extendedprice").alias("m")), li.groupBy("key").agg(F.sum("l_quantity").alias("q"))
    return rounded(ck.ratio_target(a, b, ["key"], "m", "q", F.lit(2050.0)), 7)


@query("j16_compound_growth", "WITH " + RANGES_SQL + ", y AS (SELECT segment, domain, year, avg(value) AS v FROM ranges GROUP BY ALL), x AS (SELECT segment, domain, pow(max(CASE WHEN year = 2000 THEN v END) / max(CASE WHEN year = 1995 THEN v END), 0.2::DOUBLE) - 1 AS g FROM y GROUP BY ALL) SELECT 'J16' AS check_id, segment, domain, round(g, 9) + 0.0 AS got, 0.0::DOUBLE AS want, 0.01::DOUBLE AS tol, abs(g) <= 0.01 AS ok FROM x")
def j16(spark, sf):
    y = ranges(spark, sf).groupBy("segment", "domain", "year").agg(F.avg("value").alias("v"))
    return rounded(ck.compound_growth(y, ["segment", "domain"], "v", 1995, 2000, 0.0, 0.01), 9)
