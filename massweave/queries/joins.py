"""D: joins."""

from pyspark.sql import functions as F

from massweave.operators import groupwise as gw
from massweave.operators import joins as jn
from massweave.queries._base import RANGES_SQL, query, r, ranges, table


@query("d01_strict_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type, p_size FROM lineitem JOIN part ON l_partkey = p_partkey""")
def d01(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    return jn.strict_lookup(li, p, ["l_partkey"], ["p_type", "p_size"])


@query("d02_coverage", """
SELECT coalesce(o_orderkey, l_orderkey) AS key, CASE WHEN l_orderkey IS NULL THEN 'left' ELSE 'right' END AS only_in
FROM (SELECT DISTINCT o_orderkey FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey
WHERE o_orderkey IS NULL OR l_orderkey IS NULL""")
def d02(spark, sf):
    return jn.coverage(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")),
                       table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


STATS_SQL = RANGES_SQL + """, stats AS (SELECT segment, domain, avg(mode) AS mean, min(lo) AS lo, max(hi) AS hi FROM ranges GROUP BY ALL),
 yearly AS (SELECT segment, domain, year, sum(mode) AS total FROM ranges GROUP BY ALL),
 scale AS (SELECT segment, domain, year, total / max(CASE WHEN year = 1997 THEN total END) OVER (PARTITION BY segment, domain) AS scale FROM yearly)"""


def year_scale(spark, sf):
    y = ranges(spark, sf).groupBy("segment", "domain", "year").agg(F.sum("mode").alias("total"))
    return gw.index_to_base(y, ["segment", "domain"], "year", "total", 1997, "scale")


@query("d03_apply_year_scale", "WITH " + STATS_SQL + """
SELECT segment, domain, year, round(mean * scale, 6) AS mean, round(lo * scale, 6) AS lo, round(hi * scale, 6) AS hi, round(scale, 9) AS scale
FROM stats JOIN scale USING (segment, domain)""")
def d03(spark, sf):
    st = ranges(spark, sf).groupBy("segment", "domain").agg(F.avg("mode").alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = jn.apply_year_scale(st, year_scale(spark, sf), ["segment", "domain"], ["mean", "lo", "hi"])
    return out.select("segment", "domain", "year", r("mean").alias("mean"), r("lo").alias("lo"), r("hi").alias("hi"), r("scale", 9).alias("scale"))


@query("d04_compose", "WITH " + RANGES_SQL + """,
 counts AS (SELECT sensor_type, segment, year, avg(mode) AS mean, avg(lo) AS lo, avg(hi) AS hi FROM ranges GROUP BY ALL),
 comp AS (SELECT p_brand AS sensor_type, p_type AS element, avg(p_size) - 24 AS mg FROM part GROUP BY ALL)
SELECT sensor_type, segment, year, element, round(mean * mg, 9) AS mean, round(lo * mg, 9) AS lo, round(hi * mg, 9) AS hi
FROM counts JOIN comp USING (sensor_type) WHERE mg > 0""")
def d04(spark, sf):
    counts = ranges(spark, sf).groupBy("sensor_type", "segment", "year").agg(*[F.avg(a).alias(b) for a, b in (("mode", "mean"), ("lo", "lo"), ("hi", "hi"))])
    comp = table(spark, sf, "part").groupBy(F.col("p_brand").alias("sensor_type"), F.col("p_type").alias("element")).agg((F.avg("p_size") - 24).alias("mg"))
    out = jn.compose(counts, comp, ["sensor_type"], ["mean", "lo", "hi"], "mg")
    return out.select("sensor_type", "segment", "year", "element", *[r(c, 9).alias(c) for c in ("mean", "lo", "hi")])


@query("d05_strict_params", """
WITH p AS (SELECT p_brand, p_type, avg(p_size) AS m_mode FROM part GROUP BY ALL),
 q AS (SELECT p_brand, p_type, CAST(max(p_size) AS DOUBLE) AS m_max FROM part WHERE p_size < 20 AND p_type = 'PROMO' GROUP BY ALL)
SELECT p_partkey, round(m_mode, 6) AS m_mode, coalesce(m_max, 1e-9::DOUBLE) AS m_max
FROM part JOIN p USING (p_brand, p_type) LEFT JOIN q USING (p_brand, p_type)""")
def d05(spark, sf):
    p = table(spark, sf, "part")
    mode = p.groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("m_mode"))
    top = p.filter("p_size < 20 AND p_type = 'PROMO'").groupBy("p_brand", "p_type").agg(F.max("p_size").cast("double").alias("m_max"))
    key = ["p_brand", "p_type"]
    out = jn.lenient_params(jn.strict_lookup(p, mode, key, ["m_mode"]), top, key, {"m_max": 1e-9})
    return out.select("p_partkey", r("m_mode").alias("m_mode"), "m_max")


@query("d06_contains_lookup", """
WITH tok AS (SELECT split_part(split_part(url, '//', 2), '.', 1) AS token, min(page_id) AS first_page FROM pages GROUP BY 1),
 m AS (SELECT page_id, token, first_page, row_number() OVER (PARTITION BY page_id ORDER BY first_page, token) AS rn
       FROM pages JOIN tok ON contains(lower(url), lower(token)))
SELECT page_id, token, first_page FROM pages LEFT JOIN (SELECT * FROM m WHERE rn = 1) USING (page_id)""")
def d06(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    tok = p.groupBy(F.element_at(F.split(F.element_at(F.split("url", "//"), 2), r"\."), 1).alias("token")).agg(F.min("page_id").alias("first_page"))
    return jn.contains_lookup(p, "url", tok, "token", ["first_page", "token"], ["page_id"]).select("page_id", "token", "first_page")


# several brands of one type: the one whose number the part's name holds is taken
@query("d06_contains_narrowed", """
WITH tok AS (SELECT p_type AS token, p_brand AS brand, split_part(p_brand, '#', 2) AS num, min(p_size) AS size FROM part GROUP BY ALL),
 src AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS label FROM part),
 m AS (SELECT p_partkey, t.*, contains(label, '#' || num) AS ok, count(*) OVER (PARTITION BY p_partkey) AS n FROM src JOIN tok t ON contains(lower(label), lower(token)))
SELECT p_partkey, token, brand, size FROM m WHERE n = 1 OR ok QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY brand, token, num, size) = 1""")
def d06_narrowed(spark, sf):
    p = table(spark, sf, "part")
    tok = p.groupBy(F.col("p_type").alias("token"), F.col("p_brand").alias("brand"), F.element_at(F.split("p_brand", "#"), 2).alias("num")).agg(F.min("p_size").alias("size"))
    src = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("label"))
    t = jn.contains_lookup(src, "label", tok, "token", ["brand", "token"], ["p_partkey"], F.contains("label", F.concat(F.lit("#"), "num")), strict=True)
    return t.select("p_partkey", "token", "brand", "size")


@query("d07_attach_stats", """
WITH s AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY ALL),
 one AS (SELECT l_suppkey, arg_min(mean, l_returnflag) AS m, arg_min(std, l_returnflag) AS u FROM s WHERE l_suppkey % 7 <> 0 GROUP BY 1)
SELECT s_suppkey, coalesce(printf('%.4f', m), 'N/A') AS value, coalesce(printf('%.4f', 2 * u), 'N/A') AS uncertainty
FROM supplier LEFT JOIN one ON s_suppkey = l_suppkey""")
def d07(spark, sf):
    # suppliers whose key divides by 7 have no statistics row, so that N/A shows
    st = (table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
          .agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std")).filter("s_suppkey % 7 <> 0"))
    out = jn.attach_stats(table(spark, sf, "supplier"), st, ["s_suppkey"], ["l_returnflag"])
    return out.select("s_suppkey", "value", "uncertainty")


@query("d08_period_delta", "WITH " + RANGES_SQL + """
SELECT segment, domain, sensor_type, round(sum(CASE WHEN year = 1995 THEN mode ELSE 0 END), 4) AS value_a,
  round(sum(CASE WHEN year = 2001 THEN mode ELSE 0 END), 4) AS value_b,
  round(sum(CASE WHEN year = 2001 THEN mode ELSE 0 END) - sum(CASE WHEN year = 1995 THEN mode ELSE 0 END), 4) AS delta
FROM ranges WHERE year IN (1995, 2001) GROUP BY ALL""")
def d08(spark, sf):
    d = jn.period_delta(ranges(spark, sf), ["segment", "domain", "sensor_type"], "year", "mode", 1995, 2001)
    return d.select("segment", "domain", "sensor_type", *[r(c, 4).alias(c) for c in ("value_a", "value_b", "delta")])


@query("d09_expand_draws", """
SELECT p_type, p_brand, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size * (draw + 1)) AS BIGINT) AS checksum, CAST(max(draw) AS INTEGER) AS last_draw
FROM part, range(100) t(draw) GROUP BY ALL""")
def d09(spark, sf):
    return (jn.expand_draws(table(spark, sf, "part"), 100, block=32).groupBy("p_type", "p_brand")
            .agg(F.count("*").alias("n"), F.sum(F.col("p_size") * (F.col("draw") + 1)).alias("checksum"), F.max("draw").cast("int").alias("last_draw")))


@query("d10_bracket_join", """
WITH a AS (SELECT o_orderpriority AS key, CAST(year(o_orderdate) AS INTEGER) AS yr, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
 iv AS (SELECT key, CAST(yr AS DOUBLE) AS x_lo, CAST(coalesce(lead(yr) OVER w, yr) AS DOUBLE) AS x_hi, v AS v_lo, coalesce(lead(v) OVER w, v) AS v_hi,
   lead(yr) OVER w IS NULL AS last FROM a WINDOW w AS (PARTITION BY key ORDER BY yr)),
 p AS (SELECT o_orderkey, o_orderpriority AS key, 1993 + (o_orderkey % 110) / 10.0::DOUBLE AS x FROM orders),
 e AS (SELECT key, min(yr) AS x0, max(yr) AS x1 FROM a GROUP BY 1)
SELECT o_orderkey, x, x_lo, x_hi, round(v_lo, 4) AS v_lo, round(v_hi, 4) AS v_hi
FROM p JOIN e USING (key) JOIN iv USING (key)
WHERE least(greatest(x, x0), x1) >= x_lo AND (least(greatest(x, x0), x1) < x_hi OR last)""")
def d10(spark, sf):
    o = table(spark, sf, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("key"), F.year("o_orderdate").alias("yr")).agg(F.avg("o_totalprice").alias("v"))
    p = o.select("o_orderkey", F.col("o_orderpriority").alias("key"), (F.lit(1993) + (F.col("o_orderkey") % 110) / F.lit(10.0)).alias("x"))
    out = jn.bracket_join(p, a, ["key"], "x", "yr", ["v"], step=1.0)
    return out.select("o_orderkey", "x", "x_lo", "x_hi", r("v_lo", 4).alias("v_lo"), r("v_hi", 4).alias("v_hi"))


@query("d11_overlaps", """
WITH a AS (SELECT l_suppkey AS key, min(l_quantity) + 20 AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
 b AS (SELECT s_suppkey AS key, s_acctbal / 1000 AS lo, s_acctbal / 1000 + 18 AS hi FROM supplier)
SELECT key, a.lo AS lo_a, a.hi AS hi_a, b.lo AS lo_b, b.hi AS hi_b, NOT (a.hi < b.lo OR b.hi < a.lo) AS overlap FROM a JOIN b USING (key)""")
def d11(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg((F.min("l_quantity") + 20).alias("lo"), F.max("l_quantity").alias("hi"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 1000).alias("lo"), (F.col("s_acctbal") / 1000 + 18).alias("hi"))
    return jn.overlaps(a, b, ["key"])


@query("d12_max_abs_diff", """
WITH a AS (SELECT l_suppkey AS key, l_returnflag AS flag, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
 b AS (SELECT l_suppkey AS key, l_returnflag AS flag, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING l_suppkey % 9 <> 0)
SELECT flag, round(max(abs(a.v - b.v)), 6) AS max_abs_diff, CAST(sum(CASE WHEN a.v IS NULL OR b.v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched, count(*) AS n_keys
FROM a FULL JOIN b USING (key, flag) GROUP BY flag""")
def d12(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("flag"), "l_quantity", "l_linestatus")
    a = li.groupBy("key", "flag").agg(F.avg("l_quantity").alias("v"))
    b = li.filter("l_linestatus = 'O' AND key % 9 <> 0").groupBy("key", "flag").agg(F.avg("l_quantity").alias("v"))
    return jn.max_abs_diff(a, b, ["key", "flag"], "v", ["flag"]).withColumn("max_abs_diff", r("max_abs_diff"))


@query("d13_with_base", "WITH " + RANGES_SQL + """, y AS (SELECT segment, domain, year, avg(mode) AS v FROM ranges GROUP BY ALL)
SELECT segment, domain, year, round(v, 6) AS v, round(max(CASE WHEN year = 1997 THEN v END) OVER (PARTITION BY segment, domain), 6) AS base FROM y""")
def d13(spark, sf):
    y = ranges(spark, sf).groupBy("segment", "domain", "year").agg(F.avg("mode").alias("v"))
    return gw.at_base(y, ["segment", "domain"], "year", "v", 1997).select("segment", "domain", "year", r("v").alias("v"), r("base").alias("base"))
