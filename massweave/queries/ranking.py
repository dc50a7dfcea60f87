"""H and I: sorting, top-k, set operations."""

from pyspark.sql import functions as F

from massweave.operators import joins as jn
from massweave.operators import ranking as rk
from massweave.operators import sets as ss
from massweave.queries._base import RANGES_SQL, query, r, ranges, table

DELTA_SQL = RANGES_SQL + """, delta AS (SELECT segment, domain, sensor_type, round(sum(CASE WHEN year = 2000 THEN mode ELSE 0 END) - sum(CASE WHEN year = 1995 THEN mode ELSE 0 END), 4) AS delta FROM ranges GROUP BY ALL)"""


def deltas(spark, sf):
    d = jn.period_delta(ranges(spark, sf), ["segment", "domain", "sensor_type"], "year", "mode", 1995, 2000)
    return d.select("segment", "domain", "sensor_type", r("delta", 4).alias("delta"))


@query("h01_top_k", """
SELECT l_suppkey, round(v, 6) AS v FROM (SELECT l_suppkey, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE avg(l_extendedprice) END AS v FROM lineitem GROUP BY 1)
ORDER BY v DESC NULLS LAST, l_suppkey LIMIT 10""")
def h01(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("v"))
    v = v.withColumn("v", F.when(F.col("l_suppkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return rk.top_k(v, "v", 10, ["l_suppkey"]).withColumn("v", r("v"))


@query("h02_top_k_per", """
SELECT p_type, p_brand, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank
  FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)) WHERE rank <= 3""")
def h02(spark, sf):
    n = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return rk.top_k_per(n, ["p_type"], "n", 3, ["p_brand"])


@query("h03_top_changes", "WITH " + DELTA_SQL + " SELECT * FROM delta ORDER BY abs(delta) DESC, segment, domain, sensor_type LIMIT 16")
def h03(spark, sf):
    return rk.top_changes(deltas(spark, sf), "delta", 16, ["segment", "domain", "sensor_type"])


@query("h04_movers", "WITH " + DELTA_SQL + """
SELECT * FROM (SELECT *, 'bottom' AS side FROM delta ORDER BY delta, segment, domain, sensor_type LIMIT 3) UNION ALL SELECT * FROM (SELECT *, 'top' FROM delta ORDER BY delta DESC, segment, domain, sensor_type LIMIT 3)""")
def h04(spark, sf):
    return rk.movers(deltas(spark, sf), "delta", 3, ["segment", "domain", "sensor_type"])


@query("h05_keep_top", """
SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 5)""")
def h05(spark, sf):
    return rk.keep_top(table(spark, sf, "part"), "p_brand", "p_retailprice", 5).select("p_partkey", "p_brand")


@query("h06_sort_by", "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY p_type, n DESC, p_brand")
def h06(spark, sf):
    n = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return rk.sort_by(n, [("p_type", True), ("n", False), ("p_brand", True)])


@query("i01_union_tagged", """
SELECT 'customer' AS domain, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS kind FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal, NULL FROM supplier""")
def i01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("kind"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return ss.union_tagged({"customer": c, "supplier": s})


@query("i02_append_rows", """
WITH d AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)
SELECT * FROM d UNION ALL SELECT priority, 'all', CAST(sum(n) AS BIGINT) FROM d GROUP BY 1""")
def i02(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return ss.append_rows(d, d.groupBy("priority").agg(F.sum("n").alias("n")).withColumn("status", F.lit("all")))


@query("i03_key_difference", "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def i03(spark, sf):
    return ss.key_difference(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


@query("i04_key_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def i04(spark, sf):
    return ss.key_intersection(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("i05_distinct_sorted", "SELECT DISTINCT p_brand FROM part ORDER BY 1")
def i05(spark, sf):
    return ss.distinct_sorted(table(spark, sf, "part"), "p_brand")
