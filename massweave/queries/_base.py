"""Query registry and the column bindings from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n: int = 6):
    """Round a measure for the value comparison; never leaves a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n) + F.lit(0.0)


# ---- oracle-side counterparts of functions.draws --------------------------------
P31 = 2147483647


def sql_md5(seed: int, var: str, *keys: str) -> str:
    return "md5(concat_ws('|', '%d|%s', %s))" % (
        seed, var, ", ".join(f"CAST({k} AS VARCHAR)" for k in keys))


def sql_keyed(seed: int, var: str, *keys: str) -> str:
    return f"((('0x' || substr({sql_md5(seed, var, *keys)}, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def sql_at(digest: str, draw: str = "draw") -> str:
    def c(i):
        return f"(('0x' || substr({digest}, {1 + 8 * i}, 8))::BIGINT % {P31})"
    x = f"({draw} + 1)"
    h = c(3)
    for i in (2, 1, 0):
        h = f"(({h} * {x} + {c(i)}) % {P31})"
    return f"(({h} + 0.5::DOUBLE) / {P31}.0::DOUBLE)"


def sql_uni(u: str, lo: str, hi: str) -> str:
    return f"({lo} + {u} * ({hi} - {lo}))"


def sql_tri(u: str, lo: str, mode: str, hi: str) -> str:
    """Bounds must already be ordered."""
    return (f"(CASE WHEN ({hi}) - ({lo}) <= 0 THEN ({lo}) "
            f"WHEN {u} * (({hi}) - ({lo})) < ({mode}) - ({lo}) "
            f"THEN ({lo}) + sqrt({u} * (({hi}) - ({lo})) * (({mode}) - ({lo}))) "
            f"ELSE ({hi}) - sqrt((1.0::DOUBLE - {u}) * (({hi}) - ({lo})) * (({hi}) - ({mode}))) END)")


def sql_norm(u1: str, u2: str, mu: str, sd: str) -> str:
    return f"({mu} + {sd} * (sqrt(-2.0::DOUBLE * ln({u1})) * cos(6.283185307179586::DOUBLE * {u2})))"


# ---- bindings -------------------------------------------------------------------
# part plays the component list: type = domain, name = component, and the size
# drives the presence labels and the min / max counts.
COMPONENTS_SQL = """components AS (
  SELECT p_partkey AS comp_id, p_type AS domain, p_name AS component, p_brand AS brand, p_size,
    CASE p_size % 5 WHEN 0 THEN 'Std' WHEN 1 THEN 'Opt' WHEN 2 THEN 'Rare' WHEN 3 THEN '-' ELSE '–' END AS label_ab,
    CASE (p_size // 5) % 5 WHEN 0 THEN 'Std' WHEN 1 THEN 'Opt' WHEN 2 THEN 'Rare' WHEN 3 THEN '-' ELSE 'Std' END AS label_cd,
    CASE (p_size // 10) % 4 WHEN 0 THEN 'Opt' WHEN 1 THEN 'Rare' ELSE 'Std' END AS label_ef,
    CAST(p_size % 3 AS DOUBLE) AS small_min,
    CASE WHEN p_size % 17 = 0 THEN NULL ELSE CAST(p_size % 3 + p_size % 4 AS DOUBLE) END AS small_max,
    CAST((p_size // 6) % 3 AS DOUBLE) AS medium_min, CAST((p_size // 6) % 3 + 1 + p_size % 2 AS DOUBLE) AS medium_max,
    CAST((p_size // 12) % 2 AS DOUBLE) AS large_min, CAST((p_size // 12) % 2 + p_size % 5 AS DOUBLE) AS large_max,
    CAST(CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size % 4 END AS DOUBLE) AS step_min,
    CAST(CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size % 4 + 2 END AS DOUBLE) AS step_max,
    CAST((p_size % 9) // 6 AS DOUBLE) AS dcs_min, CAST((p_size % 9) // 4 AS DOUBLE) AS dcs_max,
    CAST((p_size % 11) // 8 AS DOUBLE) AS dcm_min, CAST((p_size % 11) // 5 AS DOUBLE) AS dcm_max,
    CAST(p_size % 2 AS DOUBLE) AS ab_min, CAST(p_size % 2 + 1 AS DOUBLE) AS ab_max,
    CAST(p_size % 3 AS DOUBLE) AS cd_min, CAST(p_size % 3 + 2 AS DOUBLE) AS cd_max,
    CAST(p_size % 5 AS DOUBLE) AS ef_min, CAST(p_size % 5 + 3 AS DOUBLE) AS ef_max
  FROM part)"""


def components(spark: SparkSession, sf: str) -> DataFrame:
    s = "p_size"
    d = lambda e: F.expr(e).cast("double")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("comp_id"), F.col("p_type").alias("domain"),
        F.col("p_name").alias("component"), F.col("p_brand").alias("brand"), F.col(s),
        F.expr("CASE p_size % 5 WHEN 0 THEN 'Std' WHEN 1 THEN 'Opt' WHEN 2 THEN 'Rare' WHEN 3 THEN '-' ELSE '–' END").alias("label_ab"),
        F.expr("CASE (p_size div 5) % 5 WHEN 0 THEN 'Std' WHEN 1 THEN 'Opt' WHEN 2 THEN 'Rare' WHEN 3 THEN '-' ELSE 'Std' END").alias("label_cd"),
        F.expr("CASE (p_size div 10) % 4 WHEN 0 THEN 'Opt' WHEN 1 THEN 'Rare' ELSE 'Std' END").alias("label_ef"),
        d("p_size % 3").alias("small_min"),
        F.expr("CASE WHEN p_size % 17 = 0 THEN NULL ELSE CAST(p_size % 3 + p_size % 4 AS DOUBLE) END").alias("small_max"),
        d("(p_size div 6) % 3").alias("medium_min"), d("(p_size div 6) % 3 + 1 + p_size % 2").alias("medium_max"),
        d("(p_size div 12) % 2").alias("large_min"), d("(p_size div 12) % 2 + p_size % 5").alias("large_max"),
        d("CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size % 4 END").alias("step_min"),
        d("CASE WHEN p_size % 7 = 0 THEN -1 ELSE p_size % 4 + 2 END").alias("step_max"),
        d("(p_size % 9) div 6").alias("dcs_min"), d("(p_size % 9) div 4").alias("dcs_max"),
        d("(p_size % 11) div 8").alias("dcm_min"), d("(p_size % 11) div 5").alias("dcm_max"),
        d("p_size % 2").alias("ab_min"), d("p_size % 2 + 1").alias("ab_max"),
        d("p_size % 3").alias("cd_min"), d("p_size % 3 + 2").alias("cd_max"),
        d("p_size % 5").alias("ef_min"), d("p_size % 5 + 3").alias("ef_max"),
    )


# lineitem joined to part plays the component rows of a segment: return flag =
# segment, part type = domain, brand = sensor type, and the discounted and the
# taxed quantity bound the count.
RANGES_SQL = """ranges AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'AB' WHEN 'N' THEN 'CD' ELSE 'EF' END AS segment,
    p_type AS domain, p_brand AS sensor_type, l_partkey AS comp_id,
    l_orderkey, l_linenumber, l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year,
    l_quantity * (1 - l_discount) AS lo, l_quantity AS mode, l_quantity * (1 + l_tax) AS hi,
    p_size, l_extendedprice AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.expr("CASE l_returnflag WHEN 'A' THEN 'AB' WHEN 'N' THEN 'CD' ELSE 'EF' END").alias("segment"),
        F.col("p_type").alias("domain"), F.col("p_brand").alias("sensor_type"),
        F.col("l_partkey").alias("comp_id"), "l_orderkey", "l_linenumber", "l_suppkey",
        F.year("l_shipdate").alias("year"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("lo"),
        F.col("l_quantity").alias("mode"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("hi"),
        "p_size", F.col("l_extendedprice").alias("value"))


SEG_SQL = "CASE l_returnflag WHEN 'A' THEN 'AB' WHEN 'N' THEN 'CD' ELSE 'EF' END"


def segment_col():
    return F.expr(SEG_SQL)


# Yearly shares per segment: the anchors of an adoption curve. States are the
# order priorities, the segment is the customer's region group.
ANCHORS_SQL = """anchors AS (
  SELECT segment, state, year, n / sum(n) OVER (PARTITION BY segment, year) AS share FROM (
    SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD'
             WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END AS segment,
      'H' || CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS VARCHAR) AS state,
      CAST(year(o_orderdate) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""

STATES = ["H0", "H1", "H2", "H3", "H4"]


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window as W
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    n = (o.join(c, o.o_custkey == c.c_custkey)
         .groupBy(
             F.expr("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' "
                    "WHEN 'FURNITURE' THEN 'CD' WHEN 'HOUSEHOLD' THEN 'CD' ELSE 'EF' END").alias("segment"),
             F.expr("concat('H', cast(cast(substr(o_orderpriority, 1, 1) AS INT) - 1 AS STRING))").alias("state"),
             F.year("o_orderdate").alias("year"))
         .agg(F.count("*").cast("double").alias("n")))
    return n.select("segment", "state", "year",
                    (F.col("n") / F.sum("n").over(W.partitionBy("segment", "year"))).alias("share"))
