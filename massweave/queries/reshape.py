"""C: column arithmetic and reshaping."""

from pyspark.sql import functions as F

from massweave.functions import text as tx
from massweave.operators import reshape as rs
from massweave.queries._base import COMPONENTS_SQL, SEG_SQL, components, query, r, segment_col, table

FAC = "CAST(CASE %s WHEN 'Std' THEN 1.0 WHEN 'Opt' THEN 0.5 WHEN 'Rare' THEN 0.25 ELSE 0.0 END AS DOUBLE)"
FACTORS_SQL = COMPONENTS_SQL + ", factors AS (SELECT *, " + ", ".join(
    (FAC % f"label_{s}") + f" AS f_{s}" for s in ("ab", "cd", "ef")) + " FROM components)"


def factors(spark, sf):
    return components(spark, sf).withColumns({f"f_{s}": tx.factor_lenient(f"label_{s}") for s in ("ab", "cd", "ef")})


SIZES = ["small_min", "small_max", "medium_min", "medium_max", "large_min", "large_max"]


@query("c01_scale_by_factor", "WITH " + FACTORS_SQL + " SELECT comp_id, " + ", ".join(
    f"coalesce({m}, 0.0::DOUBLE) * f_{s} AS {s}_{m}" for s in ("ab", "cd", "ef") for m in SIZES) + " FROM factors")
def c01(spark, sf):
    out = rs.scale_by_factor(factors(spark, sf), SIZES, {s: f"f_{s}" for s in ("ab", "cd", "ef")})
    return out.select("comp_id", *[f"{s}_{m}" for s in ("ab", "cd", "ef") for m in SIZES])


@query("c02_override_or_scale", "WITH " + FACTORS_SQL + " SELECT comp_id, " + ", ".join(
    f"CASE WHEN step_{b} = -1 THEN {s}_{b} ELSE step_{b} * f_{s} END AS {s}_step_{b}" for s in ("ab", "cd", "ef") for b in ("min", "max")) + " FROM factors")
def c02(spark, sf):
    return factors(spark, sf).select("comp_id", *[
        rs.override_or_scale(f"step_{b}", f"{s}_{b}", f"f_{s}").alias(f"{s}_step_{b}") for s in ("ab", "cd", "ef") for b in ("min", "max")])


@query("c03_row_total", "WITH " + COMPONENTS_SQL + """
SELECT comp_id, dcs_min + dcm_min + ab_min AS total_min, dcs_max + dcm_max + ab_max AS total_max FROM components""")
def c03(spark, sf):
    return components(spark, sf).select("comp_id", rs.row_total(["dcs_min", "dcm_min", "ab_min"]).alias("total_min"),
                                        rs.row_total(["dcs_max", "dcm_max", "ab_max"]).alias("total_max"))


@query("c04_fill_zero", "WITH " + COMPONENTS_SQL + " SELECT comp_id, coalesce(small_max, 0.0::DOUBLE) AS small_max, medium_max FROM components")
def c04(spark, sf):
    return rs.fill_zero(components(spark, sf).select("comp_id", "small_max", "medium_max"), ["small_max", "medium_max"])


@query("c05_project_like", """
SELECT p_partkey, CAST(NULL AS VARCHAR) AS location, p_name, p_type FROM part""")
def c05(spark, sf):
    p = rs.insert_after(table(spark, sf, "part").select("p_type", "p_partkey", "p_name"), "p_type", "p_partkey")
    return rs.project_like(rs.keep_present(p, ["p_partkey", "p_type", "p_name", "p_colour"]), ["p_partkey", "location", "p_name", "p_type"])


@query("c06_to_long", "WITH " + COMPONENTS_SQL + " " + " UNION ALL ".join(
    f"SELECT comp_id, '{z}' AS size, '{b}' AS stat, {z}_{b} AS value FROM components" for z in ("small", "medium", "large") for b in ("min", "max")))
def c06(spark, sf):
    return rs.to_long(components(spark, sf), ["comp_id"], "(small|medium|large)_(min|max)", ["size", "stat"])


@query("c07_to_wide", f"""
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, p_type,
  round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 4) AS "A", round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 4) AS "N",
  round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 4) AS "R"
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def c07(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    j = li.join(p, li.l_partkey == p.p_partkey).withColumn("year", F.year("l_shipdate"))
    w = rs.to_wide(j, ["year", "p_type"], "l_returnflag", "l_quantity", ["A", "N", "R"])
    return w.select("year", "p_type", *[r(c, 4).alias(c) for c in ("A", "N", "R")])


@query("c08_convert_unit", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 0.001::DOUBLE, 6) AS g, round(l_quantity * 1000.0::DOUBLE, 6) AS g_from_kg,
  round(l_quantity * 0.000001::DOUBLE, 9) AS fraction, round(l_quantity * 8.96::DOUBLE * l_linenumber * 0.001::DOUBLE, 6) AS cu_kg FROM lineitem""")
def c08(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(tx.convert_unit(q, "mg", "g")).alias("g"),
        r(tx.convert_unit(q, "kg", "g")).alias("g_from_kg"), r(tx.convert_unit(q, "ppm", "fraction"), 9).alias("fraction"),
        r(tx.convert_unit(tx.copper_grams(q, F.col("l_linenumber")), "g", "kg")).alias("cu_kg"))


MATERIAL_SQL = "materials AS (SELECT " + SEG_SQL + """ AS segment, l_orderkey, CASE l_linenumber WHEN 1 THEN 'aluminum_steel' WHEN 2 THEN 'Steel' WHEN 3 THEN 'Aluminum' ELSE 'Copper' END AS material,
  l_quantity AS mass FROM lineitem)"""


def materials(spark, sf):
    return table(spark, sf, "lineitem").select(segment_col().alias("segment"), "l_orderkey", F.expr(
        "CASE l_linenumber WHEN 1 THEN 'aluminum_steel' WHEN 2 THEN 'Steel' WHEN 3 THEN 'Aluminum' ELSE 'Copper' END").alias("material"),
        F.col("l_quantity").alias("mass"))


SPLIT_SQL = MATERIAL_SQL + """, split AS (SELECT segment, l_orderkey, material, mass FROM materials WHERE material <> 'aluminum_steel'
  UNION ALL SELECT segment, l_orderkey, 'Aluminum', mass * 0.7::DOUBLE FROM materials WHERE material = 'aluminum_steel'
  UNION ALL SELECT segment, l_orderkey, 'Steel', mass * 0.3::DOUBLE FROM materials WHERE material = 'aluminum_steel')"""


def split_materials(spark, sf):
    return rs.split_row(materials(spark, sf), F.col("material") == "aluminum_steel", "material", "mass", {"Aluminum": 0.7, "Steel": 0.3})


@query("c09_split_row", "WITH " + SPLIT_SQL + " SELECT segment, l_orderkey, material, round(mass, 6) AS mass FROM split")
def c09(spark, sf):
    return split_materials(spark, sf).withColumn("mass", r("mass"))


@query("c10_merge_labels", "WITH " + SPLIT_SQL + " SELECT segment, material, round(sum(mass), 4) AS mass FROM split GROUP BY ALL")
def c10(spark, sf):
    return rs.merge_labels(split_materials(spark, sf), ["segment", "material"], ["mass"]).withColumn("mass", r("mass", 4))


FRACTION_SQL = """parts_ AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'Si' WHEN 2 THEN 'C' WHEN 3 THEN 'Mn' ELSE 'Al' END AS element,
   sum(l_discount) * 2 AS fraction FROM lineitem GROUP BY ALL)"""


def fractions(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", F.expr(
        "CASE l_linenumber WHEN 1 THEN 'Si' WHEN 2 THEN 'C' WHEN 3 THEN 'Mn' ELSE 'Al' END").alias("element")).agg(
        (F.sum("l_discount") * 2).alias("fraction"))


@query("c11_balance", "WITH " + FRACTION_SQL + """
SELECT l_orderkey, element, round(fraction, 6) + 0.0 AS fraction FROM parts_
UNION ALL SELECT l_orderkey, 'Fe', round(greatest(least(1.0::DOUBLE - sum(fraction), 1.0::DOUBLE), 0.0::DOUBLE), 6) + 0.0 FROM parts_ GROUP BY 1""")
def c11(spark, sf):
    return rs.balance(fractions(spark, sf), ["l_orderkey"], "element", "fraction", "Fe").withColumn("fraction", r("fraction"))


@query("c12_normalise", "WITH " + FRACTION_SQL + """
SELECT l_orderkey, element, CASE WHEN t <> 0 THEN round(fraction / t, 6) + 0.0 ELSE 0.0 END AS fraction
FROM (SELECT *, sum(fraction) OVER (PARTITION BY l_orderkey) AS t FROM parts_)""")
def c12(spark, sf):
    return rs.normalise(fractions(spark, sf), ["l_orderkey"], "fraction").withColumn("fraction", r("fraction"))


@query("c13_na_fill", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'N/A' ELSE event_type END AS event_type,
  CASE WHEN user_id % 3 = 0 THEN 'N/A' ELSE CAST(user_id AS VARCHAR) END AS owner, 'Electronics' AS system, 'img/' || event_type || '.png' AS image FROM events""")
def c13(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("img/"), "event_type", F.lit(".png")).alias("image"),
        F.when(F.col("event_type") == "view", F.lit("  ")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("owner"))
    return rs.na_fill(e, ["event_type", "owner"], {"system": "Electronics"})


@query("c14_label_cols", """
SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN p_name || '*' ELSE p_name END AS marked, p_type || ' / ' || p_brand AS label FROM part""")
def c14(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_type").isin("PROMO", "LARGE"), F.concat("p_name", F.lit("*"))).otherwise(F.col("p_name")).alias("marked"),
        F.concat("p_type", F.lit(" / "), "p_brand").alias("label"))
