"""B: cleaning, predicates, classification."""

from pyspark.sql import functions as F

from massweave.functions import text as tx
from massweave.operators import cleaning as cl
from massweave.plans import literals as lit
from massweave.queries._base import COMPONENTS_SQL, components, query, r, table

SP = tx.SPACE_CLASS


@query("b01_norm_text", f"""
SELECT doc_id, trim(regexp_replace(text, '{SP}', ' ', 'g')) AS text,
  md5(lower(trim(regexp_replace(replace(text, ' ', chr(160)), '{SP}', ' ', 'g')))) AS key_md5 FROM documents""")
def b01(spark, sf):
    # the second column swaps every space for a non-breaking one first
    return table(spark, sf, "documents").select(
        "doc_id", tx.norm_text("text").alias("text"),
        F.md5(tx.norm_key(F.translate("text", " ", " "))).alias("key_md5"))


@query("b02_match_key", f"""
SELECT p_partkey, lower(trim(regexp_replace(p_type, '{SP}', ' ', 'g'))) || '||' ||
  coalesce(lower(trim(regexp_replace(CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name END, '{SP}', ' ', 'g'))), 'nan') AS key
FROM part""")
def b02(spark, sf):
    name = F.when(F.col("p_size") % 10 != 0, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", tx.match_key(F.col("p_type"), name).alias("key"))


@query("b03_dedup_exact", """
SELECT min(l_orderkey) AS first_order, l_partkey, l_returnflag, l_linestatus FROM lineitem
GROUP BY l_partkey, l_returnflag, l_linestatus""")
def b03(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("first_order"), "l_partkey", "l_returnflag", "l_linestatus")
    return cl.dedup_exact(li, ["l_partkey", "l_returnflag", "l_linestatus"], ["first_order"])


@query("b03_dedup_report", """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS n_copies, max(n) AS most
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag, l_linestatus)""")
def b03_report(spark, sf):
    return cl.dedup_report(table(spark, sf, "lineitem"), ["l_partkey", "l_returnflag", "l_linestatus"])


@query("b04_dedup_signature", """
SELECT l_suppkey, l_quantity, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, min(l_orderkey) AS l_orderkey
FROM (SELECT l_suppkey, l_quantity, abs(l_discount) AS l_discount, abs(l_tax) AS l_tax, l_orderkey FROM lineitem) GROUP BY ALL""")
def b04(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", F.abs("l_discount").alias("l_discount"),
                                             F.abs("l_tax").alias("l_tax"), "l_orderkey")
    return cl.dedup_signature(li, "l_suppkey", ["l_quantity", "l_discount", "l_tax"], ["l_orderkey"])


@query("b05_conflicts", """
WITH v AS (SELECT p_name, p_type, p_brand, count(*) AS n FROM part GROUP BY ALL),
 c AS (SELECT p_name, count(*) AS n_variants, CAST(sum(n) AS BIGINT) AS n_rows FROM v GROUP BY 1 HAVING count(*) > 1),
 k AS (SELECT p_name, arg_min(p_type, p_partkey) AS kept_type, arg_min(p_brand, p_partkey) AS kept_brand FROM part GROUP BY 1)
SELECT c.p_name, n_variants, n_rows, kept_type, kept_brand FROM c JOIN k ON c.p_name = k.p_name""")
def b05(spark, sf):
    p = table(spark, sf, "part")
    kept = cl.keep_first(p, "p_name", ["p_partkey"]).select("p_name", F.col("p_type").alias("kept_type"),
                                                            F.col("p_brand").alias("kept_brand"))
    return cl.conflicts(p, "p_name", ["p_type", "p_brand"]).join(kept, "p_name")


@query("b06_factor_lenient", """
SELECT o_orderkey, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.5 WHEN '3' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS factor
FROM orders""")
def b06(spark, sf):
    label = F.expr("CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Std ' WHEN '2' THEN 'Opt' WHEN '3' THEN 'Rare' WHEN '4' THEN 'TBD' END")
    return table(spark, sf, "orders").select("o_orderkey", tx.factor_lenient(label).alias("factor"))


@query("b07_factor_strict", "WITH " + COMPONENTS_SQL + """
SELECT comp_id, CAST(CASE label_ab WHEN 'Std' THEN 1.0 WHEN 'Opt' THEN 0.5 WHEN 'Rare' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS factor_ab,
  CAST(CASE label_cd WHEN 'Std' THEN 1.0 WHEN 'Opt' THEN 0.5 WHEN 'Rare' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS factor_cd FROM components""")
def b07(spark, sf):
    c = cl.factor_strict(cl.factor_strict(components(spark, sf), "label_ab", "factor_ab"), "label_cd", "factor_cd")
    return c.select("comp_id", "factor_ab", "factor_cd")


def classify_sql(domain: str, component: str) -> str:
    text = {"domain": "d", "component": "c", "both": "b"}
    cases = " ".join("WHEN regexp_matches(%s, '%s') THEN '%s'" % (text[t], p, v) for t, p, v in lit.CLASSIFICATION_RULES)
    return f"CASE {cases} ELSE '{lit.CLASSIFICATION_DEFAULT}' END"


@query("b08_classify", f"""
SELECT doc_id, {classify_sql('d', 'c')} AS category FROM (SELECT doc_id, d, c, d || ' ' || c AS b FROM (
  SELECT doc_id, lower(trim(source)) AS d, lower(trim(trim(regexp_replace(text, '{SP}', ' ', 'g')))) AS c FROM documents))""")
def b08(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", tx.norm_text("text").alias("text"))
    return cl.classify(d, "source", "text", lit.CLASSIFICATION_RULES, lit.CLASSIFICATION_DEFAULT).select("doc_id", "category")


@query("b09_any_positive", "WITH " + COMPONENTS_SQL + """
SELECT comp_id, dcs_min, dcm_min, dcm_max FROM components WHERE greatest(dcs_min, dcm_min, dcm_max) > 0""")
def b09(spark, sf):
    return cl.any_positive(components(spark, sf).select("comp_id", "dcs_min", "dcm_min", "dcm_max"), ["dcs_min", "dcm_min", "dcm_max"])


@query("b10_segment_from_text", """
SELECT c_custkey, CASE WHEN contains(upper(c_mktsegment), 'AUTO') THEN 'AB' WHEN contains(upper(c_mktsegment), 'HOUSE') THEN 'CD'
  WHEN contains(upper(c_mktsegment), 'MACH') THEN 'EF' END AS segment FROM customer""")
def b10(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.segment_from_text(
        "c_mktsegment", [("auto", "AB"), ("house", "CD"), ("mach", "EF")]).alias("segment"))


@query("b11_map_code", """
SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AB' WHEN 'BUILDING' THEN 'AB' WHEN 'FURNITURE' THEN 'CD' WHEN 'MACHINERY' THEN 'EF' END AS segment,
  count(*) AS n, c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') AS skipped FROM customer GROUP BY ALL""")
def b11(spark, sf):
    m = {"AUTOMOBILE": "AB", "BUILDING": "AB", "FURNITURE": "CD", "MACHINERY": "EF"}
    return (cl.map_code(table(spark, sf, "customer"), "c_mktsegment", m, "segment")
            .groupBy("segment").agg(F.count("*").alias("n")).withColumn("skipped", F.col("segment").isNull()))


@query("b12_check_triangular", "WITH " + COMPONENTS_SQL + """
SELECT comp_id, 'sizes' AS triple, small_min AS lo, medium_min AS mode, large_min AS hi FROM components
  WHERE NOT (small_min <= medium_min AND medium_min <= large_min)
UNION ALL SELECT comp_id, 'steps', step_min, step_max, ef_max FROM components WHERE NOT (step_min <= step_max AND step_max <= ef_max)""")
def b12(spark, sf):
    return cl.check_triangular(components(spark, sf), ["comp_id"], {
        "sizes": ("small_min", "medium_min", "large_min"), "steps": ("step_min", "step_max", "ef_max")})


@query("b13_marker_or_value", """
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS presence,
  l_returnflag = 'R' AS is_marker FROM lineitem""")
def b13(spark, sf):
    cell = F.when(F.col("l_returnflag") == "R", F.lit("Driver B")).otherwise(F.col("l_quantity").cast("string"))
    p = tx.marker_or_value(cell)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
                                               p.alias("presence"), p.isNull().alias("is_marker"))


@query("b14_active_columns", "WITH " + COMPONENTS_SQL + """
SELECT comp_id, small_max, medium_max, large_max FROM components WHERE greatest(small_max, medium_max, large_max) > 0""")
def b14(spark, sf):
    c = components(spark, sf).withColumn("spare_max", F.lit(0.0))
    cols = [x for x in c.columns if x.endswith("_max") and x.split("_")[0] in ("small", "medium", "large", "spare", "step")]
    active = cl.active_columns(c, cols, exclude=["step_max"])
    return cl.any_positive(c.select("comp_id", *active), active)


@query("b15_fix_bounds", "WITH " + COMPONENTS_SQL + """
SELECT comp_id, least(large_max, medium_min) AS lo, greatest(large_max, medium_min) AS hi,
  least(greatest(ef_max, least(large_max, medium_min)), greatest(large_max, medium_min)) AS mode FROM components""")
def b15(spark, sf):
    lo, mode, hi = cl.fix_bounds("large_max", "ef_max", "medium_min")
    return components(spark, sf).select("comp_id", lo.alias("lo"), mode.alias("mode"), hi.alias("hi"))


@query("b16_nearest_level", """
SELECT *, CAST(CASE level WHEN 1.0 THEN 0.75 WHEN 0.5 THEN 0.375 WHEN 0.25 THEN 0.125 ELSE 0.0 END AS DOUBLE) AS bin_lo,
  CAST(CASE level WHEN 1.0 THEN 1.0 WHEN 0.5 THEN 0.75 WHEN 0.25 THEN 0.375 ELSE 0.125 END AS DOUBLE) AS bin_hi,
  round(abs(x - level), 9) AS gap
FROM (SELECT p_partkey, x, CAST(CASE WHEN x >= 0.75 THEN 1.0 WHEN x >= 0.375 THEN 0.5 WHEN x >= 0.125 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS level
  FROM (SELECT p_partkey, p_size / 48.0::DOUBLE AS x FROM part))""")
def b16(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / F.lit(48.0)).alias("x"))
    t = t.withColumn("level", cl.nearest_level("x"))
    lo, hi = cl.label_bin("level")
    return t.select("p_partkey", "x", "level", lo.alias("bin_lo"), hi.alias("bin_hi"),
                    r(F.abs(F.col("x") - F.col("level")), 9).alias("gap"))


@query("b17_filter_labels", """
SELECT label, count(*) AS n FROM (SELECT CASE WHEN p_size % 10 = 0 THEN 'nan' WHEN p_size % 10 = 1 THEN ' ' WHEN p_size % 10 = 2 THEN 'Total_Motor' ELSE p_name END AS label FROM part)
WHERE lower(trim(label)) NOT IN ('', 'nan', 'total_motor') AND label LIKE 'small%' GROUP BY 1""")
def b17(spark, sf):
    t = table(spark, sf, "part").select(F.expr("CASE WHEN p_size % 10 = 0 THEN 'nan' WHEN p_size % 10 = 1 THEN ' ' WHEN p_size % 10 = 2 THEN 'Total_Motor' ELSE p_name END").alias("label"))
    return cl.filter_labels(t, "label", drop=["total_motor", "total_gearbox"], prefix="small").groupBy("label").agg(F.count("*").alias("n"))


@query("b18_tag_membership", """
SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'critical' ELSE 'other' END AS class FROM part""")
def b18(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.tag_membership("p_type", ["PROMO", "LARGE"], "critical", "other").alias("class"))
