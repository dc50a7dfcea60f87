"""A: reading, contracts, series names, writing."""

from pyspark.sql import functions as F

from massweave.functions import text as tx
from massweave.queries._base import query, r, table
from massweave.scale import scratch_path
from massweave.sources import readers as rd
from massweave.sources import writers as wr


@query("a01_read_parts", """
SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality, 'documents' AS part FROM documents
UNION ALL SELECT doc_id, NULL, quality, 'labels' FROM labels""")
def a01(spark, sf):
    return rd.read_parts(spark, {"documents": f"{sf}/documents.parquet", "labels": f"{sf}/labels.parquet"},
                         cols=["doc_id", "lang", "quality"], tag="part")


@query("a02_clean_table", """
SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL""")
def a02(spark, sf):
    # a report with subtotal rows, as an exported sheet has them
    report = (table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
              .select(F.coalesce("o_orderpriority", F.lit("TOTAL")).alias("priority"),
                      F.col("o_orderstatus").alias("status"), "n"))
    return rd.clean_table(report, ["priority", "status"], {"priority": ["TOTAL"]})


@query("a03_unique_columns", """
SELECT c_custkey AS key, c_name AS name, CAST(n_nationkey AS INTEGER) AS key_1, n_name AS name_1,
  r_regionkey AS key_2, r_name AS name_2
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def a03(spark, sf):
    c, n, g = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return rd.unique_columns(j.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                      F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"),
                                      F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query("a04_col_ci", "SELECT p_partkey AS id, p_type AS kind, p_size AS size FROM part")
def a04(spark, sf):
    p = table(spark, sf, "part").withColumnsRenamed({"p_type": "P Type", "p_size": " p_Size "})
    return p.select(rd.col_ci(p, "P_PartKey ").alias("id"), rd.col_ci(p, "p type").alias("kind"),
                    rd.col_ci(p, "P_SIZE").alias("size"))


@query("a05_try_numeric", """
WITH t AS (SELECT page_id, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS PCB_text,
             regexp_extract(url, '[?]page=([0-9a-z]+)', 1) AS n_text FROM pages)
SELECT page_id,
  CASE WHEN regexp_matches(PCB_text, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$')
       THEN try_cast(trim(PCB_text) AS DOUBLE) END AS PCB_text,
  coalesce(CASE WHEN regexp_matches(n_text, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$')
       THEN try_cast(trim(n_text) AS DOUBLE) END, 0.0::DOUBLE) AS n_text
FROM t""")
def a05(spark, sf):
    t = table(spark, sf, "pages").select(
        "page_id", F.element_at(F.split(F.regexp_replace("url", "[?#].*$", ""), "/"), -1).alias("PCB_text"),
        F.regexp_extract("url", "[?]page=([0-9a-z]+)", 1).alias("n_text"))
    return rd.try_numeric(rd.try_numeric(t, contains=["PCB", "PVB"]), ["n_text"], default=0.0)


@query("a06_params", """
WITH kv AS (SELECT event_type AS parameter, max(value) AS value FROM events GROUP BY 1),
 rows_ AS (SELECT user_id, min(CASE WHEN event_type = 'error' THEN value END) AS low,
             max(CASE WHEN event_type = 'signup' THEN value END) AS high FROM events GROUP BY 1)
SELECT max(CASE WHEN parameter = 'click' THEN value END) AS click,
       max(CASE WHEN parameter = 'view' THEN value END) AS view,
       any_value(low) AS low, any_value(high) AS high
FROM kv, (SELECT low, high FROM rows_ WHERE low IS NOT NULL AND high IS NOT NULL ORDER BY user_id LIMIT 1)""")
def a06(spark, sf):
    ev = table(spark, sf, "events")
    kv = ev.groupBy(F.col("event_type").alias("parameter")).agg(F.max("value").alias("value"))
    rows = ev.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("value"))).alias("low"),
                                     F.max(F.when(F.col("event_type") == "signup", F.col("value"))).alias("high"))
    return rd.params(kv, "parameter", "value", ["click", "view"]).crossJoin(
        rd.first_valid(rows, ["low", "high"], ["user_id"]))


@query("a07_active_scenario", """
WITH c AS (SELECT arg_min(event_type, (-n, event_type)) AS active FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1))
SELECT active, 'click' AS pinned, count(*) AS n, round(avg(value), 6) AS mean_value
FROM events, c WHERE event_type = active GROUP BY 1, 2""")
def a07(spark, sf):
    ev = table(spark, sf, "events")
    allowed = ["click", "error", "purchase", "signup", "view"]
    n = ev.groupBy("event_type").agg(F.count("*").alias("n"))
    control = n.agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("cell"))
    active = rd.active_scenario(control, "cell", allowed)
    pinned = rd.active_scenario(control, "cell", allowed, override="click").withColumnRenamed("active", "pinned")
    one = active.crossJoin(pinned)                       # one row by construction
    return (ev.join(F.broadcast(one), ev.event_type == one.active).groupBy("active", "pinned")
            .agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean_value")))


PATHS_SQL = """paths AS (SELECT p_partkey, 'out/histogram_' ||
  CASE p_size % 4 WHEN 0 THEN 'AB' WHEN 1 THEN 'CD' WHEN 2 THEN 'EF' ELSE 'GH' END || '_' || replace(p_name, ' ', '_') || '_' ||
  CASE p_size % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' WHEN 3 THEN 'Small' ELSE 'large' END ||
  CASE WHEN p_size % 6 = 5 THEN '_count' ELSE '_area' END || '.csv' AS path FROM part)"""


@query("a08_parse_series_name", "WITH " + PATHS_SQL + r"""
SELECT p_partkey, regexp_extract(stem, pat, 1) AS segment, regexp_extract(stem, pat, 2) AS category,
  regexp_extract(stem, pat, 3) AS size
FROM (SELECT p_partkey, regexp_replace(list_extract(string_split(path, '/'), -1), '\.[A-Za-z0-9]+$', '') AS stem,
        '^histogram_(AB|CD|EF)_(.+)_(small|medium|large)_area$' AS pat FROM paths)
WHERE regexp_matches(stem, '^histogram_(AB|CD|EF)_(.+)_(small|medium|large)_area$')""".replace(
    "stem, pat,", "stem, '^histogram_(AB|CD|EF)_(.+)_(small|medium|large)_area$',"))
def a08(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr(
        "concat('out/histogram_', CASE p_size % 4 WHEN 0 THEN 'AB' WHEN 1 THEN 'CD' WHEN 2 THEN 'EF' ELSE 'GH' END, '_', "
        "replace(p_name, ' ', '_'), '_', CASE p_size % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' "
        "WHEN 3 THEN 'Small' ELSE 'large' END, CASE WHEN p_size % 6 = 5 THEN '_count' ELSE '_area' END, '.csv')").alias("path"))
    return rd.parse_series_name(p, "path").select("p_partkey", "segment", "category", "size")


@query("a09_first_token", """
SELECT page_id, CASE WHEN contains(lower(url), 'spam-farm') THEN 'spam-farm' WHEN contains(lower(url), 'cheap-pills') THEN 'cheap-pills'
  WHEN contains(lower(url), 'blog.') THEN 'blog' WHEN contains(lower(url), 'www.') THEN 'www' WHEN contains(lower(url), 'example') THEN 'plain' END AS token
FROM pages""")
def a09(spark, sf):
    tokens = {"spam-farm": "spam-farm", "cheap-pills": "cheap-pills", "blog.": "blog", "www.": "www", "example": "plain"}
    return table(spark, sf, "pages").select("page_id", tx.first_token("url", tokens).alias("token"))


@query("a10_read_globs", "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1")
def a10(spark, sf):
    # the two patterns overlap; the file is read once
    return (rd.read_globs(spark, [f"{sf}/order*.parquet", f"{sf}/orders.par*"]).groupBy(F.col("o_orderstatus").alias("status"))
            .agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys")))


@query("a11_flatten_composition", """
SELECT event_id, event_type AS category, 'user_' || user_id AS element, value AS mg_per_cm2_min,
  CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS DOUBLE) AS mg_per_cm2_typical, CAST(NULL AS DOUBLE) AS weight_percent_max
FROM events""")
def a11(spark, sf):
    doc = table(spark, sf, "events").select("event_id", F.expr(
        "concat('{\"', event_type, '\": {\"user_', user_id, '\": {\"mg_per_cm2_min\": ', value, "
        "', \"mg_per_cm2_typical\": ', get_json_object(props, '$.k'), '}}}')").alias("doc"))
    return rd.flatten_composition(doc, "doc").select("event_id", "category", "element", "mg_per_cm2_min",
                                                     "mg_per_cm2_typical", "weight_percent_max")


@query("a12_write_series", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def a12(spark, sf):
    path = scratch_path(spark, "series")
    wr.write_series(table(spark, sf, "orders"), path, ["o_orderpriority"])
    return (spark.read.parquet(path).groupBy("o_orderpriority", "o_orderstatus")
            .agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total")))


@query("a13_write_draws", """
SELECT event_type, event_id, CAST(value AS FLOAT) AS value FROM events""")
def a13(spark, sf):
    path = scratch_path(spark, "draws")
    wr.write_draws(table(spark, sf, "events").select("event_type", "event_id", "value"), path, ["event_type"])
    return spark.read.parquet(path).select("event_type", "event_id", "value")


@query("a14_series_manifest", """
WITH h AS (SELECT l_returnflag, l_linestatus, CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS count
           FROM lineitem GROUP BY ALL)
SELECT 'count' AS series_type, l_returnflag AS segment, l_linestatus AS label,
  'histograms/histogram_' || l_returnflag || '_' || l_linestatus || '.csv' AS histogram_file,
  'raw_data/histogram_' || l_returnflag || '_' || l_linestatus || '.parquet' AS raw_file,
  CAST(sum(count) AS BIGINT) AS n_simulations, count(bin) AS n_bins FROM h GROUP BY ALL""")
def a14(spark, sf):
    h = (table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 5).alias("bin"))
         .agg(F.count("*").alias("count")))
    return wr.series_manifest(h, "count", "l_returnflag", "l_linestatus")


@query("a15_safe_name", r"""
SELECT page_id, regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS trimmed,
  regexp_replace(url, '[^\p{L}\p{N}_\-]', '_', 'g') AS per_char FROM pages""")
def a15(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.safe_name("url").alias("trimmed"),
                                            tx.safe_name_per_char("url").alias("per_char"))


@query("a16_scenario_suffix", """
SELECT o_orderkey, 'stats' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '_' || o_orderstatus END || '.csv' AS file FROM orders""")
def a16(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.concat(
        F.lit("stats"), tx.scenario_suffix("o_orderstatus", "P"), F.lit(".csv")).alias("file"))


@query("a17_require", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def a17(spark, sf):
    cols = ["s_suppkey", "s_name", "s_nationkey"]
    rd.require_files(spark, [f"{sf}/supplier.parquet"])
    return rd.require(table(spark, sf, "supplier"), cols, "supplier").select(*cols)
