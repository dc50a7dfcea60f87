import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from massweave.functions import draws as dr
from massweave.functions import text as tx
from massweave.operators import cleaning as cl
from massweave.operators import curves as cv
from massweave.operators import histogram as hg
from massweave.operators import joins as jn
from massweave.operators import sampling as sp
from massweave.operators import stats as st
from massweave.operators import windows as wn
from massweave.plans import literals as lit
from massweave.sources import readers as rd


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, values are heavy-tailed and repeated."""
    rng = np.random.default_rng(7)
    a = pd.DataFrame({"k": "hot", "v": np.round(np.exp(rng.normal(0, 3, 20000)), 2), "w": rng.integers(0, 5, 20000).astype(float)})
    b = pd.DataFrame({"k": "cold", "v": [1.0, 2.0, 2.0, 1e9], "w": [3.0, 1.0, 2.0, 0.0]})
    pdf = pd.concat([a, b], ignore_index=True)
    pdf["id"] = range(len(pdf))
    return pdf, spark.createDataFrame(pdf).repartition(16)


def test_exact_percentiles_on_skew(skewed):
    pdf, df = skewed
    got = {r.k: r for r in st.exact_percentiles(df, ["k"], "v", {"p025": 2.5, "p50": 50, "p975": 97.5}).collect()}
    for k, g in pdf.groupby("k"):
        want = np.percentile(g.v, [2.5, 50, 97.5])
        assert np.allclose([got[k].p025, got[k].p50, got[k].p975], want, rtol=1e-12)


def test_avg_rank(skewed):
    pdf, df = skewed
    r = wn.avg_rank(df, ["k"], "v").toPandas().set_index("id")["rank"]
    assert np.allclose(r.sort_index(), pdf.groupby("k").v.rank().sort_index())


@pytest.fixture(scope="module")
def odd(spark):
    """A lognormal series, one with NaN, one of a single value, one with NULLs and one of NULLs only."""
    rng = np.random.default_rng(11)
    rows = [("log", float(np.exp(x)), i) for i, x in enumerate(rng.normal(0, 6, 30000))]
    rows += [("nan", float("nan") if i % 3 == 0 else float(i % 50), 100000 + i) for i in range(3000)]
    rows += [("one", 4.5, 200000 + i) for i in range(20000)]
    rows += [("null", None if i % 2 else float(i), 300000 + i) for i in range(1000)] + [("none", None, 400000 + i) for i in range(10)]
    return rows, spark.createDataFrame(rows, "k string, v double, id long").repartition(8)


def test_cells_hold_alike_many_rows(odd):
    rows, df = odd
    sizes = [r["count"] for r in st.in_cells(df, ["k"], ["v", "id"]).groupBy("_cell").count().collect()]
    assert max(sizes) < 2.5 * len(rows) / len(sizes)


def test_ranks_keep_null_rows(odd):
    rows, df = odd
    pdf = pd.DataFrame(rows, columns=["k", "v", "id"]).set_index("id")
    got = wn.avg_rank(df, ["k"], "v").toPandas().set_index("id").sort_index()
    assert len(got) == len(rows)
    known = [i for i, (_, v, _) in zip(pdf.index, rows) if v is not None]
    want = pdf.loc[known].v.fillna(np.inf).groupby(pdf.k).rank()
    assert np.allclose(got.loc[want.index, "rank"], want) and got.drop(index=known)["rank"].isna().all()
    ids = wn.row_id(df, ["k"], "v", ["id"]).toPandas()
    for k, g in ids.groupby("k"):
        assert sorted(g.row_id) == list(range(1, len(g) + 1))
    order = {r.id: r.row_id for r in ids.itertuples()}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] is not None and r[1] != r[1], r[1] if r[1] is not None and r[1] == r[1] else 0, r[2]))
        assert [order[r[2]] for r in mine] == list(range(1, len(mine) + 1))


def test_percentiles_of_odd_series(odd):
    rows, df = odd
    got = {r.k: r for r in st.exact_percentiles(df, ["k"], "v", {"a": 0, "b": 2.5, "c": 50, "d": 97.5, "e": 100}).collect()}
    assert set(got) == {"log", "nan", "one", "null"}
    for k in ("log", "one", "null"):
        v = np.array([r[1] for r in rows if r[0] == k and r[1] is not None])
        assert np.allclose([*got[k]][1:], np.percentile(v, [0, 2.5, 50, 97.5, 100]), rtol=1e-12)
    v = np.sort(np.array([r[1] for r in rows if r[0] == "nan"]))               # NaN sorts last
    assert got["nan"].a == 0 and got["nan"].c == v[1499] + 0.5 * (v[1500] - v[1499]) and np.isnan(got["nan"].e)


def test_running_sum_of_uneven_positions(spark):
    rows = [("a", 2 ** i, 1) for i in range(50)] + [("a", None, 7), ("b", 5, None), ("b", 6, 3)]
    got = {(r.k, r.o): r.running for r in wn.running_sum(spark.createDataFrame(rows, "k string, o long, n long"), ["k"], "o", "n").collect()}
    assert [got["a", 2 ** i] for i in range(50)] == list(range(1, 51)) and got["a", None] == 57 and got["b", 5] == 0 and got["b", 6] == 3


def test_row_id(skewed):
    pdf, df = skewed
    got = wn.row_id(df, [], "v", ["id"]).toPandas().sort_values(["v", "id"])
    assert list(got.row_id) == list(range(1, len(pdf) + 1))


def test_spearman(skewed):
    pdf, df = skewed
    got = {r.k: r.rho for r in st.spearman(df, ["k"], "w", "v").collect()}
    for k, g in pdf.groupby("k"):
        want = np.corrcoef(g.w.rank(), g.v.rank())[0, 1]
        assert abs(got[k] - want) < 1e-9


def test_draw_moments(spark):
    p = spark.range(40).withColumn("key", F.col("id"))
    d = jn.expand_draws(dr.with_streams(p, 1, ["key"], ["a", "b"]), 5000)
    d = dr.draw_uniforms(d, {"u": ("u_a", "draw"), "v": ("u_b", "draw")})
    r = d.select(F.avg("u").alias("m"), F.var_pop("u").alias("s"), F.corr("u", "v").alias("c"), F.avg(dr.triangular("u", F.lit(1.0), F.lit(2.0), F.lit(4.0))).alias("t"),
                 F.avg(dr.normal("u", "v", 3.0, 2.0)).alias("n"), F.stddev_pop(dr.normal("u", "v", 3.0, 2.0)).alias("sd"), F.min("u").alias("lo"), F.max("u").alias("hi"),
                 F.avg(F.when(dr.bernoulli("u", F.lit(0.3)), 1.0).otherwise(0.0)).alias("b")).first()
    assert abs(r.m - 0.5) < 4e-3 and abs(r.s - 1 / 12) < 2e-3 and abs(r.c) < 1e-2
    assert abs(r.t - 7 / 3) < 1e-2 and abs(r.n - 3) < 3e-2 and abs(r.sd - 2) < 3e-2 and abs(r.b - 0.3) < 6e-3
    assert 0 < r.lo and r.hi < 1


def test_draws_do_not_depend_on_partitions(spark):
    p = spark.range(50).select(F.col("id").alias("key"), F.lit(1.0).alias("lo"), F.lit(3.0).alias("hi"), F.lit(1.0).alias("factor"))
    seen = set()
    for n in (1, 4, 64):
        d = sp.range_draws(p.repartition(n), 200, ["key"])
        seen.add(d.agg(F.sum(F.round(F.col("value") * 1e6).cast("bigint")).alias("s")).first().s)
    assert len(seen) == 1


def test_large_expansion_has_every_draw(spark):
    d = jn.expand_draws(spark.range(2), 20_000, block=1024)
    assert d.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("draw").alias("d"), F.max("draw").alias("m")).collect()[0][1:] == (20000, 20000, 19999)


def test_sums_per_draw_need_no_shuffle(spark):
    p = spark.createDataFrame([(i, float(i)) for i in range(20)], "k int, x double")
    plan = jn.draws_over(p, 1000).groupBy("draw").agg(F.sum("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_curve_passes_through_anchors(spark):
    rows = [(seg, t, y, s[i]) for seg, m in lit.TIER_SHARES.items() for y, s in m.items() for i, t in enumerate(lit.TIERS)]
    a = spark.createDataFrame(rows, "segment string, tier string, year int, share double")
    c = cv.monotone_curve(a, ["segment", "tier"], "year", "share", 2020, 2070).toPandas()
    assert len(c) == 3 * 5 * 51 and c.share.between(0, 1).all()
    m = c.merge(a.toPandas(), on=["segment", "tier", "year"], suffixes=("", "_a"))
    assert np.allclose(m.share, m.share_a)
    h4 = c[(c.segment == "EF") & (c.tier == "H4")].sort_values("year").share
    assert (h4.diff().dropna() >= -1e-12).all() and h4.iloc[0] == h4.iloc[5]
    s = cv.share_curves(a, ["segment"], "tier", "year", "share", 2020, 2070).groupBy("segment", "year").agg(F.sum("share").alias("s")).toPandas()
    assert np.allclose(s.s, 1)


def test_single_anchor_and_two_anchors(spark):
    a = spark.createDataFrame([("one", 2030, 1.7), ("two", 2020, 0.2), ("two", 2030, 0.4)], "k string, year int, v double")
    c = cv.monotone_curve(a, ["k"], "year", "v", 2020, 2032).toPandas().set_index(["k", "year"]).v
    assert set(c["one"]) == {1.7}
    assert abs(c["two"][2025] - 0.3) < 1e-12 and c["two"][2032] == 0.4


def test_binned_percentiles_close_to_exact(skewed, spark):
    x = spark.range(200000).select(F.lit("s").alias("k"), (dr.keyed_uniform(3, "x", "id") + dr.keyed_uniform(3, "y", "id")).alias("v"))
    h = hg.hist_acc(x, ["k"], "v", hg.pilot_range(x, ["k"], "v"))
    b = hg.percentiles_wide(h, ["k"], {"a": 2.5, "b": 50, "c": 97.5}).first()
    e = st.exact_percentiles(x, ["k"], "v", {"a": 2.5, "b": 50, "c": 97.5}).first()
    assert all(abs(b[i] / e[i] - 1) < 0.03 for i in "abc")
    assert hg.coarse(h, ["k"]).count() == 50


def test_bracket_join_against_brute_force(spark):
    a = pd.DataFrame({"k": ["x"] * 4 + ["y"], "ax": [1.0, 2.5, 2.75, 9.0, 5.0], "v": [10.0, 20.0, 30.0, 40.0, 7.0]})
    p = pd.DataFrame({"k": ["x"] * 9 + ["y"] * 2, "x": [0.0, 1.0, 2.4, 2.5, 2.6, 2.75, 8.9, 9.0, 12.0, 1.0, 6.0]})
    got = jn.bracket_join(spark.createDataFrame(p), spark.createDataFrame(a), ["k"], "x", "ax", ["v"], step=0.7).toPandas()
    assert len(got) == len(p)
    for r in got.itertuples():
        g = a[a.k == r.k].sort_values("ax")
        x = min(max(r.x, g.ax.min()), g.ax.max())
        assert r.x_lo == g[g.ax <= x].ax.max()
        up = g[g.ax > x].ax
        assert r.x_hi == (up.min() if len(up) else g.ax.max())


def test_resample_skips_empty_bins(spark):
    h = spark.createDataFrame([("a", 0.0, 1.0, 0), ("a", 1.0, 2.0, 30), ("a", 2.0, 3.0, 0), ("a", 3.0, 4.0, 70), ("z", 0.0, 1.0, 0)],
                              "s string, bin_left double, bin_right double, count long")
    d = sp.resample(h, ["s"], 5000).toPandas()
    assert set(d[d.s == "z"].value) == {0.0} and len(d[d.s == "z"]) == 5000
    f = d[d.s == "a"].value.value_counts(normalize=True)
    assert set(f.index) == {1.5, 3.5} and abs(f[1.5] - 0.3) < 0.03
    with pytest.raises(Exception, match="holds no counts"):
        sp.resample(h, ["s"], 10, within=True).collect()


def test_contracts_fail_loudly(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no match for"):
        jn.strict_lookup(left, right, ["k"], ["v"]).collect()
    bad = spark.createDataFrame([("Std",), ("Maybe",)], "l string")
    with pytest.raises(Exception, match="unrecognised label"):
        cl.factor_strict(bad, "l", "f").collect()
    assert [r.label for r in cl.unknown_labels(bad, "l").collect()] == ["Maybe"]
    with pytest.raises(Exception, match="active scenario"):
        rd.active_scenario(bad.limit(1), "l", ["S1", "S2"]).collect()
    with pytest.raises(ValueError, match="missing column"):
        rd.require(left, ["k", "zz"])
    with pytest.raises(KeyError, match="no column"):
        rd.col_ci(left, "zz")


def test_text_helpers(spark):
    r = spark.createDataFrame([("  Body Control \t Module (BCM) ",)], "s string").select(
        tx.norm_text("s").alias("t"), tx.norm_key("s").alias("k"), tx.safe_name("s").alias("n")).first()
    assert r.t == "Body Control Module (BCM)" and r.k == "body control module (bcm)" and r.n == "Body_Control_Module_BCM"


def test_growth_is_one_at_the_base_year(spark):
    r = spark.range(1).select(dr.saturating_growth(F.lit(1.5), F.lit(30.0), F.lit(2025)).alias("a"), dr.saturating_growth(F.lit(1.5), F.lit(30.0), F.lit(2055)).alias("b")).first()
    assert r.a == 1.0 and abs(r.b - (1.5 - 0.5 * math.exp(-1))) < 1e-12


def test_state_never_leaves_the_list(spark):
    r = spark.range(1).select(dr.comonotonic_state(F.lit(0.9999999999), [F.lit(0.2), F.lit(0.3), F.lit(0.49999)]).alias("s")).first()
    assert r.s == 2


def test_null_and_nan_are_in_no_bin(spark):
    from massweave.operators import histogram as hg
    rows = [("a", float(i)) for i in range(10)] + [("a", None), ("a", float("nan")), ("a", float("inf"))]
    df = spark.createDataFrame(rows, "s string, v double")
    h = hg.hist_acc(df, ["s"], "v", hg.pilot_range(df, ["s"], "v")).collect()
    assert sum(r["count"] for r in h) == 10 and max(r["count"] for r in h) == 1
    assert hg.moments_and_range(df, ["s"], "v").first()["n"] == 10
    left = hg.not_binned(df, ["s"], "v").first()
    assert (left["nulls"], left["not_finite"]) == (1, 2)


def test_draws_of_few_rows_use_all_tasks(spark):
    from pyspark.sql import functions as F

    from massweave.operators import joins as jn
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    e = jn.expand_draws(df, 200_000).withColumn("p", F.spark_partition_id())
    assert e.count() == 400_000 and e.select("id", "draw").distinct().count() == 400_000
    assert e.groupBy("p").count().agg(F.max("count")).first()[0] < 100_000
    assert jn.expand_draws(df, 3).schema == jn.expand_draws(df, 20_000).schema
    a, b = jn.draws_over(df, 5), jn.draws_over(df, 5, max_rows=1)              # a table above the limit takes the other way
    assert a.schema == b.schema and a.dtypes[0] == ("draw", "bigint")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bracket_join_keeps_every_point(spark):
    points = spark.createDataFrame([("a", 1.5, 0), ("a", 9.0, 1), ("a", None, 2), ("none", 1.0, 3), (None, 2.0, 4)], "k string, x double, id int")
    anchors = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), (None, 2, 7.0)], "k string, yr int, v double")
    got = {r.id: (r.x_lo, r.x_hi, r.v_lo, r.v_hi) for r in jn.bracket_join(points, anchors, ["k"], "x", "yr", ["v"], 1.0).collect()}
    assert got == {0: (1.0, 2.0, 10.0, 20.0), 1: (2.0, 2.0, 20.0, 20.0), 2: (None,) * 4, 3: (None,) * 4, 4: (2.0, 2.0, 7.0, 7.0)}


def test_mean_by_year_counts_the_draws(spark):
    static = spark.createDataFrame([("k", 1.0, 3.0, 10.0)], "k string, lo double, hi double, unit double")
    dynamic = spark.createDataFrame([("k", 2000, 4.0), ("k", 2000, 8.0), ("other", 2001, 6.0)], "k string, year int, value double")
    for n in (2, 6):                                          # a draw without a row counts as zero
        m = {(r.k, r.year): r["mean"] for r in st.mean_by_year(static, dynamic, ["k"], spark.range(n), 2000, 2001).collect()}
        assert m == {("k", 2000): 20 + 12 / n, ("k", 2001): 20.0, ("other", 2001): 6 / n}


def test_dedup_reports_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "b")], "x int, y string")
    assert cl.dedup_report(df, ["x", "y"]).first().asDict() == {"n_rows": 5, "n_distinct": 3, "n_copies": 2, "most": 2}


def test_require_names_missing_files(spark, tmp_path):
    (tmp_path / "here.csv").write_text("a\n1\n")
    assert rd.require_files(spark, [f"{tmp_path}/here.csv", f"{tmp_path}/*.csv"]) == [f"{tmp_path}/here.csv", f"{tmp_path}/*.csv"]
    with pytest.raises(FileNotFoundError, match="gone.csv.*nothing"):
        rd.require_files(spark, [f"{tmp_path}/here.csv", f"{tmp_path}/gone.csv", f"{tmp_path}/nothing*.csv"])


def test_fused_stats_equal_two_passes(skewed):
    pdf, df = skewed
    by = ["k"]
    h, m = hg.fused_stats(df, by, "w", F.col("id") % 2 == 0)
    rng = hg.pilot_range(df, by, "w", F.col("id") % 2 == 0)
    want = {(r.k, r.bin): r["count"] for r in hg.hist_acc(df, by, "w", rng).collect()}
    assert {(r.k, r.bin): r["count"] for r in h.collect()} == want
    for r in m.collect():
        w = pdf[pdf.k == r.k].w
        assert r.n == len(w) and abs(r["mean"] - w.mean()) < 1e-9 and abs(r["std"] - w.std(ddof=0)) < 1e-9 and (r["min"], r["max"]) == (w.min(), w.max())
    _, m = hg.fused_stats(df, by, "w", F.col("k") == "hot")   # a series without a pilot row keeps its moments
    assert {r.k: r.n for r in m.collect()} == {"hot": 20000, "cold": 4}


def test_classify_finds_words_in_order(spark):
    from massweave.operators.cleaning import classify
    rules = [("component", "fan.*belt|^x[0-9]+$", "A"), ("both", "charge port|charge", "B"), ("component", "arg", "C"), ("domain", "hv", "D")]
    rows = ["a fan and a belt", "belt before fan", "x12", "chargeport", "a charge  port", "large", "fanbelt", "fabelt", None, "fan"]
    df = spark.createDataFrame([("HV" if i % 2 else "", t) for i, t in enumerate(rows)], "d string, c string")
    got = [r.category for r in classify(df, "d", "c", rules, "-").collect()]
    assert got == ["A", "D", "A", "B", "B", "C", "A", "D", "-", "D"]


def test_tier_and_architecture_are_apart(spark, sf):
    from massweave.queries import draws as qd
    f = qd.fleet(spark, sf).filter(f"year = {qd.Y0}")
    assert abs(f.stat.corr("tier", "state")) < 0.35


def test_streams_add_up(spark):
    from massweave.plans import tables as tb
    w = [(s, m, g, x, k) for s, m, g, x, k in tb.stream_weights(("small", "medium"), ("AB", "CD"))]
    weights = spark.createDataFrame(w, "stream string, motor string, segment string, grade string, weight double")
    grades = spark.createDataFrame([(g, e, lo, hi) for g in sorted({x[3] for x in w}) for e, lo, hi in (("Si", 0.01, 0.03), ("Mn", 0.0, 0.02), ("S_ppm", 10.0, 80.0))],
                                   "grade string, element string, lo double, hi double")
    mass = weights.select("stream", "motor", "segment").distinct().join(spark.range(20).select(F.col("id").cast("int").alias("draw")), how="cross").withColumn("value", F.lit(2.0) + F.col("draw"))
    t = tb.build_streams(mass, grades, weights, 20).toPandas().set_index(["stream", "motor", "segment", "element"])
    assert set(t.index.get_level_values("motor")) == {"small", "medium", "ALL"} and (t.n == 20).all()
    for s in tb.BALANCED:
        for m in ("small", "medium", "ALL"):
            one = t.loc[(s, m, "AB")]
            assert abs(one.drop("TotalMass").mean_fraction.sum() - 1) < 1e-9 and abs(one.drop("TotalMass").mean_mass_kg.sum() - one.loc["TotalMass"].mean_mass_kg) < 1e-9
    assert "Fe" not in t.loc[("Copper", "small", "AB")].index and t.loc[("Copper", "ALL", "CD", "S")].mean_fraction < 1e-4
    assert abs(t.loc[("NdFeB", "ALL", "AB", "TotalMass")].mean_mass_kg - 2 * t.loc[("NdFeB", "small", "AB", "TotalMass")].mean_mass_kg) < 1e-9
    assert t.loc[("Copper", "ALL", "AB", "TotalMass")].p50_mass_kg == 2 * (2 + 9.5)


def test_contains_lookup_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abC"), n))
    texts = [(i, word(int(rng.integers(0, 12)))) for i in range(80)] + [(80, None), (81, "")]
    toks = [(word(int(n)), int(o)) for n, o in zip(rng.integers(1, 6, 25), rng.integers(0, 9, 25))] + [(None, 0)]
    left, right = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(toks, "tok string, o int")
    want = {i: min(((o, k) for k, o in toks if k is not None and t is not None and k.lower() in t.lower()), default=None) for i, t in texts}
    got = jn.contains_lookup(left, "t", right, "tok", ["o", "tok"], ["id"]).collect()
    assert len(got) == len(texts) and {r.id: None if r.tok is None else (r.o, r.tok) for r in got} == want
    every = jn.contains_lookup(left, "t", spark.createDataFrame([("", 1)], "tok string, o int"), "tok", ["o"], ["id"]).collect()
    assert {r.id for r in every if r.o == 1} == {i for i, t in texts if t is not None}


def test_contains_lookup_narrows_only_where_several_match(spark):
    left = spark.createDataFrame([(1, "step motor", "metal"), (2, "dc motor", "wood"), (3, "step motor", "wood")], "id int, t string, gear string")
    right = spark.createDataFrame([("STEP", "Metal", 5), ("step", "plastic", 6), ("dc", "plastic", 7)], "tok string, kind string, mass int")
    same = F.lower(F.col("kind")) == F.col("gear")
    got = {r.id: r.mass for r in jn.contains_lookup(left, "t", right, "tok", ["mass"], ["id"], same).collect()}
    assert got == {1: 5, 2: 7, 3: None}
    with pytest.raises(Exception, match=r"nothing contained for \(id\) = 3"):
        jn.contains_lookup(left, "t", right, "tok", ["mass"], ["id"], same, strict=True).count()
    assert jn.contains_lookup(left, "t", right.limit(0), "tok", ["mass"], ["id"]).filter("mass is null").count() == 3


def test_contains_lookup_explodes_one_length_of_substrings(spark):
    from pyspark.sql import Row
    left = spark.createDataFrame([Row(id=1, t="x" * 40 + "needle" + "".join(chr(97 + i % 26) for i in range(400)))])
    right = spark.createDataFrame([("needle" + "y" * i, i) for i in range(50)], "tok string, o int")
    assert jn.contains_lookup(left, "t", right, "tok", ["o"], ["id"]).first().o == 0
    grams = left.select(F.size(jn.grams_of(F.col("t"), F.array(F.lit(3)))).alias("n")).first().n
    assert grams <= 40


def test_period_table_counts_a_missing_period_as_zero(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 1.0), ("a", 2, 5.0, 4.0), ("b", 2, 7.0, 6.0), ("c", 3, 9.0, 9.0)], "k string, year int, m double, lo double")
    got = {r.k: tuple(r)[1:] for r in jn.period_table(df, ["k"], "year", ["m", "lo"], 1, 2).collect()}
    assert got == {"a": (2.0, 5.0, 1.0, 4.0), "b": (0.0, 7.0, 0.0, 6.0)}


def test_attached_statistics_round_by_exact_value(spark):
    rng = np.random.default_rng(5)
    x = [25.65625, 25.00625, 25.00635, 0.00005, 0.00015, 0.03125, 0.99995, 7.99995, 0.0, -2.65625, 1e-9, 4503599627370495.5, 123456.78125]
    x += [float(a) / int(b) for a, b in zip(rng.integers(1, 10000, 2000), rng.choice([32, 64, 96, 160, 320, 800], 2000))]
    src = spark.createDataFrame([(i,) for i in range(len(x) + 1)], "k int")
    stats = spark.createDataFrame([(i, v, abs(v) / 2) for i, v in enumerate(x)], "k int, mean double, std double")
    got = {r.k: (r.value, r.uncertainty) for r in jn.attach_stats(src, stats, ["k"], ["mean"]).collect()}
    assert got == {**{i: (f"{v:.4f}", f"{abs(v):.4f}") for i, v in enumerate(x)}, len(x): ("N/A", "N/A")}


def test_a_few_draws_move_no_row(spark):
    p = spark.range(100).select(F.col("id").alias("key"), F.lit(1.0).alias("lo"), F.lit(3.0).alias("hi"), F.lit(1.0).alias("factor"))
    plan = lambda n: sp.range_draws(p, n, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(8) and "Exchange" in plan(100)
    few, many = (sp.range_draws(p, n, ["key"]).filter("draw < 8").select("key", "draw", "value") for n in (8, 100))
    assert few.schema == many.schema and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_more_draws_follow_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert jn.expand_draws(spark.range(10), 40).rdd.getNumPartitions() == 37
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def drawn_rows(df, build, spark):
    """Rows of `df` that `build` and a count of its result read, counted by the tasks."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    build(df.mapInArrow(run, df.schema)).count()
    return seen.value


def test_totals_and_areas_make_the_draws_once(spark):
    from massweave.plans import tables as tb
    parts = spark.createDataFrame([("AB", "c%d" % (i % 3), "small", "Cu", i % 4, float(i)) for i in range(60)], "segment string, category string, size string, element string, draw int, mass double")
    key = ["segment", "category", "size", "element"]
    assert drawn_rows(parts, lambda d: st.summary_stats(st.grand_totals(d, "segment", "category", "size", "element", "mass"), key, "mass", "element"), spark) == 60
    areas = spark.createDataFrame([("b%d" % (i % 3), i % 5, float(i), 2.0 * i, 3.0) for i in range(60)], "brand string, draw int, area_small double, area_medium double, area_large double")
    assert drawn_rows(areas, lambda d: tb.build_area(d, ["brand"], 3), spark) == 60


def test_fused_stats_of_several_values_a_row(skewed):
    pdf, df = skewed
    by, pilot = ["k", "kind"], F.col("id") % 2 == 0
    twin = F.when(F.col("k") == "hot", F.lit("twin"))
    wide = [({"kind": F.lit("w")}, F.col("w")), ({"kind": F.lit("w"), "k": twin}, F.when(twin.isNotNull(), F.col("w") * 1.5)), ({"kind": F.lit("v")}, F.col("v"))]
    long = df.select("id", F.explode(F.array(*[F.struct(labels.get("k", F.col("k")).alias("k"), labels["kind"].alias("kind"), x.alias("x")) for labels, x in wide])).alias("e")).select("id", "e.*").filter("x is not null")
    rows = lambda t: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in t.collect())
    for got, want in zip(hg.fused_stats(df, by, wide, pilot), hg.fused_stats(long, by, "x", pilot)):
        assert rows(got) == rows(want)
    plan = hg.fused_stats(df, by, wide, pilot)[0]
    assert plan.columns == ["k", "kind", "lo", "width", "bin", "count", "under", "over"]
