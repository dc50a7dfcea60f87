"""End-to-end tables, composed from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.functions import draws as dr
from massweave.functions import text as tx
from massweave.operators import cleaning as cl
from massweave.operators import curves as cv
from massweave.operators import groupwise as gw
from massweave.operators import histogram as hg
from massweave.operators import joins as jn
from massweave.operators import reshape as rs
from massweave.operators import sampling as sp
from massweave.operators import sets as ss
from massweave.operators import stats as st
from massweave.plans import literals as lit
from massweave.scale import checked_broadcast, stored

SEGS = ("ab", "cd", "ef")
SIZES = ("small_min", "small_max", "medium_min", "medium_max", "large_min", "large_max")
MOTOR_TYPES = ("step", "dcs", "dcm")


def build_classified(components: DataFrame) -> DataFrame:
    """Component distribution: labels to factors, category, counts scaled per segment."""
    t = components.withColumns({f"f_{s}": tx.factor_lenient(f"label_{s}") for s in SEGS})
    t = rs.scale_by_factor(t, SIZES, {s: f"f_{s}" for s in SEGS})
    t = cl.classify(t, "domain", "component", lit.CLASSIFICATION_RULES, lit.CLASSIFICATION_DEFAULT)
    cols = ["comp_id", "domain", "component", "label_ab", "label_cd", "label_ef", "category", *[f"f_{s}" for s in SEGS],
            *[f"{s}_{m}" for s in SEGS for m in SIZES]]
    return rs.keep_present(rs.insert_after(t, "category", "label_ef"), cols)


def build_motor_distribution(components: DataFrame) -> DataFrame:
    """Motor counts per segment with overrides and totals; rows without motors are dropped."""
    t = components.withColumns({f"f_{s}": tx.factor_lenient(f"label_{s}") for s in SEGS})
    out = {}
    for s in SEGS:
        for b in ("min", "max"):
            out[f"{s}_step_{b}"] = rs.override_or_scale(f"step_{b}", f"{s}_{b}", f"f_{s}")
            for m in ("dcs", "dcm"):
                out[f"{s}_{m}_{b}"] = F.col(f"{m}_{b}") * F.col(f"f_{s}")
    t = rs.fill_zero(t.withColumns(out), list(out))
    totals = {f"{s}_total_{b}": rs.row_total([f"{s}_{m}_{b}" for m in MOTOR_TYPES]) for s in SEGS for b in ("min", "max")}
    t = t.withColumns(totals)
    return cl.any_positive(t, list(totals)).select("comp_id", "domain", *out, *totals)


def build_sensor_counts(rows: DataFrame, presence: DataFrame, volt: DataFrame, n: int, years: tuple[int, int],
                        governed: str, uplifted: str, triple: Sequence[float], pilot: int, seed: int = 42) -> DataFrame:
    """Sensor counts by type, domain and total for every year.

    rows: segment, domain, sensor_type, component, lo, hi, factor (a parameter table);
    presence: component, segment, year, presence; volt: segment, year, share.
    The draws carry no year. Only the governed domain and the uplifted type get
    one, as a delta added to the year-free sums.
    """
    c = F.col
    key = ["segment", "domain", "sensor_type"]
    f = F.when(c("domain") == governed, F.lit(1.0)).otherwise(c("factor"))
    p = dr.with_streams(rows.withColumn("factor", f), seed, key, ["count"])
    d = jn.draws_over(p, n).withColumn("value", dr.uniform(dr.at("u_count"), c("lo") * c("factor"), c("hi") * c("factor")))
    d = d.select(*key, "component", "draw", "value")
    sets = {"SensorType": "sensor_type", "Domain": "domain", "Total": ""}
    base = st.series_totals(d.withColumn("value", F.when(c("domain") == governed, F.lit(0.0)).otherwise(c("value"))), sets, ["segment", "draw"], "value")
    drv = d.filter(c("domain") == governed).join(checked_broadcast(presence), ["component", "segment"]).withColumn("value", c("value") * c("presence"))
    volt = checked_broadcast(dr.with_streams(volt, seed, ["segment"], ["volt", "uplift"]))
    up = d.filter((c("sensor_type") == uplifted) & (c("domain") != governed)).join(volt, "segment")
    up = dr.draw_uniforms(up, {"_u8": ("u_volt", "draw"), "_uu": ("u_uplift", "draw")})
    upl = dr.triangular("_uu", *[F.lit(float(x)) for x in triple])
    up = up.withColumn("value", c("value") * F.when(c("_u8") < c("share"), upl - 1.0).otherwise(F.lit(0.0)))
    cols = [*key, "draw", "year", "value"]
    delta = st.series_totals(drv.select(*cols).unionByName(up.select(*cols)), sets, ["segment", "draw", "year"], "value")
    s = cv.broadcast_year(base, delta, ["segment", "draw", "level", "name"], "value", *years)
    return _year_stats(s, ["segment", "level", "name", "year"], "value", pilot)


def _year_stats(s: DataFrame, key: Sequence[str], val: str, pilot: int | None = None, n: str = "n") -> DataFrame:
    """Two passes over the draws: moments and range together, then the bin counts."""
    m = hg.moments_and_range(s, key, val, None if pilot is None else F.col("draw") < pilot)
    h = hg.hist_acc(s, key, val, m).persist()              # read by the percentiles and the mode
    return hg.year_stats(h, m.select(*key, F.col("n").alias(n), "mean", "std"), key)


def build_sensor_elements(masses: DataFrame) -> DataFrame:
    """Element mass per segment and element, and per sensor type with its share of the variance: all ten statistics.

    masses: segment, sensor_type, comp_id, element, draw, value.
    """
    fine = masses.groupBy("segment", "element", "sensor_type", "draw").agg(F.sum("value").alias("value"))
    sets = fine.groupingSets([[F.col(c) for c in ("segment", "element", "sensor_type", "draw")], [F.col(c) for c in ("segment", "element", "draw")]],
                             *[F.col(c) for c in ("segment", "element", "sensor_type", "draw")]).agg(F.sum("value").alias("value"))
    s = stored(sets.withColumn("sensor_type", F.coalesce("sensor_type", F.lit("ALL"))), "sensor_masses")
    t = st.summary_stats(s, ["segment", "element", "sensor_type"], "value").withColumn("var", F.col("std") * F.col("std"))
    t = gw.with_group(t, ["segment", "element"], {"_tv": F.max(F.when(F.col("sensor_type") == "ALL", F.col("var")))}, bounded=True)
    loc = masses.groupBy("segment", "element", "sensor_type").agg(F.countDistinct("comp_id").alias("n_locations"))
    t = gw.join_on(t, loc, ["segment", "element", "sensor_type"])
    return t.withColumn("variance_share", F.col("var") / F.nullif(F.col("_tv"), F.lit(0.0))).drop("_tv", "var")


def build_area(areas: DataFrame, by: Sequence[str], pilot: int) -> DataFrame:
    """Board area per group: per size and in total, with variance share and correlation.

    The draws of the components are made once; their sums, a row per group and
    draw, are written and read by every statistic.
    """
    sizes = ["small", "medium", "large"]
    t = stored(areas.groupBy(*by, "draw").agg(*[F.sum(f"area_{s}").alias(s) for s in sizes]), "areas")
    t = t.withColumn("total", F.col("small") + F.col("medium") + F.col("large"))
    long = t.unpivot([*by, "draw"], [*sizes, "total"], "size", "area")
    out = _year_stats(long, [*by, "size"], "area", pilot)
    vs = st.variance_share(t, by, sizes, "total").withColumnsRenamed({"part": "size", "share": "variance_share"})
    co = st.corr_with(t, by, sizes, "total").withColumnRenamed("series", "size")
    return gw.join_on(gw.join_on(out, vs, [*by, "size"]), co, [*by, "size"])


def build_year_scale(static: DataFrame, dynamic: DataFrame, by: Sequence[str], draws: DataFrame, years: tuple[int, int], base_year: int) -> DataFrame:
    """Mean area per key and year, and its ratio to the base year; `draws` are counted."""
    m = st.mean_by_year(static, dynamic, by, draws, *years)
    return gw.index_to_base(m, by, "year", "mean", base_year, "scale")


def build_motor_years(draws: DataFrame, headroom: Mapping[str, Sequence[float]], weights: Mapping[str, float], years: Sequence[int],
                      base_year: int, pinned: str | None = None, seed: int = 42) -> DataFrame:
    """Motor count and mass per segment and year: base draws times a growth curve held per vehicle.

    draws: segment, draw, count, mass. Scenario, headroom and tau are drawn once
    per vehicle, so a vehicle stays in one world on one trajectory.
    """
    k = lambda v: dr.keyed_uniform(seed, v, "segment", "draw")
    c = F.col
    scen = dr.pick("_us", dict(weights), pinned)
    tri = {n: [F.lit(float(x)) for x in t] for n, t in headroom.items()}
    part = lambda i: F.coalesce(*[F.when(c("scenario") == n, t[i]) for n, t in tri.items()])
    d = draws.withColumns({"_us": k("scenario"), "_uh": k("headroom"), "_ut": k("tau")}).withColumn("scenario", scen)
    d = d.withColumns({"_a": part(0), "_b": part(1), "_c": part(2)})
    d = d.withColumns({"h": dr.triangular("_uh", "_a", "_b", "_c"), "tau": dr.triangular("_ut", *[F.lit(x) for x in lit.MOTOR_TAU_Y])})
    d = d.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    d = d.withColumn("_g", dr.saturating_growth("h", "tau", "year", base_year))
    q = F.explode(F.array(F.struct(F.lit("count").alias("quantity"), (c("count") * c("_g")).alias("value")),
                          F.struct(F.lit("mass").alias("quantity"), (c("mass") * c("_g")).alias("value"))))
    s = d.select("segment", "draw", "year", q.alias("q")).select("segment", "draw", "year", "q.*")
    key = ["segment", "quantity", "year"]
    m = st.moments(s, key, "value").select(*key, "n", "mean", "std")
    return gw.join_on(m, st.exact_percentiles(s, key, "value", {"p025": 2.5, "p50": 50, "p975": 97.5}), key)


def build_stream_elements(mass: DataFrame, mix: DataFrame, by: Sequence[str], stream: str) -> DataFrame:
    """Element mass of one material stream: mass draw times composition draw, paired on the draw id."""
    j = mass.join(mix, [*by, "draw"]).withColumn("elem_mass", F.col("value") * F.col("fraction"))
    key = [*by, "element"]
    m = j.groupBy(*key).agg(F.avg("elem_mass").alias("mean_mass_kg"), F.stddev_pop("elem_mass").alias("std_mass_kg"), F.avg("fraction").alias("mean_fraction"))
    p = st.exact_percentiles(j, key, "elem_mass", {"p05_mass_kg": 5, "p50_mass_kg": 50, "p95_mass_kg": 95})
    return gw.join_on(m, p, key).withColumn("stream", F.lit(stream))


def wiring_rows(fleet: DataFrame, cats: DataFrame, volt: DataFrame, uplift: Mapping[str, float],
                calibration: Mapping[str, float], base_year: int, seed: int = 42) -> DataFrame:
    """Length and copper of every vehicle, category and year, with `taller`, the vehicle's factor in a derived segment.

    fleet: segment, vehicle, pilot, year, state, shares of the three states,
    length_m (sensor wiring); cats: category, ix, grp, base_m, sdv, g_lo, g_hi; volt:
    segment, year, share, base (the share at the base year).

    Sensor categories follow the sensor length, anchored by the ensemble mean
    and split by base length; all others follow the architecture state, anchored
    by the state shares of the base year. A vehicle is hashed once, a category is
    the draw id of its streams. After the segment means, every step is row
    arithmetic on the vehicle's own rows: no shuffle.
    """
    c, k = F.col, dr.keyed_uniform
    pick = lambda m: F.coalesce(*[F.when(c("segment") == s, F.lit(float(v))) for s, v in m.items()])
    at_base = lambda x: F.avg(F.when(c("year") == base_year, c(x)))
    means = {"_lm": at_base("length_m"), **{f"b_{s}": at_base(s) for s in lit.ARCH_STATES}}
    t = gw.with_group(fleet.select("segment", "vehicle", "pilot", "year", "state", "length_m", *lit.ARCH_STATES), ["segment"], means).drop(*lit.ARCH_STATES)
    t = t.join(volt, ["segment", "year"]).withColumn("hv", F.lit(1.0))
    t = sp.apply_reduction(t, "hv", c("share"), c("base"), lit.HV_CU_REDUCTION, ["vehicle"], seed).drop("share", "base")
    # one row per vehicle: what is drawn per category does not depend on the year
    t = t.groupBy("segment", "vehicle", "pilot").agg(F.collect_list(F.struct("year", "state", "length_m", "hv")).alias("_y"), *[F.first(m).alias(m) for m in means])
    t = t.withColumn("_ud", k(seed, "depth", "vehicle"))
    t = t.withColumns({"depth": dr.triangular("_ud", F.lit(0.4), F.lit(0.7), F.lit(1.0)),
                       "shared": dr.normal(k(seed, "veh1", "vehicle"), k(seed, "veh2", "vehicle"), 1.0, lit.CV_VEHICLE)})
    t = t.withColumn("_uh", k(seed, "height", "vehicle")).withColumn("taller", F.lit(1.0) + dr.triangular("_uh", *[F.lit(float(x)) for x in lit.HEIGHT_ADDER])).drop("_uh")
    t = dr.with_streams(t, seed, ["vehicle"], ["cat1", "cat2", "gauge"])
    t = t.crossJoin(checked_broadcast(cats))                        # the categories of one harness
    t = dr.draw_uniforms(t, {"_c1": ("u_cat1", "ix"), "_c2": ("u_cat2", "ix"), "_ug": ("u_gauge", "ix")})

    adas = c("grp") == "ADAS / Sensor"
    cv_ind = (lit.CV_CATEGORY ** 2 - lit.CV_VEHICLE ** 2) ** 0.5
    own = dr.normal("_c1", "_c2", 1.0, cv_ind)
    gauge = dr.triangular("_ug", c("g_lo"), (c("g_lo") + c("g_hi")) / 2.0, F.greatest(c("g_hi"), c("g_lo") + 1e-9))
    deep = F.when(c("sdv") < 1.0, F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(1.0) - c("sdv")) * c("depth"))).otherwise(c("sdv"))
    t = t.select("segment", "vehicle", "pilot", "taller", "category", "grp", "_lm", *[f"b_{s}" for s in lit.ARCH_STATES],
                 (c("base_m") * pick(calibration) * F.greatest(c("shared") * own, F.lit(lit.VARIABILITY_FLOOR))).alias("metres"),
                 (gauge * F.lit(tx.COPPER_DENSITY_G_PER_CM3)).alias("rate"),
                 F.when(adas, F.lit(1.0)).otherwise(pick(uplift)).alias("l0"), F.lit(1.0).alias("l1"), deep.alias("l2"), F.explode("_y").alias("_y"))
    t = t.select("*", "_y.*").withColumn("fac", F.element_at(F.array("l0", "l1", "l2"), c("state") + 1))
    t = cv.anchor_to_base(t, "fac", base_year, "expected", shares={f"b_{s}": f"l{i}" for i, s in enumerate(lit.ARCH_STATES)})
    factor = F.when(adas, c("length_m") / F.greatest(c("_lm"), F.lit(1e-9))).otherwise(c("fac"))
    t = t.withColumn("length", F.greatest(c("metres") * factor, F.lit(0.0)))
    rate = c("rate") * F.when(c("grp") == "HV Power", c("hv")).otherwise(F.lit(1.0))
    return t.select("segment", "vehicle", "pilot", "taller", "year", "category", "grp", "length", (c("length") * rate / 1000.0).alias("copper"))


def with_pilot(fleet: DataFrame, base_year: int, n: int = 1000) -> DataFrame:
    """`fleet` with `pilot`: the vehicle is one of the `n` of its segment with the smallest id. They set bin ranges, nothing else."""
    first = cl.first_k(fleet.filter(F.col("year") == base_year).select("segment", "vehicle"), ["segment"], ["vehicle"], n)
    return fleet.join(F.broadcast(first.withColumn("pilot", F.lit(True))), ["segment", "vehicle"], "left").withColumn("pilot", F.coalesce("pilot", F.lit(False)))   # n rows a segment


def build_wiring(rows: DataFrame, derived: Mapping[str, str]) -> DataFrame:
    """Wiring statistics by category, group and total, for base and derived segments.

    Category rows are series values as they stand. Groups and totals are summed
    per vehicle first (the categories of a vehicle come from one task, so most
    of that happens before the shuffle), and the derived segments, a factor per
    vehicle (`taller`), are applied to the sums. A row is both metrics of its
    segment and of the derived one, four values. One pass over the values of all
    vehicles gives moments and bins; the pilot vehicles set the bins before.
    """
    c = F.col
    key = ["segment", "vehicle", "pilot", "taller", "year"]
    grp = rows.groupBy(*key, "grp").agg(F.sum("length").alias("length"), F.sum("copper").alias("copper"))
    sets = [[c(x) for x in (*key, "grp")], [c(x) for x in key]]
    tot = grp.groupingSets(sets, *[c(x) for x in (*key, "grp")]).agg(F.sum("length").alias("length"), F.sum("copper").alias("copper"))
    name = F.coalesce("grp", F.lit("TOTAL"))
    tot = tot.select(*key, F.when(c("grp").isNull(), "Total").otherwise("Group").alias("level"), name.alias("code"), name.alias("functional_group"), "length", "copper")
    cat = rows.select(*key, F.lit("Category").alias("level"), c("category").alias("code"), c("grp").alias("functional_group"), "length", "copper")
    twin = F.try_element_at(F.create_map(*[F.lit(x) for kv in derived.items() for x in kv]), c("segment"))
    values = []
    for metric, v in (("Length (m)", "length"), ("Cu (kg)", "copper")):
        values += [({"metric": F.lit(metric)}, c(v)), ({"metric": F.lit(metric), "segment": twin}, F.when(twin.isNotNull(), c(v) * c("taller")))]
    by = ["level", "segment", "code", "functional_group", "metric", "year"]
    hist, m = hg.fused_stats(cat.unionByName(tot), by, values, c("pilot"))
    return hg.year_stats(hist, m.select(*by, c("n").alias("n_iter"), "mean", "std"), by)


COMPOSITION = ["Year", "Segment", "Domain", "Component_Type", "Element", "Mass_g_per_vehicle", "P2_5_g", "P97_5_g", "Basis",
               "Band_meaning", "Histogram_File"]


def _part(df, year, seg, ctype, element, mean, lo, hi, basis, band, hist):
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(c(year).cast("int").alias("Year"), c(seg).alias("Segment"), c(ctype).alias("Component_Type"), c(element).alias("Element"),
                     c(mean).alias("Mass_g_per_vehicle"), c(lo).alias("P2_5_g"), c(hi).alias("P97_5_g"), F.lit(basis).alias("Basis"),
                     F.lit(band).alias("Band_meaning"), c(hist).alias("Histogram_File"))


def build_composition(wiring: DataFrame, pcb: DataFrame, motor_years: DataFrame, motor_elements: DataFrame, sensor_counts: DataFrame,
                      sensor_comp: DataFrame, base_year: int) -> DataFrame:
    """One long table of grams per unit by year, segment, domain, component type and element.

    wiring: level, metric, segment, code, year, mean, lo, hi (kg); pcb: segment,
    category, size, element, year, mean, lo, hi (g); motor_years: segment, year,
    mean, lo, hi; motor_elements: segment, motor, element, mean_mass_kg;
    sensor_counts: segment, sensor_type, year, mean, lo, hi; sensor_comp:
    sensor_type, element, mg.
    """
    c = F.col
    g = lambda x: tx.convert_unit(c(x), "kg", "g")
    w = wiring.filter((c("metric") == "Cu (kg)") & (c("level") == "Group") & c("segment").isin("AB", "CD", "EF"))
    w = _part(w, "year", "segment", "code", F.lit("Cu"), g("mean"), g("lo"), g("hi"), "modelled", "full model band", F.lit("wiring/histograms"))
    p = _part(pcb, "year", "segment", F.concat("category", F.lit(" / "), "size"), "element", "mean", "lo", "hi", "modelled", "full model band",
              F.concat(F.lit("pcb/histogram_"), "segment", F.lit("_"), "category", F.lit("_"), "size", F.lit("_area")))
    s = gw.at_base(motor_years, ["segment"], "year", "mean", base_year, "_b")
    s = s.select("segment", "year", *[(c(x) / c("_b")).alias(f"s_{x}") for x in ("mean", "lo", "hi")])
    m = motor_elements.filter(c("element") != "TotalMass").join(s, "segment").withColumn("_g", g("mean_mass_kg"))
    m = _part(m, "year", "segment", "motor", "element", c("_g") * c("s_mean"), c("_g") * c("s_lo"), c("_g") * c("s_hi"), "scaled",
              "motor count/mass only; composition fixed", F.concat(F.lit("motors/hist_"), "segment", F.lit("_"), "motor", F.lit("_mass")))
    x = jn.compose(sensor_counts, sensor_comp.withColumn("mg", tx.convert_unit("mg", "mg", "g")), ["sensor_type"], ["mean", "lo", "hi"], "mg")
    x = _part(x, "year", "segment", "sensor_type", "element", "mean", "lo", "hi", "modelled", "sensor count only; composition fixed", F.lit("sensors/year_stats"))
    t = ss.union_tagged({"Wiring": w, "PCB": p, "Motors": m, "Sensors": x}, "Domain")
    keys = [k for k in COMPOSITION if k not in ("Mass_g_per_vehicle", "P2_5_g", "P97_5_g")]
    t = st.collapse(t, keys, ["Mass_g_per_vehicle", "P2_5_g", "P97_5_g"])
    t = st.clip_band(t, "Mass_g_per_vehicle", "P2_5_g", "P97_5_g")
    return t.select(*COMPOSITION, "clipped")


def build_consolidated(src: DataFrame, stats: DataFrame, on: Sequence[str], order: Sequence[str], template: Sequence[str],
                       constants: Mapping[str, str], text_cols: Sequence[str]) -> DataFrame:
    """Template table: statistics attached by key, blanks as N/A, columns in template order."""
    t = jn.attach_stats(src, stats, on, order)
    return rs.project_like(rs.na_fill(t, text_cols, constants), template)


def build_tier_table(shares: DataFrame) -> DataFrame:
    """Tier shares per segment and year, their sum, and the derived ranging sensors per vehicle."""
    w = rs.to_wide(shares, ["segment", "year"], "tier", "share", lit.TIERS)
    w = rs.fill_zero(w, lit.TIERS)
    total = rs.row_total(lit.TIERS)
    ranging = None
    for t in lit.TIERS:
        e = F.col(t) * F.lit(lit.TIER_RANGING[t])
        ranging = e if ranging is None else ranging + e
    return w.withColumns({"sum": total, "ranging_derived": ranging})


#: Streams whose named element takes what the others leave.
BALANCED = ("Electrical Steel", "Cast Fe Steel")


def stream_weights(motors: Sequence[str], segments: Sequence[str]) -> list[tuple[str, str, str, str, float]]:
    """(stream, motor, segment, grade, weight): copper and cast steel alike everywhere, steel by segment, magnets by motor and segment."""
    out = []
    for m in motors:
        for s in segments:
            out += [("Copper", m, s, g, w) for g, w in lit.COPPER_WEIGHTS.items()]
            out += [("Electrical Steel", m, s, g, w) for g, w in lit.STEEL_WEIGHTS[s].items()]
            out += [("NdFeB", m, s, g, w) for g, w in lit.MAGNET_WEIGHTS[m][s].items()]
            out.append(("Cast Fe Steel", m, s, "DC01", 1.0))
    return out


def build_streams(mass: DataFrame, grades: DataFrame, weights: DataFrame, n: int, balance: str = "Fe", seed: int = 42) -> DataFrame:
    """Element mass of all material streams by motor type and, draw by draw, in total (motor 'ALL').

    mass: stream, motor, segment, draw, value (kg); grades: grade, element, lo,
    hi, in parts of one, or of a million where the element's name ends in `_ppm`;
    weights: stream, motor, segment, grade, weight. A draw's composition is the
    weighted mean of its grades' draws; in `BALANCED` streams the balance element
    takes the rest, so their parts add up to one. Mass and composition are paired
    on the draw id. `TotalMass` is the stream itself.
    """
    c, by = F.col, ["stream", "motor", "segment"]
    ppm = F.when(c("element").endswith("_ppm"), F.lit(1e-6)).otherwise(F.lit(1.0))
    g = grades.select("grade", F.regexp_replace("element", "_ppm$", "").alias("element"), (c("lo") * ppm).alias("lo"), (c("hi") * ppm).alias("hi"))
    mix = sp.grade_mix(g, weights, n, by, seed, balance=None)
    rest = mix.filter(c("stream").isin(*BALANCED)).groupBy(*by, "draw").agg(
        F.least(F.greatest(F.lit(1.0) - F.sum("fraction"), F.lit(0.0)), F.lit(1.0)).alias("fraction"))
    mix = mix.unionByName(rest.withColumn("element", F.lit(balance))).unionByName(
        weights.select(*by).distinct().withColumns({"draw": F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "element": F.lit("TotalMass"), "fraction": F.lit(1.0)}))
    one = mass.join(mix, [*by, "draw"]).select(*by, "element", "draw", (c("value") * c("fraction")).alias("elem_mass"), c("value").alias("stream_mass"))
    total = one.groupBy("stream", F.lit("ALL").alias("motor"), "segment", "element", "draw").agg(F.sum("elem_mass").alias("elem_mass"), F.sum("stream_mass").alias("stream_mass"))
    t = stored(one.unionByName(total).withColumn("fraction", c("elem_mass") / F.nullif(c("stream_mass"), F.lit(0.0))), "streams")
    key = [*by, "element"]
    m = t.groupBy(*key).agg(F.count("*").alias("n"), F.avg("elem_mass").alias("mean_mass_kg"), F.stddev_pop("elem_mass").alias("std_mass_kg"), F.avg("fraction").alias("mean_fraction"))
    return gw.join_on(m, st.exact_percentiles(t, key, "elem_mass", {"p05_mass_kg": 5, "p50_mass_kg": 50, "p95_mass_kg": 95}), key)
