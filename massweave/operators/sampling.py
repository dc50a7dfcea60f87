"""Draw columns: parameters to keyed draws.

Expansion is narrow (a row makes its draws in its own task) and sums per draw
combine map-side before they move. Nothing here depends on how rows are split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.functions import draws as dr
from massweave.operators.joins import expand_draws
from massweave.plans import literals as lit
from massweave.scale import checked_broadcast


def range_draws(df: DataFrame, n: int, keys: Sequence[str], lo: str = "lo", hi: str = "hi", factor: str = "factor",
                governed: Column | None = None, presence: str | None = None, seed: int = 42, var: str = "count",
                out: str = "value") -> DataFrame:
    """U(lo x factor, hi x factor) per row and draw.

    Rows governed by a driver are drawn at factor 1 and scaled by the driver's
    presence afterwards: a static factor of 0 would lose them for good.
    """
    f = F.col(factor) if governed is None else F.when(governed, F.lit(1.0)).otherwise(F.col(factor))
    t = expand_draws(dr.with_streams(df, seed, keys, [var]).withColumn("_f", f), n)
    x = dr.uniform(dr.at(f"u_{var}"), F.col(lo) * F.col("_f"), F.col(hi) * F.col("_f"))
    if governed is not None:
        x = x * F.when(governed, F.col(presence)).otherwise(F.lit(1.0))
    return t.withColumn(out, x).drop("_f", f"u_{var}")


def area_draws(df: DataFrame, n: int, keys: Sequence[str], sizes: Mapping[str, tuple], seed: int = 42) -> DataFrame:
    """count x length x width per size class; nothing where the count is not positive.

    `sizes` maps a class to (lo column, hi column, length triple, width triple).
    """
    names = [f"{s}_{v}" for s in sizes for v in ("n", "l", "w")]
    t = expand_draws(df, n, per_row=lambda d: dr.with_streams(d, seed, keys, names))
    t = dr.draw_uniforms(t, {f"_{v}": (f"u_{v}", "draw") for v in names})
    t = t.withColumns({f"n_{s}": dr.uniform(f"_{s}_n", F.coalesce(F.col(a), F.lit(0.0)), F.coalesce(F.col(b), F.lit(0.0)))
                       for s, (a, b, _, _) in sizes.items()})
    tri = lambda v, p: dr.triangular(f"_{v}", *[F.lit(float(x)) for x in p])
    t = t.withColumns({f"area_{s}": F.when(F.col(f"n_{s}") > 0, F.col(f"n_{s}") * tri(f"{s}_l", ln) * tri(f"{s}_w", wd))
                       .otherwise(F.lit(0.0)) for s, (_, _, ln, wd) in sizes.items()})
    return t.drop(*[f"_{v}" for v in names])


def count_times_mass(df: DataFrame, composition: DataFrame, on: Sequence[str], n: int, keys: Sequence[str],
                     element: str = "element", seed: int = 42) -> DataFrame:
    """Count draw times an independent mass draw of every element of the row's type.

    Both draws share the draw id. The count stream is keyed on the row, the mass
    stream on the row and the element.
    """
    j = dr.with_streams(df, seed, keys, ["count"]).join(composition.filter(F.col("mass_hi") > 0), list(on))
    j = j.withColumn("u_mass", dr.stream(seed, "mass", *keys, element))
    t = dr.draw_uniforms(expand_draws(j, n), {"_uc": ("u_count", "draw"), "_um": ("u_mass", "draw")})
    m = dr.triangular("_um", "mass_lo", "mass_mode", "mass_hi")
    return t.withColumn("value", dr.uniform("_uc", "lo", "hi") * m).drop("_uc", "_um")


def apply_uplift(df: DataFrame, target: Column, share: Column, triple: Sequence[float], vehicle: Sequence[str],
                 val: str = "value", seed: int = 42) -> DataFrame:
    """Selected rows times (1 + flag x (uplift - 1)); flag and uplift belong to the vehicle."""
    t = df.withColumns({"_uu": dr.keyed_uniform(seed, "uplift", *vehicle), "_uv": dr.keyed_uniform(seed, "volt", *vehicle)})
    up = dr.triangular("_uu", *[F.lit(float(x)) for x in triple])
    return t.withColumn(val, F.when(target, dr.uplift(val, dr.bernoulli("_uv", share), up)).otherwise(F.col(val))).drop("_uu", "_uv")


def apply_reduction(df: DataFrame, rate: str, share: Column, base_share: Column, triple: Sequence[float],
                    vehicle: Sequence[str], seed: int = 42) -> DataFrame:
    """Unit rate x (1 - red x flag(year)), over the vehicle's own base-year value."""
    t = df.withColumns({"_ur": dr.keyed_uniform(seed, "red", *vehicle), "_u": dr.keyed_uniform(seed, "volt", *vehicle)})
    t = t.withColumn("_red", dr.triangular("_ur", *[F.lit(float(x)) for x in triple])).drop("_ur")
    now = dr.reduction(F.lit(1.0), F.col("_u") < share, "_red")
    base = dr.reduction(F.lit(1.0), F.col("_u") < base_share, "_red")
    return t.withColumn(rate, F.col(rate) * now / F.greatest(base, F.lit(1e-12))).drop("_red", "_u")


def state_factor(state, conventional, transitional, sdv, depth) -> Column:
    """Level of the drawn state; depth only acts on categories that shrink."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    deep = F.when(c(sdv) < 1.0, F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(1.0) - c(sdv)) * c(depth))).otherwise(c(sdv))
    return F.element_at(F.array(c(conventional), c(transitional), deep), c(state) + 1)


def variability(vehicle: Sequence[str], category: Sequence[str], seed: int = 42) -> Column:
    """Shared times independent spread, floored."""
    k = dr.keyed_uniform
    cv_ind = (lit.CV_CATEGORY ** 2 - lit.CV_VEHICLE ** 2) ** 0.5
    veh = dr.normal(k(seed, "veh1", *vehicle), k(seed, "veh2", *vehicle), 1.0, lit.CV_VEHICLE)
    cat = dr.normal(k(seed, "cat1", *vehicle, *category), k(seed, "cat2", *vehicle, *category), 1.0, cv_ind)
    return F.greatest(veh * cat, F.lit(lit.VARIABILITY_FLOOR))


def tier_counts(spark) -> DataFrame:
    """Sensors per segment and tier index, one triangular triple per type (a fixed table of 15 rows)."""
    rows = []
    for (seg, tier), v in lit.TIER_COUNTS.items():
        row = [seg, lit.TIERS.index(tier)]
        for i in range(len(lit.TIER_COUNT_TYPES)):
            lo, hi = float(v[2 * i]), float(v[2 * i + 1])
            row += [lo, (lo + hi) / 2, max(hi, lo + 1e-9)]
        rows.append(tuple(row))
    cols = ", ".join(f"n_{s}_{b} double" for s in lit.TIER_COUNT_TYPES for b in ("lo", "mode", "hi"))
    return spark.createDataFrame(rows, f"segment string, tier int, {cols}")


def sensor_streams(vehicles: DataFrame, vehicle: str = "vehicle", seed: int = 42) -> DataFrame:
    """Hash a vehicle once per sensor type, before its years are laid out."""
    return vehicles.withColumns({f"u_{v}_{s}": dr.stream(seed, v, vehicle, F.lit(s)) for s in lit.TIER_COUNT_TYPES for v in ("sensors", "metres")})


def scenario_multiplier(u: Column, at: Column, scenarios: Mapping[str, tuple[Sequence[float], float]] = lit.SCENARIOS,
                        years: Sequence[float] = lit.SCENARIO_YEARS, pinned: str | None = None) -> Column:
    """Multiplier of the scenario that `u` picks by weight (or the pinned one) at the position `at` on its years.

    Each scenario's curve is an array, linear between its years and flat
    outside, so a draw keeps its scenario over all years and no row is joined.
    """
    name = dr.pick(u, {n: w for n, (_, w) in scenarios.items()}, pinned)
    curves = F.create_map(*[x for n, (v, _) in scenarios.items() for x in (F.lit(n), F.array(*[F.lit(float(y)) for y in v]))])
    curve = F.element_at(curves, name)
    out = curve[len(years) - 1]
    for i in reversed(range(len(years) - 1)):
        f = (at - F.lit(float(years[i]))) / F.lit(float(years[i + 1] - years[i]))
        out = F.when(at < F.lit(float(years[i + 1])), curve[i] + F.greatest(f, F.lit(0.0)) * (curve[i + 1] - curve[i])).otherwise(out)
    return out


def zonal_multiplier(u: str, state: Column, triple: Sequence[float] = lit.ZONAL_METRES) -> Column:
    """Metres per sensor by architecture: 1 conventional, half of the drawn saving transitional, all of it zonal."""
    f = dr.triangular(u, *[F.lit(float(x)) for x in triple])
    return F.when(state == 0, F.lit(1.0)).when(state == 1, F.lit(1.0) - (F.lit(1.0) - f) / F.lit(2.0)).otherwise(f)


def sensor_length(states: DataFrame, counts: DataFrame, metres: DataFrame) -> DataFrame:
    """Metres of sensor wiring per vehicle and year, as row arithmetic.

    `states`: one row per vehicle and year with segment, tier, mult, arch_mult,
    equipped and the sensor streams; `metres`: a row per segment with a triple
    per sensor type. Count and metres are drawn once per vehicle and held over
    years. The types are columns, so nothing is multiplied out or shuffled.
    """
    j = states.join(F.broadcast(counts), ["segment", "tier"]).join(metres, "segment")
    types = lit.TIER_COUNT_TYPES
    j = dr.draw_uniforms(j, {**{f"_un_{s}": (f"u_sensors_{s}", "tier") for s in types}, **{f"_um_{s}": (f"u_metres_{s}", F.lit(0)) for s in types}})
    tri = lambda u, p, s: dr.triangular(f"{u}_{s}", *[f"{p}_{s}_{b}" for b in ("lo", "mode", "hi")])
    j = j.withColumns({f"_n_{s}": tri("_un", "n", s) for s in types}).withColumns({f"_m_{s}": tri("_um", "m", s) for s in types})
    total = None
    for s in types:
        n = F.col(f"_n_{s}") * F.col("equipped") if s == "lidar" else F.col(f"_n_{s}")
        e = n * F.col("mult") * F.col(f"_m_{s}") * F.col("arch_mult")
        total = e if total is None else total + e
    drop = [f"{p}_{s}_{b}" for p in ("n", "m") for s in types for b in ("lo", "mode", "hi")]
    return j.withColumn("length_m", total).drop(*drop, *[f"_{p}_{s}" for p in ("n", "m", "un", "um") for s in types])


def derive_segments(df: DataFrame, mapping: Mapping[str, str], vals: Sequence[str], vehicle: Sequence[str],
                    triple: Sequence[float] = lit.HEIGHT_ADDER, seed: int = 42) -> DataFrame:
    """Add the derived segments: the base segment times 1 + tri(...) per vehicle."""
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    add = dr.triangular("_uh", *[F.lit(float(x)) for x in triple])
    # one pass: every row emits itself and, where it has one, its derived twin
    own = F.struct(F.col("segment").alias("s"), F.lit(1.0).alias("f"))
    twin = F.struct(F.try_element_at(names, F.col("segment")).alias("s"), (F.lit(1.0) + F.col("_add")).alias("f"))
    t = df.withColumn("_uh", dr.keyed_uniform(seed, "height", *vehicle)).withColumn("_add", add).withColumn("_e", F.explode(F.array(own, twin))).filter("_e.s IS NOT NULL")
    return t.withColumns({"segment": F.col("_e.s"), **{v: F.col(v) * F.col("_e.f") for v in vals}}).select(*df.columns)


def calibrated_presence(state: Column, t: Sequence[Column], base_shares: Sequence[Column], observed: Column,
                        drawn_observed: Column) -> Column:
    """Presence in the drawn state times the calibrated conditional q.

    q = drawn observation / expected base-year presence, in [0, 1]. An observed
    zero below what the label scale resolves means "not yet", so q is 1 there.
    """
    c25 = None
    for a, b in zip(t, base_shares):
        c25 = a * b if c25 is None else c25 + a * b
    q = F.when(c25 <= 1e-12, F.lit(1.0)).when((observed <= 1e-12) & (c25 < lit.SCALE_RESOLUTION), F.lit(1.0)).otherwise(
        drawn_observed / F.greatest(c25, F.lit(1e-12)))
    return F.element_at(F.array(*t), state + 1) * F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))


def group_average_draws(df: DataFrame, n: int, group: Sequence[str], sub: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Average over the sub-segments of a group, per draw.

    A row with hi <= 0 adds nothing, and a sub-segment with no such row is left
    out. The mean is taken as sum over (number of contributing sub-segments),
    which is one aggregation per draw.
    """
    d = df.filter(F.col("hi") > 0)
    subs = d.groupBy(*group).agg(F.countDistinct(sub).alias("_subs"))
    t = expand_draws(dr.with_streams(d, seed, keys, ["count"]), n)
    t = t.withColumn("_x", dr.uniform(dr.at("u_count"), "lo", "hi"))
    s = t.groupBy(*group, "draw").agg(F.sum("_x").alias("_s"))
    return s.join(checked_broadcast(subs), list(group)).select(*group, "draw", (F.col("_s") / F.col("_subs")).alias("count"))


def mass_draws(count, unit_g, extra_g, flag) -> Column:
    """count x (unit + flag x extra), in kg."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(count) * (c(unit_g) + F.when(c(flag), c(extra_g)).otherwise(F.lit(0.0))) / F.lit(1000.0)


def material_draws(df: DataFrame, n: int, keys: Sequence[str], materials: Sequence[str], mass: str = "mass",
                   seed: int = 42) -> DataFrame:
    """Triangular ratios normalised to 1 per draw, times the total mass.

    The parameters of all materials sit in the row (`<m>_lo/_mode/_hi`), so the
    normalisation is row arithmetic: no window and no shuffle over the draws.
    """
    t = expand_draws(dr.with_streams(df, seed, keys, materials), n)
    t = dr.draw_uniforms(t, {f"_u_{m}": (f"u_{m}", "draw") for m in materials})
    t = t.withColumns({f"_r_{m}": dr.triangular(f"_u_{m}", f"{m}_lo", f"{m}_mode", f"{m}_hi") for m in materials})
    total = None
    for m in materials:
        total = F.col(f"_r_{m}") if total is None else total + F.col(f"_r_{m}")
    t = t.withColumn("_t", F.when(total == 0, F.lit(1.0)).otherwise(total))
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("material"), (F.col(f"_r_{m}") / F.col("_t")).alias("ratio")) for m in materials]))
    drop = [f"_u_{m}" for m in materials] + [f"_r_{m}" for m in materials] + ["_t"] + [f"{m}_{s}" for m in materials for s in ("lo", "mode", "hi")]
    t = t.withColumn("_p", parts)
    return t.select("*", "_p.*").drop("_p", *drop).withColumn("mass_kg", F.col(mass) * F.col("ratio"))


def grade_mix(grades: DataFrame, weights: DataFrame, n: int, by: Sequence[str], seed: int = 42,
              balance: str | None = "Fe") -> DataFrame:
    """Weighted mean composition over grades per draw; the balance element takes the rest.

    `grades`: grade, element, lo, hi. `weights`: by..., grade, weight, normalised
    to sum to 1 per group here.
    """
    tot = weights.groupBy(*by).agg(F.sum("weight").alias("_w"))
    w = weights.join(checked_broadcast(tot), list(by)).withColumn("weight", F.col("weight") / F.col("_w")).drop("_w")
    j = w.join(grades, "grade")
    t = expand_draws(dr.with_streams(j, seed, [*by, "grade", "element"], ["grade"]), n)
    x = F.sum(F.col("weight") * dr.uniform(dr.at("u_grade"), "lo", "hi"))
    mix = t.groupBy(*by, "draw", "element").agg(x.alias("fraction"))
    if balance is None:
        return mix
    rest = mix.groupBy(*by, "draw").agg(F.sum("fraction").alias("_s")).select(
        *by, "draw", F.lit(balance).alias("element"),
        F.least(F.greatest(F.lit(1.0) - F.col("_s"), F.lit(0.0)), F.lit(1.0)).alias("fraction"))
    return mix.unionByName(rest)


def resample(hist: DataFrame, by: Sequence[str], n: int, left: str = "bin_left", right: str = "bin_right",
             count: str = "count", within: bool = False, seed: int = 42, slices: int = 1024) -> DataFrame:
    """Draws from a histogram: at bin centres, or uniform within the bin.

    Bins become intervals of cumulative count; both sides are cut into equal
    slices of (0, 1), so the range condition is an equi-join on the slice. A
    series has a fixed number of bins. Empty bins never match; a series with no
    count at all gives 0 at centres and fails within bins.
    """
    c = F.col
    w = W.partitionBy(*by).orderBy(left)
    iv = hist.withColumn("_hi", F.sum(count).over(w.rowsBetween(W.unboundedPreceding, 0)))
    iv = iv.withColumns({"_lo": c("_hi") - c(count), "_n": F.sum(count).over(W.partitionBy(*by))})
    empty = iv.filter("_n = 0").select(*by).distinct()
    iv = iv.filter(c(count) > 0)
    s = lambda x: F.floor(x * F.lit(slices) / c("_n"))
    iv = iv.withColumn("_slice", F.explode(F.sequence(s(c("_lo")), s(c("_hi")))))
    iv = iv.select(*[c(k).alias(f"_b_{k}") for k in by], c(left).alias("_l"), c(right).alias("_r"), "_lo", "_hi", "_slice")
    series = hist.groupBy(*by).agg(F.sum(count).alias("_n"))
    d = expand_draws(dr.with_streams(series.filter("_n > 0"), seed, by, ["bin", "inside"]), n)
    d = d.withColumn("_u", dr.at("u_bin"))
    d = d.withColumns({"_slice": F.floor(c("_u") * slices), "_t": c("_u") * c("_n")})
    cond = (c("_t") >= c("_lo")) & (c("_t") < c("_hi")) & (d["_slice"] == iv["_slice"])
    for k in by:
        cond = cond & (d[k] == iv[f"_b_{k}"])
    j = d.join(checked_broadcast(iv), cond)
    x = dr.uniform(dr.at("u_inside"), "_l", "_r") if within else (c("_l") + c("_r")) / F.lit(2.0)
    out = j.select(*by, "draw", x.alias("value"))
    zero = F.raise_error(F.lit("histogram holds no counts")).cast("double") if within else F.lit(0.0)
    return out.unionByName(expand_draws(empty, n).select(*by, "draw", zero.alias("value")))


def element_mass(conc_mg_cm2, area_cm2) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(conc_mg_cm2) * c(area_cm2) / F.lit(1000.0)
