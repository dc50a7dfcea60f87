"""Adoption curves through anchors, and the year axis."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.functions.text import marker_or_value
from massweave.operators.groupwise import at_base, index_to_base, share_of, with_group
from massweave.plans.literals import LIDAR_H4_FLOOR
from massweave.scale import checked_broadcast


def _end_slope(h0, h1, d0, d1) -> Column:
    """Three-point end slope, limited to keep the shape."""
    m = ((F.lit(2.0) * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return (F.when(h1.isNull(), d0)
            .when(F.signum(m) != F.signum(d0), F.lit(0.0))
            .when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > F.lit(3.0) * F.abs(d0)), F.lit(3.0) * d0)
            .otherwise(m))


def monotone_curve(anchors: DataFrame, by: Sequence[str], x: str, y: str, first: int, last: int,
                   clip: tuple[float, float] | None = (0.0, 1.0), out_x: str = "year") -> DataFrame:
    """Monotone cubic through each key's anchors, read on whole years.

    Slopes come from the neighbouring secants (weighted harmonic mean, zero at
    a turn). Every interval then emits the years it covers, so there is no join
    between grid and anchors at all. End values are held; one anchor is a
    constant. Anchors per key are few by nature (a curve, not a table).
    """
    w = W.partitionBy(*by).orderBy("_x")
    c = F.col
    t = anchors.select(*by, c(x).cast("double").alias("_x"), c(y).cast("double").alias("_y"))
    t = t.withColumns({"_xn": F.lead("_x").over(w), "_yn": F.lead("_y").over(w)})
    t = t.withColumn("_h", c("_xn") - c("_x")).withColumn("_d", (c("_yn") - c("_y")) / c("_h"))
    t = t.withColumns({"_hp": F.lag("_h").over(w), "_dp": F.lag("_d").over(w), "_hn": F.lead("_h").over(w),
                       "_dn": F.lead("_d").over(w), "_hpp": F.lag("_h", 2).over(w), "_dpp": F.lag("_d", 2).over(w)})
    w1, w2 = F.lit(2.0) * c("_h") + c("_hp"), c("_h") + F.lit(2.0) * c("_hp")
    slope = (F.when(c("_dp").isNull() & c("_d").isNull(), F.lit(0.0))
             .when(c("_dp").isNull(), _end_slope(c("_h"), c("_hn"), c("_d"), c("_dn")))
             .when(c("_d").isNull(), _end_slope(c("_hp"), c("_hpp"), c("_dp"), c("_dpp")))
             .when(c("_dp") * c("_d") <= 0, F.lit(0.0))
             .otherwise((w1 + w2) / (w1 / c("_dp") + w2 / c("_d"))))
    t = t.withColumn("_m", slope).withColumn("_mn", F.lead("_m").over(w))
    lo = F.when(c("_dp").isNull(), F.lit(first)).otherwise(F.greatest(F.ceil("_x"), F.lit(first)))
    hi = F.when(c("_d").isNull(), F.lit(last)).otherwise(F.least(F.ceil("_xn") - 1, F.lit(last)))
    t = t.withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")}).filter("_lo <= _hi")
    t = t.withColumn(out_x, F.explode(F.sequence("_lo", "_hi")))
    s = (c(out_x) - c("_x")) / c("_h")
    hermite = ((F.lit(1.0) + F.lit(2.0) * s) * (F.lit(1.0) - s) * (F.lit(1.0) - s) * c("_y")
               + s * (F.lit(1.0) - s) * (F.lit(1.0) - s) * c("_h") * c("_m")
               + s * s * (F.lit(3.0) - F.lit(2.0) * s) * c("_yn")
               + s * s * (s - F.lit(1.0)) * c("_h") * c("_mn"))
    val = F.when(c("_d").isNull() | (c(out_x) <= c("_x")), c("_y")).otherwise(hermite)
    if clip is not None:
        alone = c("_d").isNull() & c("_dp").isNull()
        val = F.when(alone, val).otherwise(F.least(F.greatest(val, F.lit(clip[0])), F.lit(clip[1])))
    return t.select(*by, out_x, val.alias(y))


def share_curves(anchors: DataFrame, by: Sequence[str], state: str, x: str, band: str, first: int, last: int) -> DataFrame:
    """Curves of all states, renormalised to sum to 1 in every year."""
    cv = monotone_curve(anchors, [*by, state], x, band, first, last)
    return share_of(cv, [*by, "year"], band, "share", floor=1e-12, bounded=True).select(*by, state, "year", "share")


def wide_curve(curve: DataFrame, by: Sequence[str], state: str, val: str, states: Sequence[str]) -> DataFrame:
    """One row per key and year, one column per state, plus next year's value."""
    wide = curve.groupBy(*by, "year").pivot(state, list(states)).agg(F.first(val))
    w = W.partitionBy(*by).orderBy("year")
    z = {s: F.coalesce(F.col(s), F.lit(0.0)) for s in states}
    wide = wide.withColumns(z)
    return wide.withColumns({f"{s}_next": F.coalesce(F.lead(s).over(w), F.col(s)) for s in states})


def shift_curve(draws: DataFrame, wide: DataFrame, by: Sequence[str], delta: str, years: tuple[int, int],
                states: Sequence[str], normal: bool = True) -> DataFrame:
    """Re-read the curve at (year - delta) for every draw and year; ends are held.

    `draws` carries the keys, `year` and `delta`. The curve is looked up once,
    on (key, whole year), since each row of it holds its right neighbour too.
    """
    y0, y1 = years
    pos = F.least(F.greatest(F.col("year") - F.col(delta), F.lit(float(y0))), F.lit(float(y1))) - F.lit(y0)
    d = draws.withColumn("_pos", pos)
    d = d.withColumn("_i", F.least(F.floor("_pos"), F.lit(y1 - y0 - 1)).cast("int"))
    d = d.withColumn("_f", F.col("_pos") - F.col("_i")).withColumn("_at", F.lit(y0) + F.col("_i"))
    cv = checked_broadcast(wide.withColumnRenamed("year", "_at"))
    j = d.join(cv, [*by, "_at"])
    raw = {s: F.greatest(F.col(s) * (F.lit(1.0) - F.col("_f")) + F.col(f"{s}_next") * F.col("_f"), F.lit(0.0)) for s in states}
    j = j.withColumns(raw).drop("_at", "_i", "_f", "_pos", *[f"{s}_next" for s in states])
    if not normal:
        return j
    total = None
    for s in states:
        total = F.col(s) if total is None else total + F.col(s)
    j = j.withColumn("_t", F.greatest(total, F.lit(1e-12)))
    return j.withColumns({s: F.col(s) / F.col("_t") for s in states}).drop("_t")


def presence_long(presence: DataFrame, component: str, tiers: Sequence[str]) -> DataFrame:
    """Presence per tier as rows; a marker cell reads NULL."""
    long = presence.unpivot([component], list(tiers), "tier", "cell")
    return long.select(component, "tier", marker_or_value("cell").alias("presence"))


def substitute_marker(tier, presence, other) -> Column:
    """A marked H3 takes the other driver's curve, any other marked tier its floor too."""
    tier, presence, other = (F.col(c) if isinstance(c, str) else c for c in (tier, presence, other))
    sub = F.when(tier == "H3", other).otherwise(F.greatest(other, F.lit(LIDAR_H4_FLOOR)))
    return F.coalesce(presence, sub)


def compose_presence(shares: DataFrame, presence: DataFrame, component: str, by: Sequence[str],
                     other: DataFrame | None = None) -> DataFrame:
    """Sum over tiers of share x presence, clipped to [0, 1].

    `presence` is a component list; `other` (year, other) replaces marker cells.
    """
    j = shares.join(checked_broadcast(presence), "tier")
    if other is not None:
        j = j.join(checked_broadcast(other), "year", "left")
        j = j.withColumn("presence", substitute_marker("tier", "presence", "other"))
    s = F.sum(F.col("share") * F.coalesce(F.col("presence"), F.lit(0.0)))
    return (j.groupBy(component, *by, "year").agg(s.alias("presence"))
            .withColumn("presence", F.least(F.greatest(F.col("presence"), F.lit(0.0)), F.lit(1.0))))


def scenario_curve(anchors: DataFrame, by: Sequence[str], x: str, y: str, start: int, first: int, last: int) -> DataFrame:
    """Multiplier curve: exactly 1 up to the start year, never negative, not capped."""
    cv = monotone_curve(anchors, by, x, y, first, last, clip=None)
    return cv.withColumn(y, F.when(F.col("year") <= start, F.lit(1.0)).otherwise(F.greatest(F.col(y), F.lit(0.0))))


def anchor_to_base(df: DataFrame, val: str, base_year: int, mode: str, ensemble: Sequence[str] = (),
                   draw: Sequence[str] = (), target: str | None = None, shares: Mapping[str, str] | None = None) -> DataFrame:
    """Renormalise so that the base year reproduces what was observed.

    expected: divide by the base-year expectation sum(share x level)
    ensemble: scale so that the ensemble mean at the base year is `target`
    row:      divide every draw by its own base-year value
    """
    c = F.col
    if mode == "expected":
        e = None
        for share, level in (shares or {}).items():
            e = c(share) * c(level) if e is None else e + c(share) * c(level)
        return df.withColumn(val, c(val) / F.greatest(e, F.lit(1e-12)))
    if mode == "ensemble":
        t = with_group(df, ensemble, {"_mean": F.avg(F.when(c("year") == base_year, c(val)))})
        return t.withColumn(val, c(val) * c(target) / F.greatest(c("_mean"), F.lit(1e-9))).drop("_mean")
    if mode == "row":
        t = at_base(df, [*ensemble, *draw], "year", val, base_year, "_base")
        return t.withColumn(val, c(val) / F.greatest(c("_base"), F.lit(1e-12))).drop("_base")
    raise ValueError(f"mode {mode!r}; expected 'expected', 'ensemble' or 'row'")


def pct_change(df: DataFrame, by: Sequence[str], year: str, val: str, y0: int, y1: int) -> DataFrame:
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(val)))
    t = df.filter(F.col(year).isin(y0, y1)).groupBy(*by).agg(at(y0).alias("v0"), at(y1).alias("v1"))
    return t.withColumn("change_pct", (F.col("v1") / F.nullif(F.col("v0"), F.lit(0.0)) - F.lit(1.0)) * F.lit(100.0))


def year_on_year(df: DataFrame, by: Sequence[str], year: str, val: str) -> DataFrame:
    """Change against the previous year, as an equi-join on year + 1."""
    prev = df.select(*by, (F.col(year) + 1).alias(year), F.col(val).alias("_prev"))
    j = df.join(prev, [*by, year], "left")
    return j.withColumn("yoy_pct", (F.col(val) / F.nullif(F.col("_prev"), F.lit(0.0)) - F.lit(1.0)) * F.lit(100.0)).drop("_prev")


def snapshots(df: DataFrame, years: Sequence[int], year: str = "year") -> DataFrame:
    return df.filter(F.col(year).isin(list(years)))


def broadcast_year(base: DataFrame, delta: DataFrame, by: Sequence[str], val: str, first: int, last: int) -> DataFrame:
    """Year axis as base + delta.

    The base is already aggregated without the year; only the rows a driver
    touches carry one. Neither side is multiplied out before it is summed.
    """
    grid = base.select(*by, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"), F.col(val))
    both = grid.unionByName(delta.select(*by, "year", val))
    return both.groupBy(*by, "year").agg(F.sum(val).alias(val))


__all__ = ["monotone_curve", "share_curves", "wide_curve", "shift_curve", "presence_long", "substitute_marker",
           "compose_presence", "scenario_curve", "anchor_to_base", "index_to_base", "pct_change", "year_on_year",
           "snapshots", "broadcast_year"]
