"""Keyed draws as Column expressions.

Every draw is a pure function of (seed, variable, row key, draw id): the result
does not depend on partitioning, task retries or evaluation order.

`keyed_uniform` hashes its whole key. For rows x draws that is one MD5 per cell,
so `stream` hashes once per row and variable into the four coefficients of a
cubic over the prime field 2^31-1, and `at` evaluates the cubic at the draw id:
three multiply-adds in BIGINT, inside whole-stage codegen. Values of a random
cubic are four-wise independent, which is what means, variances and
correlations over draws need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647  # 2^31 - 1


def _c(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def _digest(seed: int, var: str, keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{var}"), *[_c(k).cast("string") for k in keys]))


def _hex32(digest: Column, i: int) -> Column:
    # never NULL, and said so: without the null checks the generated code stays small
    return F.coalesce(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def keyed_uniform(seed: int, var: str, *keys) -> Column:
    """Uniform in (0, 1) for one key; leave the year out to hold it over years."""
    return (_hex32(_digest(seed, var, keys), 0) + F.lit(0.5)) / F.lit(4294967296.0)


def stream(seed: int, var: str, *keys) -> Column:
    """Coefficients of one row's draw stream for one variable."""
    d = _digest(seed, var, keys)
    return F.struct(*[(_hex32(d, i) % F.lit(PRIME)).alias(f"c{i}") for i in range(4)])


def at(stream_col, draw="draw") -> Column:
    """The stream's uniform in (0, 1) at a draw id."""
    c = _c(stream_col)
    x = _c(draw) + F.lit(1)
    p = F.lit(PRIME)
    h = c["c3"]
    for i in (2, 1, 0):
        h = (h * x + c[f"c{i}"]) % p
    return (h + F.lit(0.5)) / F.lit(float(PRIME))


def with_streams(df, seed: int, keys, variables):
    """One stream column `u_<variable>` per variable, hashed once per row."""
    return df.withColumns({f"u_{v}": stream(seed, v, *keys) for v in variables})


def draw_uniforms(df, variables: dict[str, tuple], drop: bool = True):
    """Uniforms as columns: {name: (stream column, draw id)}.

    A transform reads its uniform several times. As a column it is computed once
    per row, and the generated method stays below the size the JIT compiles.
    """
    out = df.withColumns({n: at(s, d) for n, (s, d) in variables.items()})
    return out.drop(*{s for s, _ in variables.values()}) if drop else out


def uniform(u, lo, hi) -> Column:
    return _c(lo) + _c(u) * (_c(hi) - _c(lo))


def triangular(u, lo, mode, hi) -> Column:
    """Inverse CDF; reversed bounds are swapped, the mode is clipped into them."""
    u = _c(u)
    a, b = F.least(_c(lo), _c(hi)), F.greatest(_c(lo), _c(hi))
    m = F.least(F.greatest(_c(mode), a), b)
    span = b - a
    return (
        F.when(span <= 0, a)
        .when(u * span < m - a, a + F.sqrt(u * span * (m - a)))
        .otherwise(b - F.sqrt((F.lit(1.0) - u) * span * (b - m)))
    )


def normal(u1, u2, mu, sd, floor: float | None = None) -> Column:
    z = F.sqrt(F.lit(-2.0) * F.ln(_c(u1))) * F.cos(F.lit(2.0 * math.pi) * _c(u2))
    x = _c(mu) + _c(sd) * z
    return x if floor is None else F.greatest(x, F.lit(float(floor)))


def bernoulli(u, p) -> Column:
    return _c(u) < _c(p)


def pick(u, weights: dict[str, float], pinned: str | None = None) -> Column:
    """Weighted pick from a small fixed set, or the pinned member."""
    if pinned is not None:
        if pinned not in weights:
            raise ValueError(f"{pinned!r} is not one of {list(weights)}")
        return F.lit(pinned)
    total = sum(weights.values())
    names, edge, expr = list(weights), 0.0, None
    for n in names[:-1]:
        edge += weights[n] / total
        cond = _c(u) < F.lit(edge)
        expr = F.when(cond, F.lit(n)) if expr is None else expr.when(cond, F.lit(n))
    return F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))


def comonotonic_state(u, shares: list) -> Column:
    """Index of the state a held uniform falls in; the last state takes the rest."""
    cum, hits = None, F.lit(0)
    for s in shares:
        cum = _c(s) if cum is None else cum + _c(s)
        hits = hits + F.when(_c(u) > cum, 1).otherwise(0)
    return F.least(hits, F.lit(len(shares) - 1))


def band_pick(u, lo, mode, hi) -> Column:
    return F.when(_c(u) < F.lit(1.0 / 3), _c(lo)).when(_c(u) < F.lit(2.0 / 3), _c(mode)).otherwise(_c(hi))


def saturating_growth(h, tau, year, base_year: int = 2025) -> Column:
    dt = (_c(year) - F.lit(base_year)).cast("double")
    return F.greatest(_c(h) - (_c(h) - F.lit(1.0)) * F.exp(-dt / _c(tau)), F.lit(0.0))


def uplift(x, flag, factor) -> Column:
    """x * (1 + flag * (factor - 1)); flag is boolean."""
    return _c(x) * (F.lit(1.0) + F.when(_c(flag), F.lit(1.0)).otherwise(F.lit(0.0)) * (_c(factor) - F.lit(1.0)))


def reduction(rate, flag, red) -> Column:
    return _c(rate) * (F.lit(1.0) - F.when(_c(flag), _c(red)).otherwise(F.lit(0.0)))
