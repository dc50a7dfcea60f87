"""Column expressions over labels, names and codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.isspace() accepts. The escapes are
# understood alike by java.util.regex and RE2.
SPACE_CLASS = (
    r"[\s\x0B\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)

# Presence labels and what they stand for.
LABEL_FACTOR = {"Std": 1.0, "Opt": 0.5, "Rare": 0.25, "–": 0.0, "-": 0.0}

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c) -> Column:
    """Collapse every whitespace run (NBSP included) to one space and strip."""
    return F.trim(F.regexp_replace(_c(c), SPACE_CLASS, " "))


def norm_key(c) -> Column:
    return F.lower(norm_text(c))


def match_key(*cols) -> Column:
    """Composite key `a||b`; a missing part reads 'nan' so keys never collapse."""
    return F.concat_ws("||", *[F.coalesce(norm_key(c), F.lit("nan")) for c in cols])


def safe_name(c, keep_hyphen: bool = True) -> Column:
    allowed = r"[^\p{L}\p{N}_\-]+" if keep_hyphen else r"[^\p{L}\p{N}_]+"
    return F.regexp_replace(F.regexp_replace(_c(c), allowed, "_"), r"^_+|_+$", "")


def safe_name_per_char(c) -> Column:
    """One underscore per offending character, nothing trimmed."""
    return F.regexp_replace(_c(c), r"[^\p{L}\p{N}_\-]", "_")


def first_token(c, tokens: Sequence[str] | Mapping[str, str]) -> Column:
    """First token contained in the text, in list order; NULL when none is."""
    low = F.lower(_c(c))
    pairs = tokens.items() if isinstance(tokens, Mapping) else [(t, t) for t in tokens]
    return F.coalesce(*[F.when(low.contains(t.lower()), F.lit(v)) for t, v in pairs])


def segment_from_text(c, rules: Sequence[tuple[str, str]]) -> Column:
    up = F.upper(_c(c))
    return F.coalesce(*[F.when(up.contains(t.upper()), F.lit(s)) for t, s in rules])


def factor_lenient(c) -> Column:
    """Label to factor; null, dash and unknown labels all read 0.0."""
    label = F.trim(_c(c))
    expr = F.lit(0.0)
    for name, value in LABEL_FACTOR.items():
        expr = F.when(label == name, F.lit(value)).otherwise(expr)
    return expr


def factor_or_null(c) -> Column:
    """Label to factor; anything outside the vocabulary is NULL."""
    expr = F.lit(None).cast("double")
    for name, value in LABEL_FACTOR.items():
        expr = F.when(_c(c) == name, F.lit(value)).otherwise(expr)
    return expr


def to_number(c) -> Column:
    """Plain decimal text to DOUBLE; anything else is NULL."""
    text = _c(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def marker_or_value(c) -> Column:
    """Number, or NULL where the cell holds a marker instead of a number."""
    return to_number(c)


def scenario_suffix(c, default: str = "SAMPLE") -> Column:
    return F.when(_c(c) == default, F.lit("")).otherwise(F.concat(F.lit("_"), _c(c)))


def tag_membership(c, members: Sequence[str], yes: str, no: str) -> Column:
    return F.when(_c(c).isin(list(members)), F.lit(yes)).otherwise(F.lit(no))


def four_places(c) -> Column:
    """A DOUBLE as text with four decimals, rounded by its exact value and a tie to the even digit, as `%.4f` does in C and Python.

    `format_string` rounds the shortest decimal form up at a 5, so it differs at
    ties. Here the fraction is split in two parts whose products are exact.
    """
    x = F.abs(_c(c))
    part = x - F.floor(x)
    high = F.floor(part * F.lit(float(1 << 26))) / F.lit(float(1 << 26))
    k = F.floor(high * 10000.0)
    rest, low = F.lit(0.5) - (high * 10000.0 - k), (part - high) * 10000.0
    k = k + F.when((low > rest) | ((low == rest) & (k % 2 == 1)), 1).otherwise(0)
    text = F.format_string("%s%d.%04d", F.when(_c(c) < 0, "-").otherwise(""), F.floor(x) + F.when(k == 10000, 1).otherwise(0), k % 10000)
    return F.when(x < float(1 << 53), text).otherwise(F.format_string("%.4f", _c(c)))


def na_text(c, fill: str = "N/A") -> Column:
    return F.coalesce(F.nullif(F.trim(_c(c).cast("string")), F.lit("")), F.lit(fill))


# Multiplier from the first unit to the second.
UNIT_FACTOR = {
    ("mg", "g"): 1e-3,
    ("g", "kg"): 1e-3,
    ("kg", "g"): 1e3,
    ("ppm", "fraction"): 1e-6,
    ("mm2", "cm2"): 1e-2,
}
COPPER_DENSITY_G_PER_CM3 = 8.96  # fixed value; 1 mm2 x 1 m = 1 cm3


def convert_unit(c, from_: str, to: str) -> Column:
    if from_ == to:
        return _c(c)
    if (from_, to) not in UNIT_FACTOR:
        raise KeyError(f"no conversion {from_!r} -> {to!r}; known: {sorted(UNIT_FACTOR)}")
    return _c(c) * F.lit(UNIT_FACTOR[(from_, to)])


def copper_grams(gauge_mm2, length_m) -> Column:
    return _c(gauge_mm2) * F.lit(COPPER_DENSITY_G_PER_CM3) * _c(length_m)
