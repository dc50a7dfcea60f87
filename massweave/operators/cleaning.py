"""Deduplication, validation and filters over component tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.functions.text import factor_or_null
from massweave.plans.literals import LABEL_BINS


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order.

    `row_number() = 1` lets Spark keep one row per key in every task before the
    shuffle (WindowGroupLimit), so a hot key costs no more than another.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first k rows per key in an explicit order; tasks keep k per key before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def dedup_exact(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, cols, order)


def dedup_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: rows, distinct rows over `cols`, copies that a deduplication drops, and the most rows that are alike."""
    g = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_distinct"),
                 (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("n_copies"), F.coalesce(F.max("_n"), F.lit(0)).alias("most"))


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return first_per_key(df, [key], order)


def signature(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols])


def dedup_signature(df: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key and value signature."""
    return first_per_key(df.withColumn("_sig", signature(cols)), [key, "_sig"], order).drop("_sig")


def conflicts(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Keys that occur with more than one set of values."""
    return (df.groupBy(key, *cols).agg(F.count("*").alias("_n"))       # collapses copies before the key shuffle
            .groupBy(key).agg(F.count("*").alias("n_variants"), F.sum("_n").alias("n_rows"))
            .filter("n_variants > 1"))


def factor_strict(df: DataFrame, col: str, out: str) -> DataFrame:
    """Label to factor; an unknown label fails the job and names the value."""
    f = factor_or_null(F.col(col))
    msg = F.concat(F.lit(f"unrecognised label in {col}: "), F.coalesce(F.col(col), F.lit("NULL")))
    return df.withColumn(out, F.when(f.isNull(), F.raise_error(msg).cast("double")).otherwise(f))


def unknown_labels(df: DataFrame, col: str) -> DataFrame:
    return (df.filter(factor_or_null(F.col(col)).isNull()).groupBy(F.col(col).alias("label"))
            .agg(F.count("*").alias("n")))


PLAIN = re.compile(r"[\w /-]+(\.\*[\w /-]+)*")


def alternatives(pattern: str) -> tuple[list[list[str]], list[str]]:
    """A pattern's alternatives: those of plain words in order ("a" or "a.*b"), and the others."""
    alts = pattern.split("|")
    rest = [a for a in alts if not PLAIN.fullmatch(a)]
    if any(set("()[]") & set(a) for a in rest):
        return [], [pattern]
    return [a.split(".*") for a in alts if PLAIN.fullmatch(a)], rest


def any_word(words: Sequence[str]) -> str:
    """A regular expression that finds the longest of `words` at a place, by their common beginnings."""
    heads = sorted({w[0] for w in words if w})
    parts = [re.escape(h) + any_word([w[1:] for w in words if w.startswith(h)]) for h in heads]
    if not parts:
        return ""
    tree = f"(?:{'|'.join(parts)})"
    return tree + "?" if "" in words else tree


def words_in(text: Column, words: Sequence[str]) -> Column:
    """The distinct `words` that stand anywhere in `text`, the longest at each place: one pass, whatever the number of words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({any_word(words)}))"), 1))


def matches(text: Column, pattern: str, found: Column, words: Sequence[str]) -> Column:
    """`text` matches `pattern` anywhere, given the `words` `found` in it.

    White space is normalised before, so "." meets no line end. The order of
    "a.*b" is looked up only where both stand in the text.
    """
    plain, rest = alternatives(pattern)
    hit = F.coalesce(text.rlike("|".join(rest)), F.lit(False)) if rest else F.lit(False)
    for alt in plain:
        ok = F.lit(True)
        for w in alt:
            ok = ok & F.arrays_overlap(found, F.array(*[F.lit(x) for x in words if x.startswith(w)]))
        if len(alt) > 1:
            at, end = F.locate(alt[0], text), len(alt[0])
            for w in alt[1:]:
                at, end = F.when(at > 0, F.call_function("locate", F.lit(w), text, at + end)), len(w)
            ok = ok & F.coalesce(at > 0, F.lit(False))
        hit = hit | ok
    return hit


def classify(df: DataFrame, domain: str, component: str, rules: Sequence[tuple[str, str, str]],
             default: str, out: str = "category") -> DataFrame:
    """First matching rule wins; one CASE over the row, no UDF and no join.

    A text is read once for the words of all its rules; rules then test the few
    words found. Other expressions stay regular expressions. A rule for the
    default at the end is left out.
    """
    while rules and rules[-1][2] == default:
        rules = rules[:-1]
    d = F.lower(F.trim(F.coalesce(F.col(domain), F.lit(""))))
    c = F.lower(F.trim(F.coalesce(F.col(component), F.lit(""))))
    t = df.withColumns({"_d": d, "_c": c}).withColumn("_b", F.concat_ws(" ", "_d", "_c"))
    text = {"domain": "_d", "component": "_c", "both": "_b"}
    words = {k: sorted({w for target, p, _ in rules if target == k for alt in alternatives(p)[0] for w in alt}) for k in text}
    t = t.withColumns({f"{text[k]}w": words_in(F.col(text[k]), w) for k, w in words.items() if w})
    expr = None
    for target, pattern, label in rules:
        hit = matches(F.col(text[target]), pattern, F.col(f"{text[target]}w"), words[target])
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return t.withColumn(out, expr.otherwise(default) if expr is not None else F.lit(default)).drop("_d", "_c", "_b", "_dw", "_cw", "_bw")


def any_positive(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(F.greatest(*cols) > 0)


def map_code(df: DataFrame, col: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Code to group by a fixed table; an unknown code reads NULL."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out, F.try_element_at(pairs, F.col(col)))


def check_triangular(df: DataFrame, ids: Sequence[str], triples: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Rows and triples that break min <= mode <= max."""
    arr = F.array(*[F.struct(F.lit(n).alias("triple"), F.col(a).cast("double").alias("lo"),
                             F.col(b).cast("double").alias("mode"), F.col(c).cast("double").alias("hi"))
                    for n, (a, b, c) in triples.items()])
    return (df.select(*ids, F.explode(arr).alias("t")).select(*ids, "t.*")
            .filter(~((F.col("lo") <= F.col("mode")) & (F.col("mode") <= F.col("hi")))))


def column_activity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest value per column, one row per column."""
    one = df.agg(*[F.max(F.col(c)).cast("double").alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("max_value"))
                                          for c in cols])).alias("s")).select("s.*")


def active_columns(df: DataFrame, cols: Sequence[str], exclude: Sequence[str] = ()) -> list[str]:
    """Names of columns with any value above zero (one aggregate row is read back)."""
    cols = [c for c in cols if c not in exclude]
    top = df.agg(*[F.max(c).alias(c) for c in cols]).first()
    return [c for c in cols if top[c] is not None and top[c] > 0]


def fix_bounds(lo, mode, hi) -> tuple[Column, Column, Column]:
    lo, mode, hi = (F.col(x) if isinstance(x, str) else x for x in (lo, mode, hi))
    a, b = F.least(lo, hi), F.greatest(lo, hi)
    return a, F.least(F.greatest(mode, a), b), b


def nearest_level(c) -> Column:
    """Closest label level; on a tie the one listed first."""
    c = F.col(c) if isinstance(c, str) else c
    cand = F.array(*[F.struct(F.abs(c - F.lit(v)).alias("d"), F.lit(i).alias("i"), F.lit(v).alias("v"))
                     for i, v in enumerate(LABEL_BINS)])
    return F.array_min(cand)["v"]


def label_bin(level) -> tuple[Column, Column]:
    level = F.col(level) if isinstance(level, str) else level
    lo = hi = F.lit(None).cast("double")
    for v, (a, b) in LABEL_BINS.items():
        lo = F.when(level == v, F.lit(a)).otherwise(lo)
        hi = F.when(level == v, F.lit(b)).otherwise(hi)
    return lo, hi


def filter_labels(df: DataFrame, col: str, drop: Sequence[str] = (), keep: Sequence[str] | None = None,
                  prefix: str | None = None) -> DataFrame:
    """Drop totals, blanks and 'nan' text; optionally keep a set or a prefix."""
    low = F.lower(F.trim(F.col(col)))
    conds = [F.col(col).isNotNull(), ~low.isin("", "nan", *[d.lower() for d in drop])]
    if keep is not None:
        conds.append(F.col(col).isin(list(keep)))
    if prefix is not None:
        conds.append(F.col(col).startswith(prefix))
    return df.filter(reduce(lambda a, b: a & b, conds))
