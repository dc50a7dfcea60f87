"""Lookups with contracts, coverage, interval and substring joins, draw expansion."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from massweave.functions import text as tx
from massweave.operators.cleaning import first_per_key
from massweave.operators.groupwise import join_on
from massweave.scale import checked_broadcast


def strict_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Equi-join in which every left row must match: any use of the result fails on an unmatched row and names its key."""
    rhs = right.select(*on, *cols, F.lit(True).alias("_hit"))
    key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in on])
    miss = F.raise_error(F.concat(F.lit("no match for (" + ", ".join(on) + ") = "), key))
    j = left.join(rhs, list(on), "left")
    return j.filter(F.when(F.col("_hit").isNull(), miss.cast("boolean")).otherwise(F.lit(True))).drop("_hit")


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def lenient_params(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: Mapping[str, float]) -> DataFrame:
    """Keyed parameters where a missing key reads fixed defaults."""
    j = left.join(right.select(*on, *defaults), list(on), "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def coverage(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that occur on one side only."""
    a = left.select(*on).distinct().withColumn("_a", F.lit(1))
    b = right.select(*on).distinct().withColumn("_b", F.lit(1))
    return (a.join(b, list(on), "full").filter("_a IS NULL OR _b IS NULL")
            .select(*on, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("only_in")))


def apply_year_scale(stats: DataFrame, scale: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add the year axis: every statistic times the (deterministic) scale of its key."""
    j = stats.join(scale.select(*on, "year", "scale"), list(on), "inner")
    return j.withColumns({c: F.col(c) * F.col("scale") for c in cols})


def compose(counts: DataFrame, comp: DataFrame, on: Sequence[str], stats: Sequence[str], mass: str) -> DataFrame:
    """Count statistics times the mass of each element per unit; positive cells only."""
    j = counts.join(comp.filter(F.col(mass) > 0), list(on), "inner")
    return j.withColumns({c: F.col(c) * F.col(mass) for c in stats})


def grams_of(text, lens: Column) -> Column:
    """Distinct substrings of `text`, a Column, of every length in the array `lens`; length 0 gives the empty one."""
    cut = lambda n: F.when(n == 0, F.array(F.lit(""))).when(
        F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))
    return F.array_distinct(F.flatten(F.transform(lens, lambda n: F.coalesce(cut(n), F.array().cast("array<string>")))))


def contains_lookup(left: DataFrame, text: str, right: DataFrame, token: str, order: Sequence[str], left_key: Sequence[str],
                    narrow: Column | None = None, strict: bool = False, gram: int = 3) -> DataFrame:
    """First right row, in `order`, whose token is contained in the left text, whatever the case.

    A containment test is a non-equi join. Here every token is listed under one
    of its substrings of `gram` characters (all of it, if shorter), the one that
    the fewest texts hold; a text looks up its distinct substrings of that one
    length, and what they find is verified. A text costs its length, not its
    length times the token lengths, and only keys are carried to the join.

    `narrow`, a condition over columns of both sides, decides where several rows
    match: the first that meets it is taken, none if no row does. With `strict`
    a left row without a result fails and names its key. A NULL text or token
    matches nothing; the empty token is contained in every text.
    """
    low = F.lower(F.col(text))
    r = right.withColumn("_tok", F.lower(F.col(token))).filter(F.col("_tok").isNotNull())
    lens = r.agg(F.sort_array(F.collect_set(F.least(F.length("_tok"), F.lit(gram)))).alias("_lens"))       # one row, at most gram + 1 lengths
    cut = left.filter(F.col(text).isNotNull()).select(*left_key, low.alias("_low")).crossJoin(F.broadcast(lens))
    cut = cut.select(*left_key, F.explode(grams_of(F.col("_low"), F.col("_lens"))).alias("_g"))
    own = r.select("_tok").distinct()
    own = own.select("_tok", F.explode(grams_of(F.col("_tok"), F.array(F.least(F.length("_tok"), F.lit(gram))))).alias("_g"))
    held = cut.join(own.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_n"))
    place = own.join(held, "_g", "left").groupBy("_tok").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
    extra = [c for c in right.columns if c not in left.columns]
    found = cut.join(place, "_g").select(*left_key, "_tok")
    both = found.join(left, list(left_key)).filter(F.contains(low, F.col("_tok"))).join(r.select("_tok", *extra), "_tok")
    row = F.struct(*order, *[c for c in extra if c not in order])
    narrowed = row if narrow is None else F.when(narrow, row)
    hit = both.groupBy(*left_key).agg(F.count("*").alias("_n"), F.min(row).alias("_one"), F.min(narrowed).alias("_row"))
    hit = hit.select(*left_key, F.when(F.col("_n") > 1, F.col("_row")).otherwise(F.col("_one")).alias("_hit"))
    out = left.join(hit, list(left_key), "left")
    if strict:
        key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in left_key])
        miss = F.raise_error(F.concat(F.lit("nothing contained for (" + ", ".join(left_key) + ") = "), key))
        out = out.filter(F.when(F.col("_hit").isNull(), miss.cast("boolean")).otherwise(F.lit(True)))
    return out.select(*[F.col(c) for c in left.columns], *[F.col("_hit")[c].alias(c) for c in extra])


def attach_stats(src: DataFrame, stats: DataFrame, on: Sequence[str], order: Sequence[str],
                 mean: str = "mean", std: str = "std") -> DataFrame:
    """First statistics row per key; unmatched rows stay, and read 'N/A'."""
    one = first_per_key(stats, on, order).select(*on, F.col(mean).alias("_m"), (F.lit(2.0) * F.col(std)).alias("_u"))
    j = src.join(one, list(on), "left")
    show = lambda c: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(tx.four_places(c))
    return j.withColumns({"value": show("_m"), "uncertainty": show("_u")}).drop("_m", "_u")


def period_delta(df: DataFrame, by: Sequence[str], year: str, val: str, a: int, b: int) -> DataFrame:
    """Both periods and their difference in one pass; a missing period counts 0."""
    at = lambda y: F.sum(F.when(F.col(year) == y, F.col(val)).otherwise(F.lit(0.0)))
    return (df.filter(F.col(year).isin(a, b)).groupBy(*by).agg(at(a).alias("value_a"), at(b).alias("value_b"))
            .withColumn("delta", F.col("value_b") - F.col("value_a")))


def period_table(df: DataFrame, by: Sequence[str], year: str, vals: Sequence[str], a: int, b: int) -> DataFrame:
    """Both periods of several values, as `<value>_a` and `<value>_b`; a key that one period lacks counts 0 there."""
    at = lambda v, y: F.sum(F.when(F.col(year) == y, F.col(v)).otherwise(F.lit(0.0)))
    return df.filter(F.col(year).isin(a, b)).groupBy(*by).agg(*[at(v, y).alias(f"{v}_{n}") for v in vals for n, y in (("a", a), ("b", b))])


#: Up to so many draws a row makes where it is: moving it would cost more than its draws.
IN_PLACE = 16


def expand_draws(df: DataFrame, n: int, draw: str = "draw", block: int = 8192, per_row: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows x draws; a task expands (row, block of draws) pairs.

    A few draws (`IN_PLACE`) are made in the row's own task, without a shuffle.
    For more, the pairs are dealt by a hash of the row's own values and the
    block, over the session's shuffle partitions or all cores, whichever are
    more: few rows with very many draws use every task, many rows take as many
    tasks as any other shuffle, and a retried task deals them the same way.
    `per_row` adds columns, such as streams, after the rows are dealt: they are
    not moved, and a small file read by one task is not hashed in that task.
    """
    per_row = per_row or (lambda d: d)
    if n <= min(IN_PLACE, block):
        return per_row(df).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(draw))
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block))
    keys = [c for c, t in df.dtypes if not t.startswith(("map", "struct", "array"))]
    blocks = df.select("*", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // block))).alias("_b")).repartition(tasks, *[F.col(f"`{c}`") for c in keys], "_b")
    first = F.col("_b") * block
    last = F.least(first + (block - 1), F.lit(n - 1))
    return per_row(blocks).select("*", F.explode(F.sequence(first, last)).alias(draw)).drop("_b")


def draws_over(params: DataFrame, n: int, draw: str = "draw", max_rows: int = 20_000, per_task: int = 1 << 20) -> DataFrame:
    """Draws x parameter rows, partitioned by ranges of draw ids; `draw` is a BIGINT.

    Rows of one draw stay in one partition and Spark knows it, so sums per draw
    need no shuffle. The parameter table is broadcast up to `max_rows`; a larger
    one goes through `expand_draws`, whose sums per draw are combined in the
    tasks before they are shuffled. The number of tasks follows rows x draws.
    """
    spark: SparkSession = params.sparkSession
    small = params.persist()
    rows = small.count()
    if rows > max_rows:
        small.unpersist()
        return expand_draws(params, n, draw).select(F.col(draw).cast("bigint").alias(draw), *params.columns)
    parts = max(spark.sparkContext.defaultParallelism, -(-n * max(rows, 1) // per_task))
    return spark.range(0, n, 1, parts).withColumnRenamed("id", draw).crossJoin(F.broadcast(small))


def bracket_join(points: DataFrame, anchors: DataFrame, by: Sequence[str], x: str, ax: str, vals: Sequence[str],
                 step: float) -> DataFrame:
    """Each point with its surrounding anchors; beyond the ends both are the end anchor.

    Intervals are cut into buckets of width `step`, so the range condition
    becomes an equi-join on (key, bucket) plus a filter. Anchors per key are few
    (a curve). A point whose position is NULL or whose key has no anchor stays,
    with NULL anchors.
    """
    w = W.partitionBy(*by).orderBy(ax)
    iv = anchors.select(*by, F.col(ax).cast("double").alias("x_lo"), *[F.col(v).alias(f"{v}_lo") for v in vals],
                        F.lead(F.col(ax).cast("double")).over(w).alias("x_hi"),
                        *[F.lead(v).over(w).alias(f"{v}_hi") for v in vals],
                        F.row_number().over(w).alias("_rn"))
    iv = iv.withColumns({"x_hi": F.coalesce("x_hi", "x_lo"), "_last": F.col("x_hi").isNull(),
                         **{f"{v}_hi": F.coalesce(f"{v}_hi", f"{v}_lo") for v in vals}})
    ends = anchors.groupBy(*by).agg(F.min(F.col(ax).cast("double")).alias("_x0"), F.max(F.col(ax).cast("double")).alias("_x1"))
    b = lambda c: F.floor(c / F.lit(float(step)))
    iv = iv.withColumn("_bucket", F.explode(F.sequence(b(F.col("x_lo")), b(F.col("x_hi"))))).drop("_rn")
    p = join_on(points, ends, by, "left")
    p = p.withColumn("_x", F.least(F.greatest(F.col(x).cast("double"), F.col("_x0")), F.col("_x1")))
    p = p.withColumn("_bucket", b(F.col("_x")))
    keys = [*by, "_bucket"]
    iv = iv.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    on = reduce(lambda m, c: m & (p[c].eqNullSafe(iv[f"_k_{c}"]) if c != "_bucket" else p[c] == iv[f"_k_{c}"]), keys, F.lit(True))
    hit = (F.col("_x") >= F.col("x_lo")) & ((F.col("_x") < F.col("x_hi")) | F.col("_last"))
    return p.join(iv, on & hit & F.col(x).isNotNull(), "left").drop("_bucket", "_x", "_x0", "_x1", "_last", *[f"_k_{c}" for c in keys])


def overlaps(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges of two sources on the same key and whether they overlap at all."""
    j = a.select(*by, F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a")).join(
        b.select(*by, F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")), list(by))
    return j.withColumn("overlap", ~((F.col("hi_a") < F.col("lo_b")) | (F.col("hi_b") < F.col("lo_a"))))


def max_abs_diff(a: DataFrame, b: DataFrame, on: Sequence[str], val: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest difference of two sources on the same keys; unmatched keys are counted."""
    x = a.select(*on, F.col(val).alias("_va"), F.lit(1).alias("_ia"))
    y = b.select(*on, F.col(val).alias("_vb"), F.lit(1).alias("_ib"))
    return (x.join(y, list(on), "full").groupBy(*by)
            .agg(F.max(F.abs(F.col("_va") - F.col("_vb"))).alias("max_abs_diff"),
                 F.sum(F.when(F.col("_ia").isNull() | F.col("_ib").isNull(), 1).otherwise(0)).alias("n_unmatched"),
                 F.count("*").alias("n_keys")))
