"""Reading parameter tables and series files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massweave.functions.text import to_number


def read_parts(spark: SparkSession, paths: Mapping[str, str] | Sequence[str],
               cols: Sequence[str] | None = None, tag: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Stack same-shaped parts; a column a part lacks reads NULL."""
    named = paths.items() if isinstance(paths, Mapping) else [(p, p) for p in paths]
    parts = []
    for name, path in named:
        df = spark.read.format(fmt).load(path)
        if cols is not None:
            df = df.select(*[c for c in cols if c in df.columns])
        parts.append(df.withColumn(tag, F.lit(name)) if tag else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def clean_table(df: DataFrame, required: Sequence[str],
                drop_values: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Keep rows whose required columns are all filled; drop total and note rows."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    for c, values in (drop_values or {}).items():
        cond = cond & ~F.col(c).isin(list(values))
    return df.filter(cond)


def unique_columns(df: DataFrame) -> DataFrame:
    """Rename repeated columns c, c, c to c, c_1, c_2."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = seen.get(c, -1) + 1
        seen[c] = n
        names.append(c if n == 0 else f"{c}_{n}")
    return df.toDF(*names)


def col_ci(df: DataFrame, name: str) -> Column:
    """Resolve a column ignoring case and whitespace."""
    want = "".join(name.lower().split())
    for c in df.columns:
        if "".join(c.lower().split()) == want:
            return F.col(f"`{c}`")
    raise KeyError(f"no column {name!r}; available: {df.columns}")


def try_numeric(df: DataFrame, cols: Sequence[str] | None = None, contains: Sequence[str] = (),
                default: float | None = None) -> DataFrame:
    """Coerce the listed columns, or those whose name contains a token, to DOUBLE."""
    pick = list(cols) if cols is not None else [c for c in df.columns if any(t in c for t in contains)]
    conv = {c: to_number(F.col(c)) for c in pick}
    if default is not None:
        conv = {c: F.coalesce(e, F.lit(float(default))) for c, e in conv.items()}
    return df.withColumns(conv)


def params(df: DataFrame, key: str, value: str, names: Sequence[str]) -> DataFrame:
    """Key/value rows to one row with a column per parameter."""
    return df.agg(*[F.max(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names])


def first_valid(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, in the given order, in which none of `cols` is NULL."""
    cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    best = F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("m")
    return df.filter(cond).agg(best).select(*[F.col(f"m.{c}").alias(c) for c in cols])


def active_scenario(control: DataFrame, column: str, allowed: Sequence[str],
                    override: str | None = None) -> DataFrame:
    """One-row control value; an override wins, a value off the list raises."""
    value = F.lit(override) if override is not None else F.trim(F.col(column))
    ok = F.coalesce(value.isin(list(allowed)), F.lit(False))
    message = F.concat(F.lit("active scenario "), F.coalesce(value, F.lit("NULL")),
                       F.lit(" is not one of " + ", ".join(allowed)))
    return control.select(F.when(ok, value).otherwise(F.raise_error(message)).alias("active"))


SERIES_PATTERN = r"^histogram_(AB|CD|EF)_(.+)_(small|medium|large)_area$"


def parse_series_name(df: DataFrame, path_col: str, pattern: str = SERIES_PATTERN,
                      names: Sequence[str] = ("segment", "category", "size")) -> DataFrame:
    """Keys out of a series file name; malformed names are dropped."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(path_col), "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return (df.withColumn("_stem", stem).filter(F.col("_stem").rlike(pattern))
            .withColumns({n: F.regexp_extract("_stem", pattern, i + 1) for i, n in enumerate(names)})
            .drop("_stem"))


def read_globs(spark: SparkSession, patterns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Read the distinct files matched by several patterns, each file once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: set[str] = set()
    for p in patterns:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for st in path.getFileSystem(conf).globStatus(path) or []:
            found.add(st.getPath().toString())
    if not found:
        raise FileNotFoundError(f"no file matches {list(patterns)}")
    return spark.read.format(fmt).load(sorted(found))


COMPOSITION_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
    T.StructField("mg_per_cm2_min", T.DoubleType()),
    T.StructField("mg_per_cm2_typical", T.DoubleType()),
    T.StructField("mg_per_cm2_max", T.DoubleType()),
    T.StructField("weight_percent_min", T.DoubleType()),
    T.StructField("weight_percent_typical", T.DoubleType()),
    T.StructField("weight_percent_max", T.DoubleType()),
])))


def flatten_composition(df: DataFrame, json_col: str) -> DataFrame:
    """{category: {element: {numbers}}} to one row per category and element."""
    keep = [c for c in df.columns if c != json_col]
    return (df.select(*keep, F.explode(F.from_json(json_col, COMPOSITION_TYPE)).alias("category", "_els"))
            .select(*keep, "category", F.explode("_els").alias("element", "_v"))
            .select(*keep, "category", "element", "_v.*"))


def require(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """Plan-time contract: every named column exists."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {missing}; available: {df.columns}")
    return df


def require_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Plan-time contract: every path or glob names at least one file; all that do not are named together."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    missing = []
    for p in paths:
        path = hadoop.Path(p)
        if not path.getFileSystem(conf).globStatus(path):
            missing.append(p)
    if missing:
        raise FileNotFoundError(f"missing input: {', '.join(missing)}")
    return list(paths)
