"""Writing series and draws, and the manifest that describes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.operators.groupwise import with_group


def write_series(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet", rows_per_file: int = 1_000_000) -> None:
    """One folder per key.

    Rows are first hashed on the key and a salt, as many salts as the key's rows
    ask for, so that a task writes a few folders with files of useful size and
    a hot key is split over tasks.
    """
    df = with_group(df, by, {"_n": F.count(F.lit(1))})
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != "_n"]), F.ceil(F.col("_n") / rows_per_file))
    (df.repartition(*[F.col(c) for c in by], salt).drop("_n").write.mode("overwrite")
     .partitionBy(*by).format(fmt).save(path))


def write_draws(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Raw draws with every DOUBLE stored as FLOAT; column names kept."""
    out = df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    w = out.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def series_manifest(hist: DataFrame, kind: str, segment: str, label: str, bin_col: str = "bin",
                    count_col: str = "count", folder: str = "histograms") -> DataFrame:
    """One row per series: where its histogram lies and how many draws it holds."""
    name = F.concat_ws("_", F.lit("histogram"), F.col(segment), F.regexp_replace(F.col(label), r"[^A-Za-z0-9\-]+", "_"))
    return (hist.groupBy(segment, label)
            .agg(F.sum(count_col).alias("n_simulations"), F.count(bin_col).alias("n_bins"))
            .select(F.lit(kind).alias("series_type"), F.col(segment).alias("segment"), F.col(label).alias("label"),
                    F.concat(F.lit(f"{folder}/"), name, F.lit(".csv")).alias("histogram_file"),
                    F.concat(F.lit("raw_data/"), name, F.lit(".parquet")).alias("raw_file"),
                    "n_simulations", "n_bins"))
