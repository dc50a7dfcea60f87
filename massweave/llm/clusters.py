"""Centroid clustering: exact integer k-means whose nearest-centroid search runs coarse to fine over Walsh-Hadamard coefficients."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import stored

#: Components of a vector, and of its transform.
DIM = 64
#: Ends of the blocks of coefficients that are added between two eliminations, coarse to fine.
LEVELS = (4, 8, 16, 32, DIM)
#: Integers up to here keep every sum of the search in 64 bits; larger ones are worked on as Python integers.
NARROW = 1 << 21
#: Components from here on, after scaling, leave no room for exact sums; such vectors take no part.
WIDEST = 10.0 ** 27
#: (vector, centroid) pairs that a task works on at a time.
PAIRS = 1 << 16


def hadamard(n: int) -> np.ndarray:
    """The n x n transform, rows by number of sign changes, so that the first ones are the coarse ones."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


H = hadamard(DIM)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as int64 where small enough and else as Python integers."""
    x = np.floor(scale * x)
    if not x.size or np.abs(x).max() <= NARROW:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors, one per row, exactly."""
    if x.dtype == object:
        return x.dot(H.T.astype(object))
    return (x.astype(np.float64) @ H.T.astype(np.float64)).astype(np.int64)     # sums below 2^27


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return (d * d).sum(1)


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of `c` nearest to each row of `v`, both of coefficients, and its squared distance.

    A prefix of the coefficient differences bounds the distance from below. The
    centroid that looks nearest after the first block is measured in full; from
    then on each block eliminates the centroids whose prefix is strictly above
    the vector's smallest distance known. What is left is summed over all 64
    coefficients, so the answer is exact and ties go to the smaller number.
    The transform scales every squared distance by 64, which is taken back.
    """
    if v.dtype != c.dtype:
        v, c = v.astype(object), c.astype(object)
    n, k = len(v), len(c)
    rows, cols = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = squares(v[rows, :LEVELS[0]], c[cols, :LEVELS[0]])
    guess = part.reshape(n, k).argmin(1)
    best = squares(v, c[guess])
    for lo, hi in zip(LEVELS, LEVELS[1:]):
        alive = np.asarray(part <= best[rows], dtype=bool)
        rows, cols, part = rows[alive], cols[alive], part[alive]
        part = part + squares(v[rows, lo:hi], c[cols, lo:hi])
    order = np.lexsort((cols, part, rows)) if part.dtype != object else np.array(sorted(range(len(part)), key=lambda i: (rows[i], part[i], cols[i])), dtype=np.int64)
    _, one = np.unique(rows[order], return_index=True)
    win = order[one]
    return cols[win], part[win] // DIM


def vectors_of(b: pa.RecordBatch, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with the integer vectors of their rows."""
    step = PAIRS // DIM
    for at in range(0, b.num_rows, step):
        s = b.slice(at, step)
        yield s, integers(s.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM), scale)


def kept(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x): rows with exactly 64 finite components of a size that can be summed."""
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda e: F.coalesce(F.abs(e * scale) < F.lit(WIDEST), F.lit(False)))     # NaN counts as larger than any number
    return vectors.filter((F.size("embedding") == DIM) & ok).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def starts(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k first vectors by the hash of their id, as integers: at most k rows come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.filter("vec_id is not null").select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return integers(np.array([r.x for r in top], dtype=np.float64).reshape(-1, DIM), scale)


def sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(cluster, n, x): per task and cluster the number of vectors assigned to it and their componentwise sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = transform(centroids)
        total, n = np.zeros((len(c), DIM), dtype=object), np.zeros(len(c), dtype=np.int64)
        for b in batches:
            for _, x in vectors_of(b, scale):
                which, _ = nearest(transform(x), c)
                part = np.zeros((len(c), DIM), dtype=x.dtype)
                np.add.at(part, which, x)
                total += part.astype(object)
                n += np.bincount(which, minlength=len(c))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array([[str(v) for v in total[i]] for i in at], pa.list_(pa.string()))],
                                         names=["cluster", "n", "x"])

    return rows.select("x").mapInArrow(run, "cluster int, n long, x array<string>")


def moved(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: each non-empty one the floor of its vectors' mean. At most k rows come to the driver."""
    d = [F.sum(F.col("x")[i].cast("decimal(38,0)")).cast("string").alias(f"x{i}") for i in range(DIM)]
    new = centroids.astype(object)
    for r in sums(rows, centroids, scale).groupBy("cluster").agg(F.sum("n").alias("n"), *d).collect():
        new[r.cluster] = [int(r[f"x{i}"]) // r.n for i in range(DIM)]
    return new if max(map(abs, new.flat), default=0) > NARROW else new.astype(np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = transform(centroids)
        for b in batches:
            for s, x in vectors_of(b, scale):
                which, dist = nearest(transform(x), c)
                dist = [int(v) if v < 1 << 63 else None for v in dist] if dist.dtype == object else dist
                yield pa.RecordBatch.from_arrays([s.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(dist, pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the centroids as integer vectors.

    Vectors are read in each round; a task returns k sums, whatever it read, and
    k rows reach the driver. All arithmetic is on integers, so neither the
    partitions nor a retried task change a result.

    Vectors that are null, not of 64 components, or hold null or non-finite
    components take no part, nor do those above `WIDEST`. A null vec_id is
    assigned but starts no cluster. Repeated rows count as often as they come
    and may start clusters that coincide, of which the one with the smaller
    number gets all. With fewer than k vectors there are as many clusters as
    vectors; an empty table gives an empty result, and one with null ids only,
    which nothing starts, too. A distance beyond a long is null. Only the
    columns vec_id and embedding are read.
    """
    rows = kept(vectors, scale)
    c = starts(rows, k, seed, scale)
    if not len(c):
        return rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), c
    for _ in range(rounds):
        c = moved(rows, c, scale)
    return assigned(rows, c, scale), c


def digest(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, the distances summed over its cluster and over all, and a check sum of its centroid.

    A sum beyond a long is null; null distances are left out of it. The table
    of clusters has k rows and is broadcast.
    """
    spark = vectors.sparkSession
    rows, c = kmeans(vectors, k, rounds, seed, scale)
    rows = stored(rows, "clusters")
    found = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}   # k rows
    known = [s for s in found.values() if s is not None]

    def whole(s) -> int | None:
        return int(s) if s is not None and s < 1 << 63 else None

    per = spark.createDataFrame([(i, whole(s), whole(sum(known)), hashlib.sha256(",".join(map(str, c[i])).encode()).hexdigest()) for i, s in found.items()],
                                "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> str:
    """The same clusters by plain distances of all pairs."""
    steps = [f"""
v as materialized (
  select row_number() over (order by vec_id) as r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)) as x
  from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {DIM}),
c0 as materialized (
  select row_number() over (order by sha256('{seed}:' || vec_id::varchar), x) - 1 as cluster, x
  from v where vec_id is not null
  qualify cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} as materialized (
  select r, first(cluster order by d, cluster) as cluster, min(d) as distance
  from (select v.r, c.cluster, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) as d from v cross join c{i} c)
  group by r)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} as materialized (
  select c.cluster, coalesce(m.x, c.x) as x
  from c{i} c left join (
    select cluster, list(q order by i) as x
    from (select a.cluster, i, floor(sum(v.x[i]) / count(*)) as q
          from v join a{i} a using (r) cross join range(1, {DIM + 1}) t(i) group by a.cluster, i)
    group by cluster) m using (cluster))""")
    return f"""with {",".join(steps)}
select v.vec_id, a.cluster::integer as cluster, a.distance::bigint as distance,
  (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: e::bigint::varchar), ',')) as centroid_sha256
from a{rounds} a join v using (r) join c{rounds} c using (cluster)"""


SQL = _sql()
