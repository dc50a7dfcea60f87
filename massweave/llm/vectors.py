"""Nearest neighbours: an inverted multi-index over vector halves, and exact Hamming search by growing radii."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import stored

#: Vectors and queries that meet in one task.
ROWS, QUERIES = 4096, 1024


def usable(vec: Column) -> Column:
    """Not null, not empty, no null, NaN or infinite component, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array of double) of the usable vectors of the most frequent length (of equally frequent ones the shortest)."""
    t = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    t = stored(t, "vectors")
    dim = t.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return t.filter(F.size("v") == (dim[0]["d"] if dim else 0))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks()
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 0))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids of a bounded sample; fewer than `k` where it has fewer different rows."""
    u = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = u[np.sort(rng.choice(len(u), min(k, len(u)), replace=False))]
    for _ in range(rounds):
        of = nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, of, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


class MultiIndex:
    """Two codebooks, one for each half of the vectors, and the rows in each pair of centroids."""

    def __init__(self, sample: np.ndarray, centroids: int, rounds: int = 12, seed: int = 42):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(part, centroids, rounds, seed) if part.shape[1] else np.zeros((1, 0)) for part in self.halves(sample)]
        self.sizes = np.zeros([len(b) for b in self.books], dtype=np.int64)

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.half], x[:, self.half:]]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(part, book) for part, book in zip(self.halves(x), self.books))
        return a * len(self.books[1]) + b

    def deal(self) -> int:
        """Give the cells to blocks of about ROWS rows, in order, large cells to several blocks; the number of blocks."""
        self.first = np.zeros(self.sizes.size, dtype=np.int64)
        self.split = np.ones(self.sizes.size, dtype=np.int64)
        block, filled = 0, 0
        for c, n in enumerate(self.sizes.ravel().tolist()):
            if filled and filled + n > ROWS:
                block, filled = block + 1, 0
            self.first[c], self.split[c] = block, max(1, -(-n // ROWS))
            filled += n
            if n > ROWS:
                block, filled = block + int(self.split[c]), 0
        return block + 1

    def blocks_of(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Block of each row; the rows of a large cell are dealt by a hash of their id."""
        with np.errstate(over="ignore"):
            h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[cells] + (h % self.split[cells].astype(np.uint64)).astype(np.int64)

    def visits(self, q: np.ndarray, budget: int) -> list[dict]:
        """The blocks that hold the cells of a traversal, each with those cells."""
        by: dict[int, list[int]] = {}
        for c, _ in self.traverse(q, budget):
            for b in range(int(self.first[c]), int(self.first[c] + self.split[c])):
                by.setdefault(b, []).append(c)
        return [{"block": b, "cells": sorted(cells)} for b, cells in sorted(by.items())]

    def traverse(self, q: np.ndarray, budget: int):
        """Cells in order of summed distance of the halves (the negative inner product) until they hold `budget` rows."""
        d = [-(book @ part) for book, part in zip(self.books, (q[:self.half], q[self.half:]))]
        order = [np.argsort(x, kind="stable") for x in d]
        heap, seen, got = [(d[0][order[0][0]] + d[1][order[1][0]], 0, 0)], {(0, 0)}, 0
        while heap and got < budget:
            _, i, j = heapq.heappop(heap)
            a, b = order[0][i], order[1][j]
            n = int(self.sizes[a, b])
            if n:
                got += n
                yield int(a * len(self.books[1]) + b), got
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(order[0]) and y < len(order[1]) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (d[0][order[0][x]] + d[1][order[1][y]], x, y))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one vector with many, added in the order of the components: equal vectors get equal sums."""
    s = np.zeros(len(v))
    for j in range(len(q)):
        s += q[j] * v[:, j]
    return s


def best_of(qid: int, q: np.ndarray, ids: np.ndarray, v: np.ndarray, rough: np.ndarray, k: int):
    """The `k` best (score, id) of the rows: exact scores of all that a rounding error could bring among them."""
    own = ids != qid
    if not own.any():
        return np.zeros(0), np.zeros(0, dtype=np.int64)
    r = np.where(own, rough, -np.inf)
    m = int(own.sum())
    cut = np.partition(r, len(r) - k)[len(r) - k] if m > k else -np.inf
    slack = 1e-9 * (1 + np.abs(rough).max())
    at = np.flatnonzero(own & (r >= cut - slack))
    s = products(q, v[at])
    o = np.lexsort((ids[at], -s))[:k]
    return s[o], ids[at][o]


def top(df: DataFrame, k: int, measure: Column) -> DataFrame:
    """The first `k` of each query by `measure`, then vec_id; Spark limits before it shuffles."""
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(measure, "vec_id")
    return df.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


FOUND = "query_id long, vec_id long, score double"


def no_rows(names: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.table({n.split()[0]: pa.array([], kinds[n.split()[1]]) for n in names.split(", ")})


def search(table: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           centroids: int = 24, sample: int = 8192, trial: int = 96, reach: float = 0.985) -> DataFrame:
    """Nearest rows of the queries (id divisible by `every`) by inner product: query_id, rank, vec_id, score.

    Codebooks are fitted on a bounded sample, every row is indexed. How many
    rows a query's traversal must cover is measured: for `trial` sampled
    queries the true neighbours are found by brute force, and the share of rows
    that covers a neighbour's cell in the proportion `reach` of cases is taken
    for all. Rows of the visited cells are scored exactly on the original
    vectors. Rows meet in blocks of bounded size the queries that
    visit one of the block's cells; a cell or vector of any weight is spread
    over blocks.

    Vectors null, empty, zero or with null or non-finite components take no
    part, nor do rows without id and vectors of another length than the most
    frequent. Repeated ids are rows of their own; a query never meets rows of
    its own id. Fewer candidates than `k` are all returned; an empty table
    gives none.
    """
    spark = table.sparkSession
    rows = vectors(table, id_col, vec_col)
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    index = MultiIndex(matrix(fit.column("v")), centroids)

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(index.cells(x).astype(np.int32))], names=["id", "v", "cell"])

    placed = stored(rows.mapInArrow(place, "id long, v array<double>, cell int"), "cells")
    width = len(index.books[1])
    for r in placed.groupBy("cell").count().collect():                     # at most centroids squared
        index.sizes[r["cell"] // width, r["cell"] % width] = r["count"]
    query = placed.filter(F.col("id") % every == 0).select("id", "v").distinct()
    budget = measured(placed, index, query, trial, k, reach, n)

    index.deal()
    lists = -(-max(1, query.count()) // QUERIES)
    visit_type = pa.list_(pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))]))

    def visit(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([index.visits(v, budget) for v in x], visit_type)], names=["id", "v", "visits"])

    def deal(batches):
        for b in batches:
            block = index.blocks_of(b.column("cell").to_numpy(), b.column("id").to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block)], names=["id", "v", "cell", "block"])

    q = query.mapInArrow(visit, "id long, v array<double>, visits array<struct<block int, cells array<int>>>")
    q = q.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(lists)).cast("int").alias("lot"), F.explode("visits").alias("visit"))
    q = q.select("id", "v", "lot", "visit.block", F.col("visit.cells").alias("visits"))
    v = placed.mapInArrow(deal, "id long, v array<double>, cell int, block int").select("*", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("lot"))

    def score(qs: pa.Table, vs: pa.Table) -> pa.Table:
        if not len(qs) or not len(vs):
            return no_rows(FOUND)
        cell = vs.column("cell").combine_chunks().to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, ids, x = cell[order], vs.column("id").combine_chunks().to_numpy()[order], matrix(vs.column("v"))[order]
        qx = matrix(qs.column("v"))
        first = np.searchsorted(cell, np.arange(width * len(index.books[0]) + 1))
        rough = qx @ x.T
        out = [[], [], []]
        for i, (qid, visits) in enumerate(zip(qs.column("id").to_pylist(), qs.column("visits"))):
            c = visits.values.to_numpy()
            c = c[first[c + 1] > first[c]]
            if not len(c):
                continue
            at = np.concatenate([np.arange(first[j], first[j + 1]) for j in c])
            s, found = best_of(qid, qx[i], ids[at], x[at], rough[i, at], k)
            out[0].append(np.full(len(s), qid, dtype=np.int64))
            out[1].append(found)
            out[2].append(s)
        if not out[0]:
            return no_rows(FOUND)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(o)) for o in out))))

    found = q.groupBy("block", "lot").cogroup(v.groupBy("block", "lot")).applyInArrow(score, FOUND)
    return top(found, k, F.desc("score")).select("query_id", "rank", "vec_id", "score")


def measured(placed: DataFrame, index: MultiIndex, query: DataFrame, trial: int, k: int, reach: float, n: int) -> int:
    """Rows a traversal must cover so that a true neighbour's cell is among them in the proportion `reach` of cases."""
    few = query.orderBy(F.xxhash64("id", F.lit("trial")), "id").limit(trial).toArrow()
    qid, qx = few.column("id").to_pylist(), matrix(few.column("v"))

    def brute(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                ids, cell = b.column("id").to_numpy(), b.column("cell").to_numpy()
                rough = qx @ x.T
                out = [[], [], []]
                for i, own in enumerate(qid):
                    r = np.where(ids == own, -np.inf, rough[i])
                    at = np.argsort(-r, kind="stable")[:k]
                    at = at[r[at] > -np.inf]
                    out[0].append(np.full(len(at), own, dtype=np.int64))
                    out[1].append(cell[at].astype(np.int64))
                    out[2].append(r[at])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["query_id", "vec_id", "score"])

    near = top(placed.mapInArrow(brute, FOUND), k, F.desc("score")).collect() if len(qid) else []   # trial times k rows
    wanted: dict[int, list[int]] = {}
    for r in near:
        wanted.setdefault(r["query_id"], []).append(r["vec_id"])
    need = []
    for i, own in enumerate(qid):
        covered = dict(index.traverse(qx[i], n))
        need += [covered[c] for c in wanted.get(own, [])]
    return int(np.quantile(need, reach, method="higher")) if need else n


# ---- exact search over binary codes -------------------------------------------
def codes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, code): the signs of the first 64 components as bits, component i at bit i; vectors that are not usable have none."""
    v = F.slice("v", F.lit(1), F.lit(64))
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    code = F.aggregate(F.reverse(bits), F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))
    t = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return t.filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", code.alias("code"))


class SegmentIndex:
    """Multi-index hashing over a block of 64-bit codes: one table for each of the segments."""

    def __init__(self, code: np.ndarray):
        self.code = code
        bits = max(8, min(16, int(np.log2(len(code) + 1))))
        self.parts = -(-64 // bits)
        edge = [64 * i // self.parts for i in range(self.parts + 1)]
        self.tables = []
        for lo, hi in zip(edge, edge[1:]):
            value = ((code >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.tables.append((lo, hi - lo, order, np.searchsorted(value[order], np.arange((1 << (hi - lo)) + 1))))
        size = max(hi - lo for lo, hi in zip(edge, edge[1:]))
        weight = np.array([x.bit_count() for x in range(1 << size)])
        self.flips = [np.flatnonzero(weight == r) for r in range(size + 1)]

    def nearest(self, q: int, k: int, allowed: np.ndarray):
        """Rows of the `k` smallest (distance, row) and their distances.

        Radius r has been searched in all segments once every segment value at
        r or fewer flips was looked up; any code not met then differs by r + 1
        or more in each segment. So once the k-th distance is below
        parts * (r + 1), no other code can come before it or tie with it.
        """
        met = np.zeros(len(self.code), dtype=bool)
        rows, dist = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for r, flips in enumerate(self.flips):
            for lo, width, order, first in self.tables:
                own = (q >> lo) & ((1 << width) - 1)
                f = flips[flips < (1 << width)] ^ own
                a, b = first[f], first[f + 1]
                full = np.flatnonzero(b > a)
                if len(full):
                    met[np.concatenate([order[a[i]:b[i]] for i in full])] = True
            rows = np.flatnonzero(met & allowed)
            dist = np.bitwise_count(self.code[rows] ^ np.uint64(q)).astype(np.int64)
            if len(rows) >= k and np.partition(dist, k - 1)[k - 1] < self.parts * (r + 1):
                break
        o = np.lexsort((rows, dist))[:k]
        return rows[o], dist[o]


HITS = "query_id long, vec_id long, distance int"


def hamming_search(table: DataFrame, every: int = 100, k: int = 10, id_col: str = "id", code_col: str = "code") -> DataFrame:
    """Exact `k` nearest codes of each query (id divisible by `every`): query_id, rank, vec_id, distance.

    Distance is the number of differing bits, ties go to the smaller id. Rows
    and queries meet in blocks of bounded size; a block's codes are indexed by
    segments, and search radii grow until the k-th verified distance is
    provably covered. The blocks' answers are merged.

    Rows with a null id or code take no part. A query never meets rows of its
    own id; repeated ids and codes are rows of their own. Fewer than `k` other
    rows are all returned. An empty table gives an empty result.
    """
    t = stored(table.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code")).filter("id is not null and code is not null"), "codes")
    n, m = t.agg(F.count(F.lit(1)), F.count_if(F.col("id") % every == 0)).first()
    blocks, lots = -(-max(n, 1) // ROWS), -(-max(m, 1) // QUERIES)
    q = t.filter(F.col("id") % every == 0).distinct().withColumn("lot", F.pmod(F.xxhash64("id", "code"), F.lit(lots)).cast("int"))
    q = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    v = t.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))

    def near(qs: pa.Table, vs: pa.Table) -> pa.Table:
        if not len(qs) or not len(vs):
            return no_rows(HITS)
        ids = vs.column("id").combine_chunks().to_numpy()
        order = np.argsort(ids, kind="stable")                             # row order is id order
        ids = ids[order]
        index = SegmentIndex(vs.column("code").combine_chunks().to_numpy().view(np.uint64)[order])
        out = [[], [], []]
        for qid, code in zip(qs.column("id").to_pylist(), qs.column("code").to_pylist()):
            rows, dist = index.nearest(code & (1 << 64) - 1, k, ids != qid)
            out[0].append(np.full(len(rows), qid, dtype=np.int64))
            out[1].append(ids[rows])
            out[2].append(dist.astype(np.int32))
        return pa.table(dict(zip(("query_id", "vec_id", "distance"), (pa.array(np.concatenate(o)) for o in out))))

    hits = q.groupBy("block", "lot").cogroup(v.groupBy("block", "lot")).applyInArrow(near, HITS)
    return top(hits, k, F.asc("distance")).select("query_id", "rank", "vec_id", "distance")


HAMMING_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
c AS (SELECT vec_id, array_to_string(list_transform(e[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM u),
q AS (SELECT vec_id AS query_id, bits AS qb FROM c WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id, hamming(qb, bits)::INTEGER AS distance FROM q JOIN c ON vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
