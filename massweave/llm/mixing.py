"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

DataFrame functions only. The schedule has a fixed number of slots; a slot
stands for one block of words, so blocks grow with the corpus and the schedule
does not. A source's blocks are of one size: its target over its slots. Every
source gets slots enough, whatever its share of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massweave.llm.common import doc_key, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Slots of the schedule: the resolution of the mix.
SLOTS = 1 << 18
#: A source's stretch of the schedule is at least one in so many of the mix, so a small source's blocks are small.
FLOOR = 64
#: Slots there are at least for each source.
PER_SOURCE = 16
#: Golden-ratio points i * GOLDEN mod 2^31, exact in BIGINT.
GOLDEN, TURN = 1_327_217_885, 1 << 31
#: Hash ranges a source's shuffled order is cut into.
RANGES = 12                                           # bits
CELLS = 1 << 10
WEIGHTS = (3, 1, 2)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, key (names the text), source as (sk, sn), size, h: the shuffled place, bucket: its range."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("text")).alias("key"),
                    F.coalesce(F.col("source").cast("string"), F.lit("")).alias("sk"), F.isnull("source").alias("sn"),
                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")).cast("binary"))
    return d.select("*", h.alias("h")).select("*", F.conv(F.substring("h", 1, RANGES // 4), 16, 10).cast("int").alias("bucket"))


def targets(per: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: s (its rank), source_size, target, lo and hi (its stretch of the schedule), total (all stretches).

    A stretch is as long as the target, or the FLOOR-th part of the mix if that is
    longer; a source without words has none. The windows run over the sources, one row each, in one task.

    Filling by weight until a source holds `most` times its words: sources in
    order of size by weight are full as long as the level of the rest is above them.
    """
    src = per.groupBy("sk", "sn").agg(F.sum("words").alias("source_size"))
    rank = Window.orderBy("sn", "sk")
    w = F.get(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))))
    everything = Window.partitionBy()
    src = src.select("*", F.row_number().over(rank).alias("s"), w.cast("long").alias("w"), (F.sum("source_size").over(everything) * F.lit(share)).alias("total"))
    by = Window.orderBy(F.col("source_size") * F.lit(most) / F.col("w"), "s")
    full = F.col("source_size") * F.lit(most)
    src = src.select("*", ((F.col("total") - F.coalesce(F.sum(full).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
                           / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))).alias("level"), F.row_number().over(by).alias("i"))
    src = src.select("*", F.min(F.when(full > F.col("level") * F.col("w"), F.col("i"))).over(everything).alias("first"))
    src = src.select("*", F.max(F.when(F.col("i") == F.col("first"), F.col("level"))).over(everything).alias("rest"))
    t = F.when(F.col("i") < F.coalesce("first", F.lit(1 << 30)), full).otherwise(F.col("rest") * F.col("w"))
    src = src.select("sk", "sn", "s", "source_size", "total", t.alias("target"))
    src = src.select("*", F.when(F.col("target") > 0, F.greatest("target", F.col("total") / F.lit(float(FLOOR)))).otherwise(F.lit(0.0)).alias("wide"))
    run = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    src = src.select("*", F.sum("wide").over(run).alias("top"), F.max(F.when(F.col("wide") > 0, F.col("s"))).over(everything).alias("last"))
    src = src.select("*", F.max("top").over(everything).alias("all"))
    return src.select("sk", "sn", "s", "source_size", "target", F.col("all").alias("total"), (F.col("top") - F.col("wide")).alias("lo"),
                      F.when(F.col("s") == F.col("last"), F.col("all") * 2).otherwise(F.col("top")).alias("hi"))


def schedule(src: DataFrame, slots: int) -> DataFrame:
    """(i, s, chunk): the source that takes slot i.

    Slot i falls at the i-th golden-ratio point of the schedule; the source whose
    stretch holds the point gets it.
    """
    slot = src.sparkSession.range(slots).select(F.col("id").alias("i"), (F.col("id") * GOLDEN % TURN).alias("u"))
    slot = slot.select("i", "u", F.floor(F.col("u") / (TURN // CELLS)).cast("int").alias("cell"))
    stretch = src.filter("total > 0 and target > 0").select("*", F.explode(F.sequence(
        F.floor(F.col("lo") / F.col("total") * CELLS).cast("int"), F.least(F.floor(F.col("hi") / F.col("total") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    x = F.col("u") / F.lit(float(TURN)) * F.col("total")
    of = slot.join(stretch, "cell").filter((x >= F.col("lo")) & (x < F.col("hi")))
    return of.select("i", "s", F.shiftright("i", 11).alias("chunk"))


def uses(of: DataFrame, src: DataFrame) -> DataFrame:
    """(s, block, uses): how often the schedule takes each block of each source; the n-th slot of a source takes its block n modulo its number of blocks."""
    before = of.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("s").orderBy("chunk")
    before = before.select("s", "chunk", (F.sum("n").over(w) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("s", "chunk").orderBy("i")) - 1
    blocks = src.select("s", F.ceil(F.col("source_size") / F.col("beta")).alias("blocks"))
    ranked = of.join(before, ["s", "chunk"]).select("s", rank.alias("rank")).join(blocks, "s").filter("rank < 2 * blocks")
    return ranked.groupBy("s", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("uses"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, key (names the text), sk and sn (its source).

    Sources in code point order, null last, take `weights` in turn and share
    `share` of all words; a target stops at `most` (2 at least as the schedule
    goes) times its source's words. taken counts the words the schedule takes
    of a document, repeats included: never above twice its size. A source comes
    within a block a pass of its target, and a block is the target over the
    source's slots, which are about one in FLOOR + sources of all, or more. The
    schedule is longer where sources are so many that they need it.

    A null text has no word, and a document without words is taken nowhere. A
    null doc_id keeps its row. Rows that repeat are rows of their own that
    stand side by side in the shuffled order. Without any word all targets are
    0. An empty table gives an empty result. Other columns are not read.
    """
    d = stored(sizes(docs), "sizes")
    per = stored(d.groupBy("sk", "sn", "bucket").agg(F.sum("size").alias("words")), "ranges")
    src = stored(targets(per, share, most, weights), "targets")
    slots = max(slots, PER_SOURCE * src.count())
    of = stored(schedule(src, slots), "slots")
    beta = F.col("target") / F.col("n")                    # words of a block, not rounded
    src = stored(src.join(of.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s", "left").select("sk", "sn", "s", "source_size", "target", beta.alias("beta")), "blocks")
    order = Window.partitionBy("sk", "sn").orderBy("bucket")
    per = per.select("*", (F.sum("words").over(order) - F.col("words")).alias("ahead")).join(src, ["sk", "sn"])
    per = stored(per.select("sk", "sn", "bucket", "ahead", "s", "source_size", "target", "beta"), "ahead")
    w = Window.partitionBy("sk", "sn", "bucket").orderBy("h", "doc_id", "size", "key")
    d = d.join(per, ["sk", "sn", "bucket"]).select(
        "*", F.row_number().over(w).alias("r"),
        (F.col("ahead") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("end"))
    start, beta = F.col("end") - F.col("size"), F.col("beta")
    reach = F.when(F.col("size") > 0, F.sequence(
        F.greatest(F.floor(start / beta) - 1, F.lit(0)), F.floor(F.col("end") / beta) + 1))
    piece = d.select("*", F.explode_outer(reach).alias("block"))
    words = F.least(F.col("end"), F.floor((F.col("block") + 1) * beta)) - F.greatest(start, F.floor(F.col("block") * beta))
    piece = piece.select("*", words.alias("words")).filter("block is null or words > 0")
    same = ["sk", "sn", "bucket", "r", "doc_id", "key", "size", "source_size", "target"]
    taken = (piece.join(uses(of, src), ["s", "block"], "left").groupBy(*same)
             .agg(F.sum(F.coalesce(F.col("words") * F.col("uses"), F.lit(0))).cast("long").alias("taken")))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "key", "sk", "sn")


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, slots: int = SLOTS) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them: taken by size, rounded.

    Only a document at the edge of its source's last pass is taken in part; it
    is taken whole if at least half of it is.
    """
    names = ["k", "n", "key", "sk", "sn"]
    m = mix(docs, share, most, weights, slots)
    m = m.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.isnull("doc_id").alias("n"), "key", "sk", "sn",
                 F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).alias("copies"))
    m = stored(m.groupBy(*names).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0"), "copies")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"),
                    F.isnull("doc_id").alias("n"), doc_key(F.col("text")).alias("key"),
                    F.coalesce(F.col("source").cast("string"), F.lit("")).alias("sk"), F.isnull("source").alias("sn"))
    r = F.row_number().over(Window.partitionBy(*names).orderBy("key"))
    d = d.join(m, names).select("row", "copies", "rows", r.alias("r"))
    times = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("r") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    return d.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("one")).select("row.*")


SQL = f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM documents),
h AS (SELECT *, md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)) AS h FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS s, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, CASE (s - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / w, s) AS i FROM s2),
s4 AS (SELECT a.*, (a.total - coalesce((SELECT sum(b.source_size) * 2.0::DOUBLE FROM s3 b WHERE b.i < a.i), 0)) / (SELECT sum(b.w) FROM s3 b WHERE b.i >= a.i) AS level FROM s3 a),
s5 AS (SELECT min(i) AS first FROM s4 WHERE source_size * 2.0::DOUBLE > level * w),
s6 AS (SELECT s4.*, CASE WHEN i < coalesce(first, 1 << 30) THEN source_size * 2.0::DOUBLE ELSE (SELECT level FROM s4 z WHERE z.i = first) * w END AS target FROM s4, s5),
w6 AS (SELECT *, CASE WHEN target > 0 THEN greatest(target, total / {float(FLOOR)}::DOUBLE) ELSE 0.0::DOUBLE END AS wide FROM s6),
s7 AS (SELECT a.*, (SELECT sum(b.wide) FROM w6 b WHERE b.s <= a.s) AS top FROM w6 a),
w7 AS (SELECT *, top - wide AS lo, max(top) OVER () AS every, CASE WHEN s = max(CASE WHEN wide > 0 THEN s END) OVER () THEN max(top) OVER () * 2 ELSE top END AS hi FROM s7),
slot AS (SELECT i, (i * {GOLDEN}) % {TURN} AS u FROM range({SLOTS}) r(i)),
of AS (SELECT slot.i, w7.s, row_number() OVER (PARTITION BY w7.s ORDER BY slot.i) - 1 AS rank
       FROM slot JOIN w7 ON u / {float(TURN)}::DOUBLE * every >= lo AND u / {float(TURN)}::DOUBLE * every < hi WHERE every > 0 AND target > 0),
s8 AS (SELECT w7.s, source, source_size, target, target / n AS beta, ceil(source_size / (target / n))::BIGINT AS blocks FROM w7 LEFT JOIN (SELECT s, count(*) AS n FROM of GROUP BY s) c USING (s)),
uses AS (SELECT s, rank % blocks AS block, count(*) AS uses FROM of JOIN s8 USING (s) WHERE rank < 2 * blocks GROUP BY ALL),
p AS (SELECT h.doc_id, h.size, s8.*, row_number() OVER () AS r,
             sum(h.size) OVER (PARTITION BY s8.s ORDER BY h.h, h.doc_id, h.size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop
      FROM h JOIN s8 ON h.source IS NOT DISTINCT FROM s8.source),
q AS (SELECT p.*, unnest(CASE WHEN size > 0 THEN range(greatest(floor((stop - size) / beta)::BIGINT - 1, 0), floor(stop / beta)::BIGINT + 2) ELSE [-1] END) AS block FROM p),
x AS (SELECT q.*, CASE WHEN size = 0 THEN 0 ELSE least(stop, floor((block + 1) * beta)::BIGINT) - greatest(stop - size, floor(block * beta)::BIGINT) END AS words FROM q)
SELECT x.doc_id, x.size::BIGINT AS size, x.source_size, x.target, sum(CASE WHEN words > 0 THEN words * coalesce(uses, 0) ELSE 0 END)::BIGINT AS taken
FROM x LEFT JOIN uses ON uses.s = x.s AND uses.block = x.block GROUP BY x.r, x.doc_id, x.size, x.source_size, x.target
"""
