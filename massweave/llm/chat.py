"""Preference formatting: shared prompt once, paired completions with their masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Role whose words are learned.
LEARNED = "assistant"


def conversation(turns: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, turns): each conversation's turns in order, as one array of (role, text).

    Order is by turn, nulls first, then role and text. A null text is empty, a
    null role is "unknown". Rows without `pair` belong to no conversation.
    """
    t = turns.filter(F.col(pair).isNotNull()).select(
        F.col(pair).cast("long").alias("pair"), F.struct(
            F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return t.groupBy("pair").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "pair", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns that are equal (role and text) from the start of both."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def masks(turns: Column) -> Column:
    """Stretches [start, end) of a rendered completion that are learned: a learned turn's text and its close."""
    sizes = F.transform(turns, lambda t: F.struct(
        F.length(rendered(t)).alias("all"), (F.lit(len(OPEN) + 1) + F.length(t["role"])).alias("lead"), (t["role"] == LEARNED).alias("learned")))
    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.expr("array_repeat(named_struct('start', 0, 'end', 0), 0)").alias("out")),
                       lambda acc, s: F.struct((acc["at"] + s["all"]).alias("at"), F.when(s["learned"], F.concat(acc["out"], F.array(F.struct(
                           (acc["at"] + s["lead"]).alias("start"), (acc["at"] + s["all"]).alias("end"))))).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])


def preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """One row per pair that has both sides: pair_id, shared, prompt, chosen, rejected, chosen_mask, rejected_mask.

    `chosen` and `rejected` hold turns (pair, turn, role, text). The longest
    common turn prefix is rendered once, as prompt, and never learned; each
    side's remaining turns are its completion, with the stretches of code
    points to learn: assistant texts with their close. A conversation that is
    a prefix of the other, or equal to it, has an empty completion and an empty
    mask; two without a common turn have an empty prompt.

    Null roles and texts, order and repeated turns are as `conversation` says;
    a pair with one side only is left out; other columns are not read; empty
    tables give an empty result.
    """
    a = conversation(chosen, pair).select("pair", F.col("turns").alias("a"))
    b = conversation(rejected, pair).select("pair", F.col("turns").alias("b"))
    p = a.join(b, "pair").select("pair", "a", "b", common_prefix(F.col("a"), F.col("b")).alias("shared"))

    def rest(c: str) -> Column:
        return F.slice(c, F.col("shared") + 1, F.greatest(F.size(c) - F.col("shared"), F.lit(0)))

    p = p.select("pair", "shared", F.slice("a", F.lit(1), F.col("shared")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return p.select(F.col("pair").alias("pair_id"), "shared", render(F.col("p")).alias("prompt"), render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"),
                    masks(F.col("a")).alias("chosen_mask"), masks(F.col("b")).alias("rejected_mask"))


def sides(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chosen and a rejected conversation of each id of a table of plain conversations.

    Chosen is the conversation itself. In the rejected one the last assistant
    turn gives the answer of the first, and where the conversation has a single
    assistant turn that answer is empty.
    """
    c = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    role = F.col("role") == LEARNED
    ends = c.filter(F.col("pair_id").isNotNull() & role).groupBy("pair_id").agg(
        F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("first"), F.max("turn").alias("last"))
    text = F.when(role & (F.col("turn") == F.col("last")), F.when(F.col("first.turn") < F.col("last"), F.col("first.text")).otherwise("")).otherwise(F.col("text"))
    return c, c.join(ends, "pair_id", "left").select("pair_id", "turn", "role", text.alias("text"))


def digest(p: DataFrame) -> DataFrame:
    """pair_id, shared, the md5 of prompt and completions, and the learned code points of each side."""
    def learned(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))

    def stretches(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return p.select("pair_id", "shared", *[F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("prompt", "chosen", "rejected")],
                    stretches("chosen_mask").alias("chosen_mask"), stretches("rejected_mask").alias("rejected_mask"),
                    learned("chosen_mask").alias("chosen_learned"), learned("rejected_mask").alias("rejected_learned"))


def _side(name: str) -> str:
    one = f"'{OPEN}' || r || chr(10) || x || '<|im_end|>' || chr(10)"
    return f"""
{name}1 AS (SELECT k.pair, unnest({name}[shared + 1:]) AS t, generate_subscripts({name}[shared + 1:], 1) AS i FROM k WHERE len({name}) > shared),
{name}2 AS (SELECT pair, i, t.r AS r, {one.replace(' r ', ' t.r ').replace(' x ', ' t.x ')} AS s FROM {name}1),
{name}3 AS (SELECT *, sum(length(s)) OVER (PARTITION BY pair ORDER BY i) AS stop FROM {name}2),
{name}4 AS (SELECT pair, string_agg(s, '' ORDER BY i) AS text,
  coalesce(string_agg((stop - length(s) + {len(OPEN) + 1} + length(r))::BIGINT::VARCHAR || ':' || stop::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (r = '{LEARNED}'), '') AS mask,
  coalesce(sum(length(s) - {len(OPEN) + 1} - length(r)) FILTER (r = '{LEARNED}'), 0)::BIGINT AS learned FROM {name}3 GROUP BY pair)"""


SQL = f"""
WITH c AS (SELECT conv_id AS pair, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT pair, min({{'turn': turn, 'text': coalesce(text, '')}}) AS f, max(turn) AS last FROM c WHERE role = '{LEARNED}' GROUP BY pair),
j AS (SELECT c.pair, turn, coalesce(role, 'unknown') AS r, coalesce(text, '') AS x,
        CASE WHEN role = '{LEARNED}' AND turn = last THEN CASE WHEN f.turn < last THEN f.text ELSE '' END ELSE coalesce(text, '') END AS y FROM c LEFT JOIN e USING (pair)),
k0 AS (SELECT pair, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS a, list({{'r': r, 'x': y}} ORDER BY turn NULLS FIRST, r, y) AS b FROM j GROUP BY pair),
k AS (SELECT *, coalesce(list_position(list_transform(range(1, len(a) + 1), lambda i: a[i] = b[i]), false) - 1, len(a)) AS shared FROM k0),
p0 AS (SELECT pair, unnest(a[1:shared]) AS t, generate_subscripts(a[1:shared], 1) AS i FROM k WHERE shared > 0),
p AS (SELECT pair, string_agg('{OPEN}' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10), '' ORDER BY i) AS text FROM p0 GROUP BY pair),
{_side('a')},
{_side('b')}
SELECT k.pair AS pair_id, shared::INTEGER AS shared, md5(coalesce(p.text, '')) AS prompt_md5, md5(coalesce(a4.text, '')) AS chosen_md5, md5(coalesce(b4.text, '')) AS rejected_md5,
  coalesce(a4.mask, '') AS chosen_mask, coalesce(b4.mask, '') AS rejected_mask, coalesce(a4.learned, 0)::BIGINT AS chosen_learned, coalesce(b4.learned, 0)::BIGINT AS rejected_learned
FROM k LEFT JOIN p USING (pair) LEFT JOIN a4 USING (pair) LEFT JOIN b4 USING (pair)
"""
