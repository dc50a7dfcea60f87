"""Conversation repair: cheapest edits to a legal order of roles, by block tables over normalised cost vectors (Four Russians)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.llm.common import stored

#: What is written so far: nothing, a system turn, up to a user turn, up to an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that may be put next, and where it leads.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where keeping a row leads, by the class of its role's initial (s, u, a, other); states left out allow no keeping.
KEEP = ({NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Symbols: four classes of initials, whole or truncated. Rows that must go are no symbol: their edit is D in any state.
SYMBOLS = 8
#: Symbols per block, and records per group of rows.
LENGTH, GROUP_BITS = 4, 12
#: White space, as the faults have it.
BLANK = "\t\n\x0b\x0c\r "


def closed(g: list[int]) -> list[int]:
    """Costs to go, with turns put in before the next row."""
    for _ in range(2):
        g = [min(c, INSERT + g[NEXT[q]]) for q, c in enumerate(g)]
    return g


def ways(symbol: int, after: list[int], q: int) -> dict[str, tuple[int, int]]:
    """(cost to go, next state) of each edit of one row, by letter."""
    role, late = symbol % 4, TRUNCATED * (symbol // 4)
    out = {"D": (DELETE + after[q], q), "R": (REROLE + late + after[NEXT[q]], NEXT[q])}
    if q in KEEP[role]:
        out["K"] = (late + after[KEEP[role][q]], KEEP[role][q])
    return out


class Tables(NamedTuple):
    """`step`, `end`, `edit`: vector before, state after and letters of one row. `block`, `through`: the same of `LENGTH` rows, without letters."""
    step: np.ndarray
    end: np.ndarray
    edit: list
    block: np.ndarray
    through: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    """All normalised vectors of costs to go, and their transitions over every symbol and every block of symbols.

    Vector 0 is that of a conversation's end. Costs to go differ between states
    by what a few insertions cost, so there are few vectors. Ties go to the
    smaller letter, which is the smaller audit: what follows a state costs the
    same whichever letter led there.
    """
    vectors = [tuple(closed([0, INSERT * 2, INSERT, 0]))]
    step, end, edit = [], [], []
    for v in vectors:                                        # grows while it runs
        step.append([]), end.append([]), edit.append([])
        for s in range(SYMBOLS):
            g = closed([min(c for c, _ in ways(s, v, q).values()) for q in range(4)])
            ends, letters = [], []
            for q in range(4):
                at, put = q, ""
                while True:
                    best = {e: n for e, (c, n) in ways(s, v, at).items() if c == g[at]}
                    if INSERT + g[NEXT[at]] == g[at]:
                        best["I"] = NEXT[at]
                    e = min(best)
                    at, put = best[e], put + e
                    if e != "I":
                        break
                ends.append(at), letters.append(put)
            g = tuple(c - min(g) for c in g)
            if g not in vectors:
                vectors.append(g)
            step[-1].append(vectors.index(g)), end[-1].append(ends), edit[-1].append(letters)
    step, end = np.array(step), np.array(end)
    n, codes = len(vectors), np.arange(SYMBOLS ** LENGTH)
    symbol = [codes // SYMBOLS ** (LENGTH - 1 - i) % SYMBOLS for i in range(LENGTH)]
    right = [np.repeat(np.arange(n)[:, None], len(codes), 1)]
    for s in reversed(symbol):
        right.append(step[right[-1], s])
    through = np.repeat(np.repeat(np.arange(4)[None, None], len(codes), 1), n, 0)
    for i, s in enumerate(symbol):
        through = end[right[LENGTH - 1 - i][:, :, None], s[None, :, None], through]
    return Tables(step, end, edit, right[-1], through)


def codes(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols before the first whole block, and the blocks' codes; blocks end where the run ends."""
    cut = len(run) % LENGTH
    return run[:cut], run[cut:].reshape(-1, LENGTH) @ (SYMBOLS ** np.arange(LENGTH - 1, -1, -1))


def summary(run: np.ndarray) -> np.ndarray:
    """Per vector at the run's end: the vector before the run, and the state after it for each state before."""
    t = tables()
    head, blocks = codes(run)
    at = np.arange(len(t.step))
    ends = np.repeat(np.arange(4)[None], len(at), 0)
    rows = np.arange(len(at))[:, None]
    for c in blocks[::-1]:
        ends, at = ends[rows, t.through[at, c]], t.block[at, c]
    for s in head[::-1]:
        ends, at = ends[rows, t.end[at, s]], t.step[at, s]
    return np.column_stack([at, ends]).astype(np.int8)


def letters(run: np.ndarray, vector: int, state: int) -> list[str]:
    """Edits of a run's rows, for the vector at its end and the state before it.

    Vectors are found from the end, one lookup a block. Then the blocks are
    expanded against that direction, first row first, so that the smaller of
    two equally cheap letters is known when it is needed.
    """
    t = tables()
    head, blocks = codes(run)
    ends = [vector]
    for c in blocks[::-1]:
        ends.append(int(t.block[ends[-1], c]))
    out, cut = [], len(head)
    parts = [(head, ends[-1])] + [(run[cut + LENGTH * i:cut + LENGTH * (i + 1)], ends[len(blocks) - 1 - i]) for i in range(len(blocks))]
    for symbols, v in parts:
        right = []
        for s in symbols[::-1]:
            right.append(v)
            v = t.step[v, s]
        for s, v in zip(symbols, reversed(right)):
            out.append(t.edit[v][s][state])
            state = t.end[v, s, state]
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, m): rows after damage, equal ones once with their number."""
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("hit") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    return (rows.select("conv_id", "turn", "role", "text", hit.alias("hit")).filter("hit <> 0")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                    F.when(F.col("hit") == 3, 2).otherwise(1).alias("m"))
            .groupBy("conv_id", "turn", "role", "text").agg(F.sum("m").alias("m")))


def placed(rows: DataFrame) -> DataFrame:
    """`rows` in order of conversation, turn (nulls first), role and text, with `pos`, a number that grows in this order.

    Rows are dealt by range, so that a conversation of any size is spread.
    """
    lead = ["conv_id", "turn", "role", F.substring("text", 1, 32)]
    return (rows.repartitionByRange(*lead).sortWithinPartitions(*lead, "text")
            .withColumn("pos", F.monotonically_increasing_id()))


def runs(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Stretches of one conversation in a group of records (conv_id, pos, symbol), and their symbols."""
    t = t.sort_by("pos")
    conv = t.column("conv_id").to_pylist()
    symbol = t.column("symbol").to_numpy()
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield t.slice(lo, hi - lo), symbol[lo:hi]


def at_ends(t: pa.Table) -> pa.Table:
    """(conv_id, block, table): the summary of a group's first and last run, which may go on in other groups."""
    all_runs = list(runs(t))
    ends = all_runs[:1] + all_runs[1:][-1:]
    return pa.table({"conv_id": pa.array([r.column("conv_id")[0].as_py() for r, _ in ends], pa.int64()),
                     "block": pa.array([r.column("block")[0].as_py() for r, _ in ends], pa.int64()),
                     "table": pa.array([summary(s).tobytes() for _, s in ends], pa.binary())})


def edited(t: pa.Table, known: pa.Table) -> pa.Table:
    """(pos, edit) of a group's records; `known` holds vector and state of the runs at its ends."""
    of = dict(zip(known.column("conv_id").to_pylist(), zip(known.column("vector").to_pylist(), known.column("state").to_pylist())))
    pos, edit = [], []
    for r, s in runs(t):
        pos += r.column("pos").to_pylist()
        edit += letters(s, *of.get(r.column("conv_id")[0].as_py(), (0, NOTHING)))
    return pa.table({"pos": pa.array(pos, pa.int64()), "edit": pa.array(edit, pa.string())})


def from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of conversations, last first, to (conv_id, block, vector, ends); keeps one vector from row to row."""
    last, vector = (), 0
    for b in batches:
        vectors, ends = [], []
        for conv, table in zip(b.column("conv_id").to_pylist(), b.column("table").to_pylist()):
            if (conv,) != last:
                last, vector = (conv,), 0
            row = np.frombuffer(table, np.int8).reshape(-1, 5)[vector]
            vectors.append(vector)
            ends.append(row[1:].tobytes())
            vector = int(row[0])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(vectors, pa.int32()), pa.array(ends, pa.binary())],
                                         names=["conv_id", "block", "vector", "ends"])


def from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of conversations, first first, to (conv_id, block, vector, state); keeps one state from row to row."""
    last, state = (), NOTHING
    for b in batches:
        states = []
        for conv, ends in zip(b.column("conv_id").to_pylist(), b.column("ends").to_pylist()):
            if (conv,) != last:
                last, state = (conv,), NOTHING
            states.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), b.column("vector"), pa.array(states, pa.int32())],
                                         names=["conv_id", "block", "vector", "state"])


def edits(records: DataFrame) -> DataFrame:
    """(pos, edit) of `records` (conv_id, pos, symbol): I for each turn put in before the row, then K, R or D.

    Records go in groups of neighbours. A conversation that is within one group
    is done there. Of others each group gives one summary of a few hundred
    bytes; a pass over these from the end finds the vector at the end of each
    group's part, and one from the start the state before it. Both passes
    stream: they hold one number per task.
    """
    records = records.withColumn("block", F.shiftright("pos", GROUP_BITS))
    open_runs = stored(records.groupBy("block").applyInArrow(at_ends, "conv_id long, block long, table binary"), "runs")
    back = (open_runs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
            .mapInArrow(from_the_end, "conv_id long, block long, vector int, ends binary"))
    known = stored(back.repartition("conv_id").sortWithinPartitions("conv_id", "block")
                   .mapInArrow(from_the_start, "conv_id long, block long, vector int, state int"), "states")
    return records.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(edited, "pos long, edit string")


class Report:
    """One conversation's result, row by row in order; holds the audit and a running hash, no row."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.audit = conv, NOTHING, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.low = self.high = self.before = None
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1

    def put(self) -> None:
        self.state = NEXT[self.state]
        self.cost += INSERT
        self.line("user" if self.state == USER else "assistant", "")

    def row(self, turn, role: str, text: str, m: int, fault: str, symbol: int, edit: str | None) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        first = role[:1]
        if self.before is not None:
            self.illegal += self.before + first not in ("su", "ua", "au")
        self.illegal += m - 1                                # a role never follows itself
        self.before = first
        self.blank += m if fault == "blank" else 0
        self.duplicate += m if fault == "duplicate" else m - 1 if fault != "blank" else 0
        self.truncated += fault == "truncated"
        edit = edit or "D"
        for _ in edit[:-1]:
            self.put()
        if edit[-1] == "D":
            self.cost += DELETE
        else:
            if edit[-1] == "K":
                self.state = KEEP[symbol % 4][self.state]
            else:
                self.state = NEXT[self.state]
                role = "user" if self.state == USER else "assistant"
                self.cost += REROLE
            self.cost += TRUNCATED * (fault == "truncated")
            self.line(role, text)
        self.cost += DELETE * (m - 1)
        self.audit.append(edit + "D" * (m - 1))

    def values(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self.put()
            self.audit.append("I")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.hash.hexdigest())


REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                   ("audit", pa.string()), ("repaired_sha256", pa.string())])


def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by conversation and place to one row per conversation."""
    one, done = None, []
    for b in batches:
        for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
            if one is None or conv != one.conv:
                if one is not None:
                    done.append(one.values())
                one = Report(conv)
            one.row(*row)
        yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, r)) for r in done], ARROW)
        done = []
    if one is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(ARROW.names, one.values()))], ARROW)


def repair(turns: DataFrame) -> DataFrame:
    """One row per conv_id of `turns` (conv_id, turn, role, text): faults, cheapest edits and a check sum of the repaired rows.

    Rows are damaged first, as `damaged` says. Rows of one turn go by role and
    text. A null role or text is one space, so such a text is blank and such a
    role must change; an empty role has no initial, which is never legal. A
    null conv_id is a conversation of its own, null turns come first. Repeated
    rows are duplicates of the first. A conversation without a row has zeros, an
    empty audit and the hash of nothing; an empty table gives an empty result.
    Gaps beyond a long are null. Other columns are not read.

    A conversation of any size is ordered, searched for duplicates and solved in
    parts. Only its check sum, which has an order by its nature, and its audit,
    which is one value, are put together in one task, from a stream of its rows.
    """
    rows = stored(placed(damaged(turns)), "turns")
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    slim = rows.select("conv_id", "role", "pos", F.sha2("text", 256).alias("print"), (end == "").alias("blank"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("whole"))
    first = slim.filter("not blank").groupBy("conv_id", "role", "print").agg(F.min("pos").alias("pos"))
    role = F.substring("role", 1, 1)
    kind = F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(3)
    symbol = kind + F.when(F.col("whole"), 0).otherwise(SYMBOLS // 2)
    records = stored(slim.join(first.select("pos"), "pos", "left_semi").select("conv_id", "pos", symbol.cast("int").alias("symbol")), "records")
    solved = edits(records).join(records.select("pos", "symbol"), "pos")
    fault = (F.when(end == "", "blank").when(F.col("symbol").isNull(), "duplicate").when(F.col("symbol") >= SYMBOLS // 2, "truncated").otherwise(""))
    done = (rows.join(solved, "pos", "left").select("conv_id", "turn", "role", "text", "m", fault.alias("fault"), "symbol", "edit", "pos")
            .repartition("conv_id").sortWithinPartitions("conv_id", "pos").drop("pos").mapInArrow(reports, REPORT))
    done = stored(done, "reports")
    convs = turns.select(F.col("conv_id").cast("long").alias("c")).distinct()
    return convs.join(done, convs.c.eqNullSafe(done.conv_id), "left").select(
        F.col("c").alias("conv_id"), *[F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(x)).alias(x)
                                       for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Costs by states and costs of all edits of one row, then of the end: turns put in, then K, R or D. States 0 to 3 as above.
_SQL_EDGES = """
moves(state, letter, initial, ending, cost) as (values
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
  (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (3, 'R', '', 2, 1), (2, 'R', '', 3, 1),
  (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2)),
puts(state, ending, letters, cost) as (values
  (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 5), (1, 2, 'I', 5), (3, 2, 'I', 5), (2, 3, 'I', 5),
  (0, 3, 'II', 10), (1, 3, 'II', 10), (2, 2, 'II', 10), (3, 3, 'II', 10)),
edges as (
  select p.state, p.letters || m.letter as letters, m.letter, m.initial, m.ending, p.cost + m.cost as cost
  from puts p join moves m on m.state = p.ending)"""

#: The same by a table of cheapest audits per state, row by row from the first; a state keeps cost and audit as one sortable text.
SQL = rf"""
with recursive {_SQL_EDGES.strip()},
crc(t) as materialized (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)))),
hits as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as hit
  from conversations cross join crc),
rows_after as (
  select conv_id, turn, case when hit = 4 then 'user' else role end as role,
    case hit when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from hits, range(case hit when 0 then 0 when 3 then 2 else 1 end) copies),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as stem
  from rows_after),
marked as materialized (
  select conv_id, turn, role, text, i, left(role, 1) as initial,
    case when stem = '' then 'blank'
      when i > min(i) over (partition by conv_id, role, text) then 'duplicate'
      when right(stem, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by i) as before
  from numbered),
best(conv_id, i, state, code) as (
  select conv_id, 0::bigint, 0, '0000000000' from (select distinct conv_id from marked)
  union all
  select b.conv_id, b.i + 1, e.ending,
    min(lpad((left(b.code, 10)::bigint + e.cost + case when m.fault = 'truncated' and e.letter <> 'D' then 5 else 0 end)::varchar, 10, '0') || substr(b.code, 11) || e.letters)
  from best b join marked m on m.conv_id is not distinct from b.conv_id and m.i = b.i + 1
  join edges e on e.state = b.state and (e.letter = 'D' or m.fault not in ('blank', 'duplicate')) and (e.letter <> 'K' or e.initial = m.initial)
  group by b.conv_id, b.i + 1, e.ending),
solved as materialized (
  select conv_id, left(code, 10)::bigint as cost, substr(code, 11) as audit
  from (select b.conv_id, min(lpad((left(b.code, 10)::bigint + p.cost)::varchar, 10, '0') || substr(b.code, 11) || p.letters) as code
        from best b join (select conv_id, max(i) as n from marked group by conv_id) z on z.conv_id is not distinct from b.conv_id and b.i = z.n
        join puts p on p.state = b.state and p.ending in (0, 3) group by b.conv_id)),
letters as (
  select conv_id, k, substr(audit, k, 1) as letter from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as k from solved)),
placed as (
  select *, sum((letter <> 'I')::bigint) over (partition by conv_id order by k) as i from letters),
kept as (
  select p.conv_id, p.k, p.letter, m.role, m.text, max(case when p.letter = 'K' and m.initial = 's' then 1 else 0 end) over (partition by p.conv_id) as lead,
    row_number() over (partition by p.conv_id order by p.k) as o
  from placed p left join marked m on m.conv_id is not distinct from p.conv_id and m.i = p.i and p.letter <> 'I' where p.letter <> 'D'),
texts as (
  select conv_id, string_agg(case when letter = 'K' then role when (o - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by k) as t
  from kept group by conv_id),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id)
select c.conv_id, coalesce(f.gaps, 0) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated,
  coalesce(f.illegal, 0) as illegal, coalesce(s.cost, 0) as cost, coalesce(s.audit, '') as audit, sha256(coalesce(t.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join facts f on f.conv_id is not distinct from c.conv_id
left join solved s on s.conv_id is not distinct from c.conv_id
left join texts t on t.conv_id is not distinct from c.conv_id
"""
