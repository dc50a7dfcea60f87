"""Repair against a table of cheapest audits in plain Python, on rows that are damaged by the same rule written anew."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from massweave.llm import repair

WS = " \t\n\x0b\x0c\r"
ORDER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(c for c in text if c not in ".!?")
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def solve(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, check sum of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        stem = text.strip(WS)
        faults.append("blank" if not stem else "duplicate" if (role, text) in seen else "" if stem[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}                                 # last initial written: cost, audit, lines

    def put(best):
        for _ in range(3):
            for q, (c, a, lines) in list(best.items()):
                n = "a" if q == "u" else "u"
                new = (c + 5, a + "I", (*lines, ("user:", "assistant:")[n == "a"]))
                if n not in best or new[:2] < best[n][:2]:
                    best[n] = new
        return best

    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for q, (c, a, lines) in put(best).items():
            late = 5 * (fault == "truncated")
            to = [(q, c + 2, a + "D", lines)]
            if fault not in ("blank", "duplicate"):
                if role[:1] in ORDER[q]:
                    to.append((role[:1], c + late, a + "K", (*lines, f"{role}:{text}")))
                for n, name in (("u", "user"), ("a", "assistant")):
                    if n in ORDER[q]:
                        to.append((n, c + late + 1, a + "R", (*lines, f"{name}:{text}")))
            for n, *x in to:
                if n not in new or tuple(x[:2]) < new[n][:2]:
                    new[n] = tuple(x)
        best = new
    cost, audit, lines = min(put(best)[q] for q in ("", "a") if q in best)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [x[2][:1] + y[2][:1] for x, y in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    left = after_damage(rows)
    return {c: solve([r for r in left if r[0] == c]) for c in {r[0] for r in rows}}


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("pos", "m", "fault", "edit", "block", "state", "symbol", "print"):
        df = df.selectExpr("*", f"1 as {c}")
    return df.repartition(3)


def got(df):
    out = [tuple(r) for r in repair.repair(df).collect()]
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: r[1:] for r in out}


def made(n, conv, seed, roles=("system", "user", "assistant", "assistant", "user", "tool", "", None, "s", "uXa"), turns=None):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "end. ", "mid. way", "ü?\t"]
    return [(conv, rng.choice([i, i, i, i // 2, None]) if turns is None else turns(i), rng.choice(roles),
             rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}" + rng.choice([".", ".", "!", "?", ""])) for i in range(n)]


def test_small_conversations_match_brute_force(spark):
    rows = [r for c in range(300) for r in made(random.Random(c).randint(1, 14), c, c)]
    rows += made(20, None, 999) + [(500, 0, "user", "Hi."), (500, 0, "user", "Hi."), (500, 0, "user", "Hi.")]
    rows += [(600 + i, None, None, None) for i in range(30)]
    df = frame(spark, rows)
    assert got(df) == brute(rows)


def test_long_conversations_go_on_across_groups(spark, monkeypatch):
    monkeypatch.setattr(repair, "GROUP_BITS", 4)             # groups of 16 rows
    plain = ("user", "assistant")
    rows = [r for c in range(40) for r in made(random.Random(c).choice([3, 5, 7, 18, 40, 300]), c, 50 + c, plain if c % 2 else ("system", *plain, "tool"))]
    rows += [(7777, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(2000)]
    df = frame(spark, rows)
    assert got(df) == brute(rows)


def test_sql_matches_brute_force():
    rows = [r for c in range(40) for r in made(random.Random(c).randint(1, 8), c, 200 + c)] + made(6, None, 5) + [(800 + i, None, None, None) for i in range(30)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(repair.SQL).fetchall()} == brute(rows)


def test_one_row_that_holds_all(spark):
    rows = [(1, None, "user", "Same.")] * 5000 + [(1, 3, "assistant", "x. " * 100_000)]
    df = frame(spark, rows)
    assert got(df) == brute(rows)


@pytest.mark.parametrize("length", [1, 3, 4, 5, 8, 9, 31])
def test_blocks_agree_with_single_steps(length):
    t, rng = repair.tables(), random.Random(length)
    for _ in range(30):
        run = np.array([rng.randrange(8) for _ in range(length)])
        s = repair.summary(run)
        for v in range(len(t.step)):
            at, rights = v, []
            for x in run[::-1]:
                rights.append(at)
                at = t.step[at, x]
            assert s[v, 0] == at
            for q in range(4):
                state, out = q, []
                for x, r in zip(run, reversed(rights)):
                    out.append(t.edit[r][x][state])
                    state = t.end[r, x, state]
                assert s[v, 1 + q] == state and repair.letters(run, v, q) == out


def test_nothing(spark):
    assert got(frame(spark, [(1, 1, "user", "x")]).limit(0)) == {}
