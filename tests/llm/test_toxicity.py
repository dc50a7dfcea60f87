"""Marginals against plain forward-backward and against all label sequences; scores by held-out accuracy; spans by offsets."""

import random
import zlib
from itertools import product

import numpy as np
import pytest

from massweave.llm import toxicity

BAD = ["grol", "snarf", "vexx"]


def plain(logits, steps):
    """Marginals and expected transitions by sums over all label sequences."""
    weight, p, pairs = 0.0, np.zeros(len(logits)), np.zeros((2, 2))
    for y in product((0, 1), repeat=len(logits)):
        before = (0, *y[:-1])
        w = np.exp(sum(x for x, v in zip(logits, y) if v) + sum(steps[i, j] for i, j in zip(before, y)))
        weight += w
        p += w * np.array(y)
        for i, j in zip(before, y):
            pairs[i, j] += w
    return p / weight, pairs / weight


def test_marginals_are_those_of_all_sequences():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 2, 0, 7, 9, 3, 0])
    logits, steps = rng.normal(-1, 3, sizes.sum()), rng.normal(0, 1, (2, 2))
    p, pairs = toxicity.marginals(logits, sizes, steps)
    want, total = [], np.zeros((2, 2))
    for x in np.split(logits, np.cumsum(sizes)[:-1]):
        if len(x):
            a, b = plain(x, steps)
            want += a.tolist()
            total += b
    assert np.allclose(p, want) and np.allclose(pairs, total)


@pytest.mark.parametrize("n", [63, 64, 65, 128, 1000])
def test_long_chains_are_exact_across_pieces(n):
    rng = np.random.default_rng(n)
    logits, steps = rng.normal(-1, 3, n), rng.normal(0, 1, (2, 2))
    a, e = np.exp(steps), np.column_stack([np.ones(n), np.exp(logits)])
    f, v = [], np.array([1.0, 0.0])
    for t in range(n):
        v = (v @ a) * e[t]
        v = v / v.sum()
        f.append(v)
    b, v = [None] * n, np.ones(2)
    for t in reversed(range(n)):
        b[t] = v
        v = a @ (e[t] * v)
        v = v / v.sum()
    want = [x[1] * y[1] / (x @ y) for x, y in zip(f, b)]
    other = rng.normal(0, 1, 100)                            # sequences do not touch each other
    p, pairs = toxicity.marginals(np.concatenate([other, logits, other]), np.array([100, n, 100]), steps)
    assert np.allclose(p[100:100 + n], want) and np.isclose(pairs.sum(), n + 200)


def corpus(n, seed=1):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "un", "sel", "vo", "ri"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "!", "er"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("key", "score", "held_out", "spans", "words", "toxic"):
        df = df.selectExpr("*", f"1 as {c}")
    return df.repartition(3)


def test_scores_and_spans_of_unseen_documents(spark):
    rows, labels = corpus(900)
    of = {i: t for i, _, t in labels}
    text = dict(rows)
    r = toxicity.classify(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(r) == len(rows)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and x.predicted == (x.score >= 0.7) for x in r)
    unseen = [x for x in r if x.held_out]
    assert np.mean([x.predicted == of[x.doc_id] for x in unseen]) > 0.97
    for x in unseen:
        for lo, hi in x.spans:
            assert any(b in text[x.doc_id][lo:hi] for b in BAD) and text[x.doc_id][lo:hi] == text[x.doc_id][lo:hi].strip()
    found = sum(hi - lo for x in unseen for lo, hi in x.spans)
    there = sum(len(w) for x in unseen for w in text[x.doc_id].split() if any(w.startswith(b) for b in BAD))
    assert found > 0.9 * there


def test_labels_of_the_fold_and_other_columns_do_not_count(spark):
    rows, labels = corpus(200, 4)
    p = toxicity.Params(steps=5, rounds=1)

    def scores(lab):
        return sorted((x.doc_id, x.score) for x in toxicity.classify(frame(spark, rows), spark.createDataFrame(lab, "doc_id long, quality int, toxic int"), p).collect())

    fold = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, 1 - q, t) for i, q, t in labels]
    assert scores(labels) == scores(fold)


def test_any_rows(spark, docs, rows, labels):
    lab = labels.selectExpr("doc_id", "quality", "int(doc_id % 2) as toxic")
    out = toxicity.classify(docs, lab, toxicity.Params(steps=3, rounds=1)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    blank = {i for i, t, _ in rows if not (t or "").strip()}
    assert len({r.score for r in out if r.doc_id in blank and r.doc_id is not None}) == 1
    assert len({r.score for r in out if r.doc_id == 305}) <= 2


def test_one_class_or_nothing(spark, docs, none, labels, rows):
    for lab in (labels, labels.limit(0)):
        out = toxicity.classify(docs, lab).collect()
        assert len(out) == len(rows) and {r.score for r in out} == {0.5} and not any(r.spans for r in out)
    assert toxicity.classify(none, labels.selectExpr("doc_id", "int(doc_id % 2) as toxic")).collect() == []


def test_tables(spark, sf):
    """Held-out accuracy on the given tables."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.classify(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").collect()
    assert np.mean([x.predicted == x.toxic for x in r]) > 0.85
