"""Vector searches and preference formatting against brute force."""

import math

import numpy as np
import pytest

from massweave.llm import chat, vectors


@pytest.fixture(scope="session")
def embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)).round(3)
    x[300:500] = x[7]                                        # a vector many rows share
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] + [1.0] * 15, 0), (1060, [float("inf")] + [1.0] * 15, 0), (1080, [None] + [1.0] * 15, 0),
           (1100, [], 0), (1120, [1.0] * 4, 0), (None, [1.0] * 16, 0), (20, rows[20][1], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumnRenamed("label", "cell")


def usable(rows, dim=16):
    return [(i, v) for i, v in rows if i is not None and v and len(v) == dim and all(y is not None and math.isfinite(y) for y in v) and any(v)]


def test_search_recall_and_ties(embeddings, spark):
    rows = usable([(r.vec_id, r.embedding) for r in embeddings.collect()])
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = vectors.search(embeddings, trial=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = sorted({int(i) for i in ids if i % 20 == 0})
    assert sorted(by) == queries
    hit = 0
    for q in queries:
        found = sorted(by[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        own = x[list(ids).index(q)]
        s = vectors.products(own, x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        score = {int(ids[j]): float(s[j]) for j in range(len(ids))}
        assert all(score[v] == z for _, v, z in found) and [(-z, v) for _, v, z in found] == sorted((-z, v) for _, v, z in found)
        hit += len({int(ids[j]) for j in order} & {v for _, v, _ in found})
    assert hit / (20 * len(queries)) >= 0.9
    assert vectors.search(embeddings.limit(0)).count() == 0
    few = vectors.search(embeddings.filter("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_hamming_is_exact(embeddings):
    rows = usable([(r.vec_id, r.embedding) for r in embeddings.collect() if r.embedding], 16) + [(1120, [1.0] * 4)]
    code = [(i, sum(1 << j for j, y in enumerate(v) if y > 0)) for i, v in rows]
    got = sorted(tuple(r) for r in vectors.hamming_search(vectors.codes(embeddings), every=20).collect())
    want = []
    for q in sorted({i for i, _ in code if i % 20 == 0}):
        c = next(c for i, c in code if i == q)
        near = sorted(((c ^ d).bit_count(), i) for i, d in code if i != q)[:10]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert got == want
    assert vectors.hamming_search(vectors.codes(embeddings.limit(0))).count() == 0


def test_segment_index_on_random_codes():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    ix = vectors.SegmentIndex(code)
    for q in [int(code[5]), int(rng.integers(0, 2**63))]:
        rows, dist = ix.nearest(q, 10, np.ones(2000, dtype=bool))
        d = np.bitwise_count(code ^ np.uint64(q)).astype(np.int64)
        want = np.lexsort((np.arange(2000), d))[:10]
        assert rows.tolist() == want.tolist() and dist.tolist() == d[want].tolist()


def test_preferences(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (2, 0, "user", "x"), (3, 0, "user", "same"), (4, 0, "user", "only here"),
         (5, None, None, None), (5, 1, "assistant", "é😀"), (None, 0, "user", "lost")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "assistant", "x"), (3, 0, "user", "same"), (3, 1, "assistant", "longer"), (5, None, None, None)]
    cols = "pair_id long, turn long, role string, text string"
    df = [spark.createDataFrame(x, cols).selectExpr("*", "1 AS shared", "2 AS a", "3 AS t") for x in (a, b)]
    got = {r.pair_id: r for r in chat.preferences(*df).collect()}
    assert set(got) == {1, 2, 3, 5}
    r = got[1]
    assert r.shared == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and r.chosen.startswith("<|im_start|>assistant\nyes")
    assert [r.chosen[s.start:s.end] for s in r.chosen_mask] == ["yes<|im_end|>\n"] and [r.rejected[s.start:s.end] for s in r.rejected_mask] == ["no<|im_end|>\n"]
    assert got[2].shared == 0 and got[2].prompt == "" and got[2].chosen_mask == []
    assert got[3].chosen == "" and got[3].chosen_mask == [] and got[3].shared == 1
    assert got[5].prompt == "<|im_start|>unknown\n<|im_end|>\n" and [got[5].chosen[s.start:s.end] for s in got[5].chosen_mask] == ["é😀<|im_end|>\n"]
    assert chat.preferences(df[0].limit(0), df[1]).count() == 0
