"""Sources of any size reach their targets, by blocks of their own size."""

from collections import defaultdict

from massweave.llm import mixing


def reached(df):
    target, taken = {}, defaultdict(int)
    for r in df.collect():
        s = None if r.sn else r.sk
        target[s], taken[s] = r.target, taken[s] + r.taken
        assert r.taken <= 2 * r["size"]
    return target, taken


def test_small_sources_reach_their_targets(spark):
    rows = [(i, "word " * 5000, "big") for i in range(400)] + [(1000 + i, "a b c d e", f"tail{i % 5}") for i in range(20)] + [(2000, "one two three", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target, taken = reached(mixing.mix(docs))                 # a slot of the mix is about 11 words, a tail has 40
    assert min(target.values()) == 6
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 2 * t * 80 / mixing.SLOTS), (s, t, taken[s])
    out = mixing.mixed(docs).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in out if r.source != "big"} == {**{f"tail{i}": 8 for i in range(5)}, None: 2}


def test_part_of_a_pass(spark):
    rows = [(i, "word " * 7, s) for s in ("a", "b", "c") for i in range(30)]
    target, taken = reached(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=4096))
    assert len(set(target.values())) > 1 and all(abs(taken[s] - t) <= 2 for s, t in target.items())


def test_more_sources_get_more_slots(spark):
    rows = [(i, "word " * 40, f"s{i % 300}") for i in range(900)] + [(5000 + i, "word " * 900, "big") for i in range(100)]
    target, taken = reached(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=64))
    assert len(target) == 301
    for s, t in target.items():                               # 16 slots a source, at least 12 after the big one's share
        assert 0 < taken[s] and abs(taken[s] - t) <= 2 + 2 * t / 12, (s, t, taken[s])


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, "a b", "x"), (None, "a b", "x"), (1, None, "x"), (2, "", None), (3, "c", None), (3, "c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, slots=256).collect()
    assert len(got) == 6 and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix(df.limit(0), slots=256).count() == 0 and mixing.mixed(df.limit(0), slots=256).count() == 0
    none = mixing.mix(df.filter("text is null or text = ''"), slots=256).collect()
    assert len(none) == 2 and all(r.taken == 0 and r.target == 0 for r in none)
