"""Text operators against brute force, on rows with every odd case."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from massweave.llm import licenses, mixing, nearcopies, pieces, pii, quality, simhash, tokenstore
from massweave.scale import scratch_path


# ---- 8: SimHash ---------------------------------------------------------------
def brute_fp(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(fps):
    """Smallest reachable position of each value, by search over all pairs."""
    seen, out = {}, {}
    for f in sorted(fps):
        if f in seen:
            continue
        stack, seen[f] = [f], f
        while stack:
            x = stack.pop()
            for y in fps:
                if y not in seen and (x ^ y).bit_count() <= 2:
                    seen[y] = f
                    stack.append(y)
    for f in fps:
        out[f] = seen[f]
    return out


def test_simhash_rows(docs, rows):
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fps = {brute_fp(t) for _, t, _ in rows}
    root = brute_components(fps)
    lowest = {}
    for i, t, _ in rows:
        c = root[brute_fp(t)]
        if i is not None:
            lowest[c] = min(lowest.get(c, i), i)
    want = [(i, brute_fp(t), lowest.get(root[brute_fp(t)])) for i, t, _ in rows]
    assert Counter(got) == Counter(want)


def test_simhash_keeps_one_each(docs, none, rows):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    root = brute_components({brute_fp(t) for _, t, _ in rows})
    assert len(ids) == len({root[brute_fp(t)] for _, t, _ in rows})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_simhash_links_no_pair_lost(spark):
    rng = np.random.default_rng(3)
    mask = (1 << 64) - 1
    bits = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    for f in bits[:30]:
        for _ in range(6):                                    # chains of near values
            a, b = rng.integers(0, 64, 2)
            f ^= (1 << int(a)) ^ (1 << int(b))
            bits.append(f)
    bits += [int(x) for x in rng.integers(0, 1 << 16, 300)]   # a crowd that agrees on blocks
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in bits})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components({x & mask for x in fps})
    groups, other = defaultdict(set), defaultdict(set)
    for x in fps:
        groups[got.get(x, x)].add(x)
        other[want[x & mask]].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_near_copies(spark, docs, none, rows):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(5000)]
    texts = {}
    for g in range(12):
        t = [words[i] for i in rng.integers(0, 5000, 400)]
        texts[3000 + 10 * g] = " ".join(t)
        for c in range(1, 4):                                 # three words changed: about 0.93 alike
            u = list(t)
            for i in rng.integers(0, 400, 3):
                u[int(i)] = "new"
            texts[3000 + 10 * g + c] = " ".join(u)
    df = docs.unionByName(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), allowMissingColumns=True)
    got = nearcopies.groups(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows) + Counter(list(texts))
    root = {(r.doc_id, r.key): (r.root, r.component_id) for r in got}
    assert all(c == i - i % 10 for (i, _), (_, c) in root.items() if i and i >= 3000)
    same = defaultdict(set)
    for (i, k), (r, c) in root.items():
        same[r].add(k)
    sets = {r.key: set(nearcopies.shingles(r.text, 5).tolist()) for r in df.withColumn("key", simhash.doc_key(df.text)).collect()}
    for keys in same.values():                                # a group holds together by links of 0.8
        left, seen = list(keys)[1:], list(keys)[:1]
        while left:
            nxt = [k for k in left if any(len(sets[k] & sets[s]) >= 0.8 * len(sets[k] | sets[s]) for s in seen)]
            assert nxt
            seen += nxt
            left = [k for k in left if k not in nxt]
    assert nearcopies.keep_first(df).count() == len(same) and nearcopies.keep_first(df).columns == df.columns
    assert nearcopies.groups(none).count() == 0


# ---- 6: quality ---------------------------------------------------------------
SMALL = quality.Params(buckets=1 << 10, epochs=2, sample=30)


def test_quality_rows(docs, labels, none, rows):
    got = quality.classify(docs, labels, SMALL).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in got if r.doc_id in (300, 301, 302)} == {0.5}
    assert quality.classify(none, labels, SMALL).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0), SMALL).collect()} == {0.5}


def test_quality_never_learns_the_held_out(docs, labels):
    from pyspark.sql import functions as F
    lies = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels, SMALL), quality.fit(docs, lies, SMALL))


def test_quality_does_not_hold_the_sample(spark, docs, labels, monkeypatch):
    import tracemalloc
    from pyspark.sql import functions as F
    bag = F.unhex(F.repeat(F.lit("01000000"), 12_500))                                    # 50,000 bytes of ids and of counts: 20 MB in all
    many = spark.range(200, numPartitions=4).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), bag.alias("ids"), bag.alias("counts"))
    monkeypatch.setattr(quality, "stored", lambda df, name: many)
    tracemalloc.start()
    try:
        emb, out = quality.learned(docs, labels, SMALL)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12e6 and out.any()


def test_quality_is_a_softmax_of_averaged_vectors():
    import math
    import zlib
    p = quality.Params(buckets=256, dim=4, cache=5)
    rng = np.random.default_rng(1)
    emb, out = rng.normal(size=(p.buckets, p.dim)), rng.normal(size=(p.dim, 2))
    known = quality.Evidence(emb @ (out[:, 1] - out[:, 0]), p)
    h = lambda w: zlib.crc32(w.encode())

    def direct(text):
        words, total, n = text.split(), np.zeros(p.dim), 0
        for w in words:
            m = f"<{w}>"
            for g in [m] + [m[i:i + k] for k in (3, 4, 5) for i in range(max(len(m) - k + 1, 0))]:
                total, n = total + emb[h(g) % p.buckets], n + 1
        for a, b in zip(words, words[1:]):
            x = ((h(a) * 2654435761) ^ (h(b) * 2246822519)) & 0xFFFFFFFF
            x = (((x ^ (x >> 15)) * 3266489917) & 0xFFFFFFFF) >> 7
            total, n = total + p.pair * emb[(h("same again") if a == b else x) % p.buckets], n + p.pair
        z = total / max(n, 1) @ out
        e = np.exp(z - z.max())
        return (e / e.sum())[1]

    texts = ["", " \t\n", "one", "a a a a", "the cat sat on the mat the cat", "x" * 5000 + " é 漢字 x", " ".join(f"w{i % 7}" for i in range(3000))]
    texts += [" ".join(rng.choice(["ab", "abc", "Zz", "q,", "ω"], 20)) for _ in range(20)]
    for t in [*texts, *texts]:
        assert abs(1 / (1 + math.exp(-known.logit(t))) - direct(t)) < 1e-9, t[:40]


def test_quality_learns_new_words_together():
    """Many words at once have the buckets that one has, and a text's score does not depend on those beside it."""
    p = quality.Params(buckets=1 << 12)
    rng = np.random.default_rng(3)
    words = ["", "a", "é", "漢字", "𝒳y", "x" * 300, "naïve", "<>"] + ["".join(rng.choice(list("abcé漢𝒳<"), rng.integers(1, 15))) for _ in range(500)]
    at, bucket = quality.all_features(words, p)
    for i, w in enumerate(words):
        assert sorted(bucket[at == i].tolist()) == sorted(quality.features(w, p))
    texts = [None, ""] + [" ".join(rng.choice(words, 40)) for _ in range(300)]
    evidence = rng.normal(size=p.buckets)
    together = list(quality.Evidence(evidence, p).logits(texts))
    assert together == [quality.Evidence(evidence, p).logit(t) for t in texts]
    assert together == list(quality.Evidence(evidence, quality.Params(buckets=1 << 12, cache=10)).logits(texts))


def test_quality_held_out_accuracy(spark, sf):
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = quality.classify(d, lab).filter("held_out").join(lab, "doc_id").collect()
    assert np.mean([x.predicted == x.quality for x in r]) >= 0.9
    kept = quality.keep_good(d, lab)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()


# ---- 9: personal data ----------------------------------------------------------
def brute_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(x.isdigit() for x in m[0]) <= 15]
    return out


PRIVATE = ["a@b.c_d@e.f x@y@z.com a.@b-c.d- @x.y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.4 1.2.3", "é 4111111111111111 😀 4111-1111 1111 1111, 4111111111111112",
           "+1 (743) 555-3824 +1 2 ++49 30 1234567- call 743 555 3824 00 49 30 123456", "1" * 2000, "a@b" + ".c" * 1000, "+1" * 500, "name [at] site [dot] org",
           "id 12345678901234567890 4222222222222 (4222222222222)", "mail me.19@mail5.example.com 70.23.22.57"]


@pytest.fixture(scope="session")
def private(spark, docs):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(PRIVATE)] + [(1000, PRIVATE[0])], "doc_id long, text string")
    return docs.unionByName(more, allowMissingColumns=True)


def test_pii_base_spans(private, none):
    got = pii.find(private).collect()
    want = [(r.doc_id, tuple(brute_spans(r.text or ""))) for r in private.collect()]
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base)) for r in got) == Counter(want)
    assert all(set(r.base) <= set(r.spans) for r in got)
    assert pii.find(none).count() == 0


def test_pii_redacts(private, none):
    out = pii.redact(private)
    assert out.columns == private.columns and out.count() == private.count() and pii.redact(none).count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert not any(brute_spans(r.text) for r in got.values() if r.text and r.doc_id != 1000)
    assert got[1009].text == "mail [EMAIL] [IP]" and got[1009].n_chars == len(got[1009].text) and got[300].text is None


def test_boosting_learns_an_interaction():
    cells = [([a, b, 0, 0, 0, 0], 100, 95 if a and b else 5) for a in (0, 1) for b in (0, 1, 2)]
    trees = pii.boost(cells, trees=40, depth=3)
    p = [1 / (1 + np.exp(-sum(pii.apply_tree(t, c[0]) for t in trees))) for c in cells]
    assert all(abs(x - c[2] / c[1]) < 0.1 for x, c in zip(p, cells))
    assert pii.threshold(cells, trees, 0.9) is not None and pii.threshold(cells, trees, 0.99) is None


# ---- 3: mixing -------------------------------------------------------------------
def brute_targets(size, share=1.5, most=2.0):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, full = share * sum(size.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        level = left / sum(w[s] for s in open_) if open_ else 0
        new = [s for s in open_ if w[s] * level > most * size[s]]
        if not new:
            return {s: most * size[s] if s in full else w[s] * level for s in order}
        for s in new:
            full.add(s)
            left -= most * size[s]


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    n = {id(r): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], n[id(r)]) for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += n[id(r)]
    target, taken = brute_targets(size), defaultdict(int)
    for r in got:
        s = None if r.sn else r.sk
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(taken[s] == pytest.approx(target[s], rel=0.02, abs=3) for s in size)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    assert mixing.mix(none).count() == 0
    assert {r.taken for r in mixing.mix(docs.filter("coalesce(trim(text), '') = ''")).collect()} == {0}


def test_mixed_rows(docs, none):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mixed(none).count() == 0
    want = sum(int(r.taken / r["size"] + 0.5) for r in mixing.mix(docs).collect() if r["size"])
    assert out.count() == want and max(Counter((r.doc_id, r.text) for r in out.filter("doc_id <> 305").collect()).values()) <= 2


# ---- 2: SentencePiece -------------------------------------------------------------
EDGE = ["", " ", "  ", "a  b", "   a", "a ", "a\nb  c\n\n d", "日本語 😀", "x" * 500, "\t\ta", "The cat sat.", "!!!! 3.14159", "    x = {a: b};", "naïve  Über"]


def test_pieces_equal_the_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    m = pieces.Model(pieces.default_path())
    for t, ids in zip(EDGE, m.encode(EDGE)):
        assert ids.tolist() == sp.encode(t) and m.decode(ids) == t


def test_unigram_is_the_best_sum():
    m = pieces.Model(pieces.default_path(), "unigram")
    rng = np.random.default_rng(1)
    m.score = {p: -float(rng.uniform(1, 9)) for p in m.score}
    m.longest = max(map(len, m.score))

    def brute(w):
        best = [0.0] + [-np.inf] * len(w)
        for i in range(1, len(w) + 1):
            for j in range(i):
                if w[j:i] in m.score:
                    best[i] = max(best[i], best[j] + m.score[w[j:i]])
        return best[-1]

    words = ["▁the", "▁then", "▁thermal", "▁there", "▁trees", "▁cat", "▁catalog"]
    m.learn(words)
    name = {i: p for p, i in m.id.items()}
    for w in words:
        p = [name[i] for i in np.frombuffer(m.known[w], np.int32).tolist()]
        assert "".join(p) == w and sum(m.score[x] for x in p) == pytest.approx(brute(w))


def test_pieces_rows(docs, rows, none):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<i4").tobytes()), True) for i, x in ((i, sp.encode(t or "")) for i, t, _ in rows))
    assert Counter(tuple(r) for r in pieces.digest(docs).collect()) == want
    assert Counter(r.doc_id for r in pieces.encode_rows(docs).collect()) == Counter(i for i, _, _ in rows)
    assert {r.doc_id: r.back for r in pieces.encode(docs).collect()}[303] == "long " * 30000 + "end"
    assert pieces.digest(none).count() == 0 and pieces.encode_rows(none).count() == 0


# ---- 5: licenses -------------------------------------------------------------------
def test_licenses(spark, docs, none):
    mit = licenses.TEMPLATES[0][1]
    cut = mit.split()
    texts = {1: "Under the MIT-License! then cc by nc, cc by nc.", 2: mit.upper(), 3: " ".join(cut[:20] + ["new", "words"] + cut[20:]), 4: "the mit license under", 5: " ".join(cut[:12]),
             6: "Apache License, Version 2.0", 7: "cc by", 8: "undér the mit license"}
    more = spark.createDataFrame([(2000 + i, t) for i, t in texts.items()] + [(2001, texts[1])], "doc_id long, text string")
    out = licenses.scan(docs.unionByName(more, allowMissingColumns=True)).collect()
    assert len(out) == docs.count() + 9
    got = {r.doc_id - 2000: r for r in out if r.doc_id and r.doc_id > 2000}
    assert sum(r.doc_id == 2001 for r in out) == 2
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (3, 0, 8, "cc-by-nc,mit", 1.0)
    assert got[2].labels == "mit" and got[2].n_base == 0 and got[2].first_word is None and got[2].score == 1.0
    assert got[3].labels == "mit" and 0.9 < got[3].score < 1
    assert (got[4].labels, got[5].labels, got[7].labels, got[7].score, got[8].n_base) == ("", "", "", 0.0, 0)
    assert got[6].base_labels == "apache-2"
    assert licenses.scan(none).count() == 0


# ---- 10: token store ------------------------------------------------------------------
def test_token_store(spark, docs, none):
    from tokenizers import Tokenizer
    edge = ["it's we'll 'tis", "the <|endoftext|> cat", "a   b", "a\x1c b \x85 d", " \n end  ", "Über² ª"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(edge + EDGE)], "doc_id long, text string"))
    tk = Tokenizer.from_file(tokenstore.default_path())
    path = scratch_path(spark, "store")
    tokenstore.write(df, path)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.read(spark, path, df).collect())
    want, at = [], 0
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = tk.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id is not None, r.doc_id or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    keys = spark.createDataFrame([(5001, 0), (5001, 1), (10**9, 0), (305, 2), (None, 0)], "doc_id long, occ int")
    ids = {(r.doc_id, r.occ): r.ids for r in tokenstore.fetch(spark, path, keys).collect()}
    assert set(ids) == {(5001, 0), (305, 2), (None, 0)} and ids[(5001, 0)] == tk.encode(edge[1], add_special_tokens=False).ids + [0]
    empty = scratch_path(spark, "empty")
    tokenstore.write(none, empty)
    assert tokenstore.read(spark, empty, none).count() == 0


def test_words_that_come_again_are_made_once(monkeypatch):
    monkeypatch.setattr(tokenstore, "WORDS", 10)
    made = Counter()

    def make(k):
        made[k] += 1
        return k.encode()

    words = tokenstore.Words(make)
    for i in range(200):
        assert [words["often"], words[f"w{i}"], words["x" * 41]] == [b"often", f"w{i}".encode(), b"x" * 41]
        assert len(words) <= 10 and "x" * 41 not in words
    assert made["often"] == 1


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
    groups, disp, slot = tokenstore.perfect_hash(h1, h2)
    assert sorted(slot.tolist()) == list(range(n))
    d = disp[(h1 % np.uint64(groups)).astype(np.int64)].astype(np.int64)
    found = np.where(d < 0, -1 - d, (tokenstore.mixed(h1, h2, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64))
    assert (found == slot).all()


def test_pii_hashes_a_text_below_the_explode(docs):
    """A candidate carries no text: time grows with the text, not with its square."""
    plan = pii.candidates(docs)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(i for i, x in enumerate(plan) if "Generate" in x)
    assert any("xxhash64" in x for x in plan[explode + 1:]) and not any("xxhash64" in x for x in plan[:explode])
