"""Personal data: overlapping candidate spans, boosted trees on format and context, calibrated cuts.

DataFrame functions only. The trees are fitted on the driver to counts of
feature cells, whose number the feature grid bounds whatever the corpus, and
they are applied as Column expressions.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massweave.llm.common import doc_key, stored

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. Possessive forms of the given ones: the same matches, without backtracking or recursion on long runs.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: they overlap the strict ones and each other.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9])(?:00)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,13}+(?![0-9])",
}
#: What a text must hold for a generator to run on it.
GATES = {("email", 0): "@", ("email", 1): r"[(\[]at[)\]]", ("ip", 1): r"[\])][0-9]", ("phone", 0): r"\+[0-9]"}
WORDS = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax"}
NEAR = 24
FEATURES = ("digits", "marks", "left", "right", "word", "groups")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Luhn's sum over a string of digits is a multiple of 10."""
    def add(total: Column, i: Column) -> Column:
        v = F.substring(F.reverse(d), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    """Whether a match holds what its kind asks for."""
    d = F.length(digits(m))
    return (F.when(kind == 0, F.contains(m, F.lit("@")))
            .when(kind == 1, m.rlike(r"^[0-9.]+$") & F.forall(F.split(m, r"\."), lambda x: x.try_cast("double") <= 255))
            .when((kind == 2) & d.between(13, 19), m.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & luhn(digits(m)))
            .when(kind == 3, m.startswith("+") & d.between(9, 15))
            .otherwise(False))


def matches(text: Column, kind: int, loose: int, pattern: str) -> Column:
    """Array of (gen, i, gap, before, first, m): the text between two matches, shortened, and the match after it."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    out = F.transform(both, lambda z, i: F.struct(
        F.lit(2 * kind + loose).alias("gen"), i.alias("i"), F.length(z["gap"]).alias("gap"),
        F.substring(z["gap"], -NEAR, NEAR).alias("before"), F.substring(z["gap"], 1, 1).alias("first"), z["m"].alias("m")))
    gate = GATES.get((KINDS[kind], loose))
    return F.when(text.rlike(gate or "[0-9]"), out)


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate span and one (gen -1) per text: doc_id, key, copies, gen, m, start, end and the features.

    Only candidates are shuffled, by their document; positions are running sums
    over the pieces between matches. Rows of equal doc_id and text are counted
    once, in `copies`.
    """
    text = F.col("text")
    none = F.struct(F.lit(-1).alias("gen"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("before"), F.lit("").alias("first"), F.lit("").alias("m"))
    gens = [matches(text, k, j, p[kind]) for k, kind in enumerate(KINDS) for j, p in enumerate((STRICT, LOOSE))]
    some = F.concat(F.array(none), *[F.coalesce(g, F.filter(F.array(none), lambda _: F.lit(False))) for g in gens])
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .select("doc_id", doc_key(text).alias("key"), "text")          # hashed once, below the explode, so no candidate carries its text
            .select("doc_id", "key", F.explode(some).alias("c")).select("doc_id", "key", "c.*")
            .filter("m is not null or i > 0"))
    rows = rows.repartition("doc_id", "key").groupBy("doc_id", "key", "gen", "i").agg(
        F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("gap", "before", "first", "m")])
    w = Window.partitionBy("doc_id", "key", "gen").orderBy("i")
    rows = rows.select(
        "doc_id", "key", "copies", "gen", "m", "before", F.lead("first").over(w).alias("after"),
        F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(w).alias("end"))
    rows = rows.filter("m is not null")
    kind = F.floor(F.col("gen") / 2).cast("int")
    m, b = F.col("m"), F.col("before")
    near = F.lower(b)

    def char(c: Column) -> Column:
        return (F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).otherwise(4))

    word = F.when(kind == 0, near.rlike(WORDS["email"])).when(kind == 1, near.rlike(WORDS["ip"])).when(kind == 2, near.rlike(WORDS["card"])).otherwise(near.rlike(WORDS["phone"]))
    marks = sum((F.when(F.contains(m, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate((" ", "-", ".", "("))), F.lit(0))
    return rows.select(
        "doc_id", "key", "copies", "gen", kind.alias("kind"), (F.col("gen") % 2 == 0).alias("strict"),
        (F.col("end") - F.length("m")).alias("start"), "end", valid(kind, m).alias("ok"),
        F.least(F.length(digits(m)), F.lit(20)).alias("digits"), marks.alias("marks"),
        char(F.substring(b, -1, 1)).alias("left"), char(F.col("after")).alias("right"), word.cast("int").alias("word"),
        F.least(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(8)).alias("groups"))


# ---- boosted trees over feature cells -----------------------------------------
def best_split(cells: list, at: list[int], grad: list[float], hess: list[float], ridge: float):
    """(gain, feature, cut) of the best cut of the cells `at`, or None."""
    g_all, h_all = sum(grad[i] for i in at), sum(hess[i] for i in at)
    best = None
    for f in range(len(FEATURES)):
        by: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for i in at:
            s = by[cells[i][0][f]]
            s[0] += grad[i]
            s[1] += hess[i]
        g = h = 0.0
        for v in sorted(by)[:-1]:
            g += by[v][0]
            h += by[v][1]
            gain = g * g / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all * g_all / (h_all + ridge)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, v)
    return best


def grow(cells: list, at: list[int], grad: list[float], hess: list[float], depth: int, rate: float, ridge: float):
    """A tree: a leaf's value, or (feature, cut, at most, above)."""
    cut = best_split(cells, at, grad, hess, ridge) if depth else None
    if cut is None:
        return rate * sum(grad[i] for i in at) / (sum(hess[i] for i in at) + ridge)
    _, f, v = cut
    low = [i for i in at if cells[i][0][f] <= v]
    high = [i for i in at if cells[i][0][f] > v]
    return (f, v, grow(cells, low, grad, hess, depth - 1, rate, ridge), grow(cells, high, grad, hess, depth - 1, rate, ridge))


def apply_tree(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(cells: list, trees: int = 12, depth: int = 2, rate: float = 0.5, ridge: float = 1.0) -> list:
    """Trees for logistic loss over cells (features, rows, positive rows), by second-order boosting."""
    z = [0.0] * len(cells)
    out = []
    for _ in range(trees if cells else 0):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]
        grad = [c[2] - c[1] * q for c, q in zip(cells, p)]
        hess = [c[1] * q * (1 - q) for c, q in zip(cells, p)]
        out.append(grow(cells, list(range(len(cells))), grad, hess, depth, rate, ridge))
        z = [a + apply_tree(out[-1], c[0]) for a, c in zip(z, cells)]
    return out


def threshold(cells: list, trees: list, precision: float) -> float | None:
    """Lowest score at and above which at least `precision` of the rows are positive; None if there is none."""
    scored = sorted(((round(sum(apply_tree(t, c[0]) for t in trees), 9), c[1], c[2]) for c in cells), reverse=True)
    rows = pos = 0
    cut = None
    for i, (s, n, k) in enumerate(scored):
        rows += n
        pos += k
        if (i + 1 == len(scored) or scored[i + 1][0] < s) and pos >= precision * rows:
            cut = s
    return cut


def tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.col(FEATURES[tree[0]]) <= tree[1], tree_column(tree[2])).otherwise(tree_column(tree[3]))


def fit(cands: DataFrame, precision: float = 0.98) -> dict[int, tuple[list, float | None]]:
    """Trees and cut of each kind, learned from how often candidates of a cell pass the strict check.

    Against are strict matches that fail their check and loose ones inside a
    longer word or number; the other loose ones are judged, not learned from.
    What the strict check rests on (plus sign, check digit, part sizes, @) is
    no feature, so the trees judge by the rest of format and context.
    """
    inside = F.col("left").isin(2, 3) | F.col("right").isin(2, 3)
    rows = (cands.filter("gen >= 0").filter(F.col("ok") | F.col("strict") | inside).groupBy("kind", *FEATURES)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("pos")).collect())
    out = {}
    for k in range(len(KINDS)):
        cells = sorted(([r[f] for f in FEATURES], r["n"], r["pos"]) for r in rows if r["kind"] == k)
        trees = boost(cells)
        out[k] = (trees, threshold(cells, trees, precision) if trees else None)
    return out


def find(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """One row per row of `docs`: doc_id, key (names the text), n_email, n_ip, n_card, n_phone, base, spans.

    base and spans are arrays of (kind, start, end) by kind and start, in code
    points, end exclusive. base holds the strict matches that pass their check;
    spans adds candidates whose boosted score reaches the kind's calibrated
    cut, that overlap no base span, and of overlapping ones the best.

    Null and empty texts have no span. Repeated rows each get their row; a null
    doc_id stays null. Without candidates nothing is learned and nothing added.
    Other columns are not read.
    """
    cands = stored(candidates(docs), "pii")
    model = fit(cands, precision)
    score = F.lit(None).cast("double")
    cut = F.lit(None).cast("double")
    for k, (trees, c) in model.items():
        if c is not None:
            score = F.when(F.col("kind") == k, F.round(sum((tree_column(t) for t in trees), F.lit(0.0)), 9)).otherwise(score)
            cut = F.when(F.col("kind") == k, F.lit(float(c))).otherwise(cut)
    base = F.col("strict") & F.col("ok")
    c = (cands.repartition("doc_id", "key")
         .select("doc_id", "key", "copies", "gen", "kind", "start", "end", base.alias("base"), score.alias("score"), cut.alias("cut"))
         .filter("gen = -1 or base or score >= cut"))
    upto = Window.partitionBy("doc_id", "key").orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("doc_id", "key").orderBy("start", "end", "gen").rowsBetween(1, Window.unboundedFollowing)
    own = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    c = c.select("*", F.max(own[0]).over(upto).alias("reach"), F.min(own[1]).over(later).alias("next"))
    c = c.filter("gen = -1 or base or (coalesce(reach <= start, true) and coalesce(next >= end, true))")
    added = F.when(~F.col("base") & (F.col("gen") >= 0), F.col("end"))
    c = c.select("*", F.max(added).over(upto).alias("before"))
    c = c.select("*", F.sum(F.when(F.coalesce(F.col("before") > F.col("start"), F.lit(False)), 0).otherwise(1)).over(
        Window.partitionBy("doc_id", "key").orderBy("start", "end", "gen")).alias("isle"))
    best = Window.partitionBy("doc_id", "key", "isle", F.col("base") | (F.col("gen") < 0)).orderBy(F.desc("score"), "start", "gen")
    c = c.select("*", F.row_number().over(best).alias("r")).filter("gen = -1 or base or r = 1")
    span = F.struct("kind", "start", "end")
    g = c.groupBy("doc_id", "key").agg(
        F.max(F.when(F.col("gen") == -1, F.col("copies"))).alias("copies"),
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.when(F.col("base") & (F.col("gen") >= 0), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("gen") >= 0, span))).alias("spans"))
    return g.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy", "copies")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """`docs`, all columns, with each found span replaced by its kind in brackets.

    Overlapping spans of several kinds are replaced once, under the first of
    them. n_chars, if there is one, follows the new text. Texts without a span
    and null texts stay as they are.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = stored(find(docs, precision).filter(F.size("spans") > 0).groupBy("doc_id", "key").agg(F.first("spans").alias("spans"))
                   .select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.isnull("doc_id").alias("n"), "key",
                           F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans")), "found")
    t = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.array(F.concat(F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"]))))
        return F.struct(F.when(fresh, more).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    none = F.filter(F.array(F.lit("")), lambda _: F.lit(False))
    new = F.aggregate("spans", F.struct(none.alias("out"), F.lit(0).cast("long").alias("at")), step,
                      lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, (a["at"] + 1).cast("int"), F.length(t))))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key(F.coalesce("text", F.lit(""))).alias("key"),
                    F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.isnull("doc_id").alias("n"))
    d = d.join(found, ["k", "n", "key"], "left").select("row", F.when(F.col("spans").isNotNull(), new).otherwise(t).alias("text"))
    cols = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return d.select(*cols)
