"""License scans by diagonal voting: word k-grams joined to template positions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massweave.llm.common import ascii_lower, doc_key

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of which every place counts.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Wording of public licenses, matched in part or in whole.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]
#: Diagonals this near are one passage with words put in or left out.
SLACK = 6
#: Share of a template's k-grams that a passage must hold.
COVER = 0.6


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_table(spark: SparkSession) -> DataFrame:
    """(h, tmpl, tpos, gram): every k-gram of every template; a few hundred fixed rows. Template -1 marks a document."""
    texts = F.posexplode(F.array(F.lit(""), *[F.lit(text) for _, text in PHRASES + TEMPLATES])).alias("t", "text")
    t = spark.range(1).select(texts).select((F.col("t") - 1).alias("tmpl"), F.split("text", " ").alias("w"))
    at = F.when(F.col("tmpl") < 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("w") - K))
    df = t.select("tmpl", "w", F.explode(at).alias("tpos")).select("tmpl", "tpos", F.slice("w", F.col("tpos") + 1, F.lit(K)).alias("gram"))
    h = F.when(F.col("tmpl") >= 0, F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(K)])).otherwise(F.lit(0).cast("long"))
    return df.select(h.alias("h"), "tmpl", "tpos", "gram")


def scan(docs: DataFrame, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling k-gram is joined to the template positions it occurs at; the
    templates are fixed, so they are broadcast and only hits are shuffled. A
    hit votes for its diagonal (word less template position). A phrase stands
    at each diagonal that holds all its k-grams. Neighbouring diagonals are
    merged; a passage that holds `cover` of a template's k-grams gives its
    label. Words are compared at every hit, so equal hashes of different words
    do not count. score is the largest share of any template found.

    Null and empty texts have no word, no label and score 0. Repeated rows each
    get their row, a null doc_id stays null, other columns are not read.
    """
    spark = docs.sparkSession
    w = F.col("w")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w"))
    rolling = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]))
    d = d.select("doc_id", "key", "w", F.size(w).alias("n_words"), F.posexplode(F.concat(F.array(F.lit(0).cast("long")), rolling)).alias("at", "h"))
    hit = d.join(F.broadcast(gram_table(spark)), "h").filter(
        F.when(F.col("tmpl") < 0, F.col("at") == 0).otherwise((F.col("at") > 0) & (F.slice(w, F.greatest("at", F.lit(1)), F.lit(K)) == F.col("gram"))))
    hit = hit.select("doc_id", "key", "n_words", "tmpl", (F.col("at") - 1 - F.col("tpos")).alias("diagonal"), "tpos").repartition("doc_id", "key")
    per = hit.groupBy("doc_id", "key", "tmpl", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("tmpl") < 0).alias("copies"), F.collect_set("tpos").alias("seen"))
    by = Window.partitionBy("doc_id", "key", "tmpl").orderBy("diagonal")
    per = per.select("*", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= slack, 0).otherwise(1)).over(by).alias("passage"))
    info = [(label, len(text.split()) - K + 1) for label, text in PHRASES + TEMPLATES]
    label = F.get(F.array(*[F.lit(x) for x, _ in info]), F.col("tmpl"))
    grams = F.get(F.array(*[F.lit(n) for _, n in info]), F.col("tmpl"))
    place = F.col("tmpl").between(0, len(PHRASES) - 1) & (F.size("seen") == grams)
    per = per.select("*", place.alias("place"))
    found = per.groupBy("doc_id", "key", "tmpl", "passage").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.count_if("place").alias("n"),
        F.min(F.when(F.col("place"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("place"), F.col("diagonal"))).alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("held"))
    share = F.when(F.col("tmpl") >= 0, F.col("held") / grams)
    ok = (F.col("n") > 0) | ((F.col("tmpl") >= len(PHRASES)) & (share >= cover))
    r = found.groupBy("doc_id", "key").agg(
        F.max("copies").alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.sum("n").alias("n_base"),
        F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("n") > 0, label))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(ok, label))), ",").alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"))
    return r.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy", "copies", "key")


SQL = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({i}, {i < len(PHRASES)}, '{x}', string_split('{y}', ' '))" for i, (x, y) in enumerate(PHRASES + TEMPLATES))}) v(tmpl, base, label, tw)),
g AS (SELECT tmpl, base, label, len(tw) - {K - 1} AS grams, unnest(range(0, len(tw) - {K - 1})) AS tpos, tw FROM t),
g2 AS (SELECT *, tw[tpos + 1:tpos + {K}] AS gram FROM g),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(0, len(w) - {K - 1})) AS pos FROM d WHERE len(w) >= {K}),
h AS (SELECT DISTINCT r, tmpl, base, label, grams, pos - tpos AS diagonal, tpos FROM p JOIN g2 ON w[pos + 1:pos + {K}] = gram),
per AS (SELECT r, tmpl, base, label, grams, diagonal, list(tpos) AS seen FROM h GROUP BY ALL),
pl AS (SELECT *, base AND len(seen) = grams AS place, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, tmpl ORDER BY diagonal) <= {SLACK} THEN 0 ELSE 1 END AS fresh FROM per),
ps AS (SELECT *, sum(fresh) OVER (PARTITION BY r, tmpl ORDER BY diagonal) AS passage FROM pl),
f AS (SELECT r, base, label, grams, count(*) FILTER (place) AS n, min(diagonal) FILTER (place) AS first, max(diagonal) FILTER (place) AS last,
             len(list_distinct(flatten(list(seen)))) / grams::DOUBLE AS share FROM ps GROUP BY r, tmpl, base, label, grams, passage),
o AS (SELECT r, sum(n) AS n, min(first) AS first, max(last) AS last, list_sort(list_distinct(list(label) FILTER (n > 0))) AS bl,
             list_sort(list_distinct(list(label) FILTER (n > 0 OR (NOT base AND share >= {COVER})))) AS al, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first::BIGINT AS first_word, last::BIGINT AS last_word,
       coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN o USING (r)
"""
