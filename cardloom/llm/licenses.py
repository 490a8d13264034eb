"""Licence scan by a positional index of rare licence words, in DataFrame functions only.

Templates are short licence passages. Each template word has an IDF over all templates; the rarest words of each
template make its postings (word -> template, position). A document's words that are in the index vote for
(template, start = own position - template position). Votes whose starts lie within SLACK of each other form an
alignment; its share of the template's posting IDF is the template's score. A template counts when its score reaches
its threshold and all its mandatory phrases stand in the text.

Everything happens inside the row: no join, no shuffle. Words are split and votes cast only in rows that hold one of
the index's words or a base phrase's word.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases and labels, in the order of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, mandatory phrases, and the passage of each template (public licence texts).
TEMPLATES = [
    ("mit", ["free of charge to any person obtaining"], "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", ["except in compliance with the license"], "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", ["free software you can redistribute it"], "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", ["gnu general public license version 3"], "licensed under the gnu general public license version 3"),
    ("lgpl", ["gnu lesser general public license"], "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", ["gnu affero general public license"], "you should have received a copy of the gnu affero general public license along with this program"),
    ("bsd", ["redistribution and use in source and binary forms"], "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl", ["mozilla public license"], "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc", ["with or without fee is hereby granted"], "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", ["released into the public domain"], "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", ["creative commons attribution"], "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", ["cc by nc"], "licensed under cc by nc 4 0"),
    ("cc-by-sa", ["cc by sa"], "licensed under cc by sa 4 0"),
    ("apache-2.0", ["apache license version 2 0"], "licensed under the apache license version 2 0"),
]
# Words that say nothing about a licence.
COMMON = {"all", "an", "are", "as", "can", "for", "form", "have", "if", "into", "it", "one", "or", "should", "was", "your"}
RARE_WORDS, SLACK, THRESHOLD = 8, 4, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased


def build_index(templates=TEMPLATES, rare: int = RARE_WORDS):
    """Postings {word: [(template number, position, idf)]} and each template's total IDF.

    Common words and those of more than a quarter of the templates are no evidence and stay out.
    """
    texts = [t[2].split() for t in templates]
    df: dict[str, int] = {}
    for words in texts:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    postings: dict[str, list[tuple[int, int, float]]] = {}
    totals = []
    for k, words in enumerate(texts):
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        chosen = sorted((w for w in first if df[w] <= len(texts) / 4 and w not in COMMON), key=lambda w: (df[w], w))[:rare]
        idf = {w: math.log(1 + len(texts) / df[w]) for w in chosen}
        for w in chosen:
            for i, x in enumerate(words):
                if x == w:
                    postings.setdefault(w, []).append((k, i, idf[w]))
        totals.append(sum(idf[x] for x in words if x in idf))
    return postings, totals


def _padded(words: Column) -> Column:
    """Each word between spaces of its own, so that neighbouring phrases share none."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def _phrase(text: str) -> str:
    return " " + "  ".join(text.split()) + " "


def _words_before(padded: Column, at: Column) -> Column:
    head = F.substring(padded, F.lit(1), at.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("  "), F.lit(" ")))).cast("long")


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score.

    A null text counts as empty: no words, empty labels, score 0 and null positions. score is 1 if a base phrase
    stands in the text, else the best score of the templates that count. Columns of these names are replaced.
    """
    postings, totals = build_index(templates)
    raw = F.coalesce(F.col(text), F.lit(""))
    hints = sorted({w for w in postings} | {p.split()[0] for p in BASE})
    hint = raw.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, hints)) + ")(?![a-z0-9])")
    own = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    df = docs.drop(*own)
    words = F.filter(F.split(F.translate(raw, UPPER, LOWER), NO_WORD), lambda w: w != "")
    df = df.withColumn("n_words", F.regexp_count(raw, F.lit(WORD)).cast("long")).withColumn("_w", F.when(hint, words).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_p", _padded(F.col("_w")))
    p, back = F.col("_p"), F.reverse(F.col("_p"))
    counts, firsts, lasts, base = [], [], [], []
    for phrase, label in BASE.items():
        x = _phrase(phrase)
        n = ((F.length(p) - F.length(F.replace(p, F.lit(x), F.lit("")))) / len(x)).cast("long")
        counts.append(n)
        firsts.append(F.when(n > 0, _words_before(p, F.instr(p, x))))
        lasts.append(F.when(n > 0, _words_before(p, F.length(p) - F.instr(back, x[::-1]) - len(x) + 2)))
        base.append(F.when(n > 0, F.lit(label)))
    df = (
        df.withColumn("n_base", reduce(lambda a, b: a + b, counts))
        .withColumn("first_word", F.least(*firsts))
        .withColumn("last_word", F.greatest(*lasts))
        .withColumn("_base", F.array_compact(F.array(*base)))
    )
    vote = "struct<t:int,start:int,idf:double>"
    index = F.create_map(*[x for w, found in postings.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("t"), F.lit(i).alias("i"), F.lit(v).alias("v")) for k, i, v in found]))])
    listed = F.array(*[F.lit(w) for w in postings])
    at = F.filter(F.transform(F.col("_w"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(listed, x["w"]))
    votes = F.flatten(F.transform(at, lambda x: F.transform(index[x["w"]], lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["i"]).cast("int").alias("start"), q["v"].alias("idf")))))
    # the largest sum of votes for one template whose starts lie close together: a window slides over the sorted votes
    df = df.withColumn("_v", F.when(F.size("_w") > 0, F.sort_array(votes)).otherwise(F.array().cast(f"array<{vote}>")))

    def step(acc, v):
        near = F.filter(F.concat(acc["near"], F.array(v)), lambda x: x["start"] >= v["start"] - SLACK)
        total = F.aggregate(near, F.lit(0.0), lambda a, x: a + x["idf"])
        return F.struct(near.alias("near"), F.greatest(acc["best"], total).alias("best"))

    def alignment(k: int) -> Column:
        zero = F.struct(F.array().cast(f"array<{vote}>").alias("near"), F.lit(0.0).alias("best"))
        return F.aggregate(F.filter("_v", lambda v: v["t"] == k), zero, step, lambda acc: F.least(F.lit(1.0), acc["best"] / F.lit(totals[k])))

    hits = []
    for k, (label, phrases, _) in enumerate(templates):
        keys = reduce(lambda a, b: a & b, [F.contains(p, F.lit(_phrase(x))) for x in phrases])
        hits.append(F.struct(F.lit(label).alias("label"), F.when((F.size("_v") > 0) & keys, alignment(k)).otherwise(0.0).alias("score")))
    df = df.withColumn("_h", F.filter(F.array(*hits), lambda h: h["score"] >= threshold))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("_h", lambda h: h["score"])), F.lit(0.0))
    return (
        df.withColumn("base_labels", joined(F.col("_base")))
        .withColumn("labels", joined(F.concat(F.col("_base"), F.transform("_h", lambda h: h["label"]))))
        .withColumn("score", F.when(F.col("n_base") > 0, 1.0).otherwise(best))
        .drop("_w", "_p", "_base", "_v", "_h")
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", "text")).drop("text")
