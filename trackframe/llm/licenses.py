"""License scan by diagonal voting.

All runs of K words of all texts are joined by hash to the places of the same runs in license templates. Each
meeting votes for a diagonal (place in the text minus place in the template); the votes of a diagonal and of its
neighbours, which inserted or lost words shift apart, are added, and a span is verified by the share of the
template, or of a long stretch of it, that its votes cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trackframe.llm.texts import ascii_lower, text_of

K = 3
APART = 3         # diagonals this far from each other belong together
STRETCH = 20      # runs that suffice of a long template
SHARE = 0.8       # of the template, or of the stretch that the span covers

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Well-known license statements, as published.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
               "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
               "OF ANY KIND, either express or implied."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version 3 of the License, or any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
            "this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


def words_of(text: Column) -> Column:
    """The words of an ASCII-lower-cased text: runs of a-z, 0-9 and everything beyond ASCII."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def runs_of(words: Column, k: int) -> Column:
    """A hash of every k consecutive words; none in a shorter text."""
    last = F.size(words) - F.lit(k)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(words, i, k))))


def template_runs(spark: SparkSession, templates=None, k: int = K) -> DataFrame:
    """template, label, run (hash), t_place and t_runs (runs of the whole template)."""
    rows = [(i, label, text) for i, (label, text) in enumerate(TEMPLATES if templates is None else templates)]
    given = spark.createDataFrame(rows, "template int, label string, text string")
    words = given.select("template", "label", words_of(ascii_lower(F.col("text"))).alias("words"))
    return (words.select("template", "label", runs_of(F.col("words"), k).alias("runs"))
            .select("template", "label", F.size("runs").alias("t_runs"), F.posexplode("runs").alias("t_place", "run")))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    last = F.size(words) - F.lit(len(parts))

    def stands(n):
        met = F.element_at(words, (n + 1).cast("int")) == F.lit(parts[0])
        for i, p in enumerate(parts[1:], 2):
            met = met & (F.element_at(words, (n + i).cast("int")) == F.lit(p))
        return met

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """doc_id, _key (of equal rows), text: rows that repeat id and text are told apart by nothing else."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), ascii_lower(text_of(text)).alias("text"))
    return source.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("_id"), F.xxhash64("text").alias("_key"), "text")


def license_spans(docs: DataFrame, templates=None, k: int = K, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _key, label, first (word), last (word), votes, share, verified of every merged diagonal.

    _id and _key identify rows of equal id and text.
    """
    runs = (keyed(docs, id_column, text).select("_id", "_key", words_of(F.col("text")).alias("words"))
            .select("_id", "_key", F.posexplode(runs_of(F.col("words"), k)).alias("place", "run")))
    # constants of the library or of the caller's code: a few thousand rows at most
    known = F.broadcast(template_runs(docs.sparkSession, templates, k))
    met = runs.join(known, "run").select("_id", "_key", "template", "label", "t_runs", "t_place", "place").distinct()
    votes = (met.withColumn("diagonal", F.col("place") - F.col("t_place"))
             .groupBy("_id", "_key", "template", "label", "t_runs", "diagonal")
             .agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"),
                  F.min("t_place").alias("t_first"), F.max("t_place").alias("t_last")))
    row = Window.partitionBy("_id", "_key", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(row) > APART).cast("int"), F.lit(1))
    merged = (votes.withColumn("_apart", apart).withColumn("_span", F.sum("_apart").over(row))
              .groupBy("_id", "_key", "template", "label", "t_runs", "_span")
              .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"),
                   (F.max("t_last") - F.min("t_first") + 1).alias("stretch")))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("t_runs"))
    long = (F.col("votes") >= STRETCH) & (F.col("votes") >= SHARE * F.col("stretch"))
    return merged.select("_id", "_key", "label", "first", "last", "votes", share.alias("share"),
                         ((share >= SHARE) | long).alias("verified"))


def license_scan(docs: DataFrame, templates=None, k: int = K, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    The base is where a phrase's words follow each other; labels adds those of verified spans. score is the
    largest share of a template that a span covers, 1 where a base phrase stands. Null texts count as empty;
    texts without words have no places, empty labels and score 0. Repeated rows are kept. An empty table gives
    no rows.
    """
    words = keyed(docs, id_column, text).select(
        "doc_id", "_id", "_key", F.contains(F.col("text"), F.lit("license")).alias("_some"),
        words_of(F.col("text")).alias("words"))
    none = F.array().cast("array<int>")
    places = {p: F.when(F.col("_some"), _places(F.col("words"), p)).otherwise(none) for p in PHRASES}
    base = words.select("doc_id", "_id", "_key", F.size("words").cast("long").alias("n_words"),
                        *[v.alias(f"_{PHRASES[p]}") for p, v in places.items()])
    names = [f"_{v}" for v in PHRASES.values()]
    every = F.concat(*names)
    found = F.filter(F.array(*[F.when(F.size(n) > 0, F.lit(n[1:])) for n in names]), lambda x: x.isNotNull())
    base = base.select("doc_id", "_id", "_key", "n_words", F.size(every).cast("long").alias("n_base"),
                       F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
                       F.array_sort(found).alias("_base"))
    spans = (license_spans(docs, templates, k, id_column, text).groupBy("_id", "_key")
             .agg(F.collect_set(F.when(F.col("verified"), F.col("label"))).alias("_more"),
                  F.max("share").alias("_share")))
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return base.join(spans, ["_id", "_key"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", more)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.round(F.coalesce("_share", F.lit(0.0)), 6)).alias("score"))
