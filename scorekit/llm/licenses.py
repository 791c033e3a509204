"""License scans by an exact set-similarity join of text blocks with notice templates
(DataFrame and SQL functions only).

A text's words are cut into overlapping blocks of ``BLOCK`` words, ``STRIDE`` apart, so
that every run of ``BLOCK - STRIDE`` words lies inside one.  A block meets a template if
it contains at least ``CONTAINMENT`` percent of the template's distinct words.  The join
finds every such pair without comparing each block with each template:

* Words of the templates are ordered by how many documents of the corpus have them,
  the rarest first.
* Prefix filter: to miss at most the allowed number of words, a block must have one of
  the template's first ``size - need + 1`` words in that order.  Texts without any
  prefix word are set aside before they are cut into blocks.
* Length filter: a block needs as many distinct template words as the template demands.
* Positional filter: the words that come after the shared prefix word, in the block and
  in the template, bound what the two can still share.
* What is left is compared in full.

The templates are a short list, so their index (some hundred rows) is broadcast, and the
frequencies of their words (as many rows at most) come to the driver.  Blocks never
shuffle; only the matching pairs do, summed map-side per document.

Base phrases are found in the word sequence itself, wherever they stand.

Edge cases: null and empty texts, and texts without words, have no place and score 0;
null ids and repeated rows are scanned like any other; a very long text is more blocks;
words of equal frequency are ordered by the word itself; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import ascii_lower, text_of

#: Runs of what is no word character, once A-Z are lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"),
           ("general public license", "gpl"))
# Wording of public license notices and clauses, and their labels.  Each is a
# clause that sets its license apart: a notice that differs from another license's by its
# name alone would meet that one's text as well.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages "
            "or other liability whether in an action of contract tort or otherwise"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed "
               "under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public "
            "license"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license "
            "document but changing it is not allowed"),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed "
             "to work with the library by being compiled or linked with it"),
    ("agpl", "if you modify the program your modified version must prominently offer all users "
             "interacting with it remotely through a computer network"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc", "to the extent possible under law the author has waived all copyright and related or "
           "neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any "
            "express or implied warranties including but not limited to"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event "
             "will the authors be held liable for any damages arising from the use"),
    ("zlib", "altered source versions must be plainly marked as such and must not be "
             "misrepresented as being the original software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one"),
    ("epl", "this program and the accompanying materials are made available under the terms of "
            "the eclipse public license"),
    ("epl", "the program including contributions may always be distributed subject to the version "
            "of the agreement under which it was received"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this "
                  "software either in source code form or as a compiled binary"),
)
CONTAINMENT = 80
BLOCK, STRIDE = 64, 32


def word_line(text_col: str):
    """The words of a text in lower case, one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(
        ascii_lower(text_of(text_col)), NO_WORD, " ")), F.lit(" "))


def _words(line: str = "line"):
    """The words of a line as an array, empty without words."""
    return F.when(F.length(line) > 2, F.split(F.trim(line), " ")).otherwise(
        F.expr("cast(array() as array<string>)"))


def word_order(lines: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each template word: by the documents that have it, rarest first."""
    known = F.array_intersect(_words(), F.array(*map(F.lit, vocabulary)))
    found = lines.select(F.explode(known).alias("word")).groupBy("word").count().collect()
    counts = {r["word"]: r["count"] for r in found}  # a row per template word at most
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def template_index(templates, rank: dict[str, int], containment: int) -> list[dict]:
    """A row per template and prefix word: the word's rank, its place in the template's
    order, the template's ranks, and the number of words a block must share."""
    rows = []
    for label, wording in templates:
        ranks = sorted({rank[w] for w in wording.split()})
        need = math.ceil(containment * len(ranks) / 100)
        rows += [{"label": label, "prefix": r, "place": i, "ranks": ranks, "need": need}
                 for i, r in enumerate(ranks[:len(ranks) - need + 1])]
    return rows


def _places(phrase: str) -> str:
    """SQL for the word numbers, from 0, at which a phrase starts."""
    words = phrase.split()
    same = " and ".join(f"element_at(words, i + {k + 1}) = '{w}'" for k, w in enumerate(words))
    return (f"if(size(words) < {len(words)}, cast(array() as array<int>), "
            f"filter(sequence(0, size(words) - {len(words)}), i -> {same}))")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  phrases=PHRASES, templates=TEMPLATES,
                  containment: int = CONTAINMENT) -> DataFrame:
    """One row per document: ``doc_id, n_words, places`` (``(start, label)`` of the base
    phrases in order), ``blocks`` (``(first_word, label, containment)`` of the matching
    blocks)."""
    spark = docs.sparkSession
    long = [t for _, t in templates if len(t.split()) > BLOCK - STRIDE]
    if long:
        raise ValueError(f"over {BLOCK - STRIDE} words, so block borders may cut it: {long[0]}")
    lines = docs.select(F.col(id_col).alias("doc_id"), word_line(text_col).alias("line"))
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rank = word_order(lines, vocabulary)
    index = template_index(templates, rank, containment)
    prefix_words = sorted({w for w in vocabulary if rank[w] in {r["prefix"] for r in index}})

    no_places = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    found = [F.expr(f"transform({_places(p)}, i -> named_struct('start', i, 'label', '{name}'))")
             for p, name in phrases]
    has_phrase = F.lit(False)
    for p, _ in phrases:
        has_phrase = has_phrase | F.col("line").contains(f" {p} ")
    d = lines.withColumn("words", _words())
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(has_phrase, F.array_sort(F.concat(*found))).otherwise(no_places).alias("places"),
        F.when(F.arrays_overlap("words", F.array(*map(F.lit, prefix_words))), F.col("words"))
         .alias("words"))
    d = materialize(d.withColumn("row", F.monotonically_increasing_id()), "license-words")

    ranks = F.create_map(*[F.lit(x) for kv in sorted(rank.items()) for x in kv])
    known = F.array(*map(F.lit, vocabulary))
    block_words = F.array_intersect(F.expr(f"slice(words, first_word + 1, {BLOCK})"), known)
    blocks = d.where("words is not null").select("row", "words", F.explode(F.expr(
        f"sequence(0, greatest(size(words) - {BLOCK - STRIDE} - 1, 0), {STRIDE})"))
        .alias("first_word"))
    blocks = blocks.select("row", "first_word", F.array_sort(F.transform(
        block_words, lambda w: F.element_at(ranks, w))).alias("block"))
    least = min(r["need"] for r in index)
    blocks = blocks.where(F.size("block") >= least)
    t = spark.createDataFrame([tuple(r.values()) for r in index],
                              "label string, prefix int, place int, ranks array<int>, need int")
    pairs = blocks.select("row", "first_word", "block", F.posexplode("block").alias("at", "prefix"))
    pairs = pairs.join(F.broadcast(t), "prefix")
    bound = 1 + F.least(F.size("ranks") - F.col("place") - 1, F.size("block") - F.col("at") - 1)
    pairs = pairs.where((F.size("block") >= F.col("need")) & (bound >= F.col("need")))
    shared = F.size(F.array_intersect("block", "ranks"))
    pairs = pairs.withColumn("shared", shared).where("shared >= need")
    hits = materialize(
        pairs.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(
            "first_word", "label", (F.col("shared") / F.size("ranks")).alias("containment"))))
            .alias("blocks")), "license-blocks")
    no_blocks = F.expr(
        "cast(array() as array<struct<first_word:int,label:string,containment:double>>)")
    return d.drop("words").join(hits, "row", "left").withColumn(
        "blocks", F.coalesce("blocks", no_blocks)).drop("row")


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, places and labels of a scan; the score is 1 with a base phrase, else the
    best containment, else 0."""
    d = scan_licenses(docs, id_col, text_col)
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("blocks.label"))))
    best = F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0))
    return d.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.col("places.start")).cast("long").alias("first_word"),
        F.array_max(F.col("places.start")).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"))
