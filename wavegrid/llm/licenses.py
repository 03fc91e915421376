"""License scans: fixed phrases and an exact set-similarity join with license templates.

A template is found in a text block that holds at least `threshold` of the template's distinct
words (containment). The text blocks of a template are all runs of its own length and an eighth
more words over the words of the whole text, so that it may be wrapped over lines, stand within a
paragraph and have a few other words in it, but words scattered over a text are no license. A run
counts from a word of the templates on: one that begins before it holds no more of them. The join
is exact and uses these filters:

- document: runs of a length are made only where the whole text holds `needed` words of a
  template of that length;
- order: the templates' words by how many blocks hold them, the rarest first, counted over all
  documents; a block's words are brought into the same order (other words cannot match);
- prefix: a block that reaches the threshold holds one of the template's first
  size - needed + 1 words;
- length: the block has at least `needed` template words;
- position: what stands before and after the common word in both orders leaves room for
  `needed` common words.

Templates are a parameter and few: they are sent to all tasks, whatever the corpus. Runs that reach
the threshold and overlap are one block; every block is a match, with the containment and the place
of its best run (ties: the first): the numbers of the first and last template words in it.

Edge cases: null and empty texts have no words and no labels; very long texts and lines of any
length are handled whole; each row is a document of its own, also where its doc_id is null or
repeated; blocks that repeat without a gap are one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import ascii_lower, columns_of, cut, documents

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base scan and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Characteristic sentences of public licenses (fixed values), by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
)


def run_length(template: str) -> int:
    """Words of a template's blocks."""
    n = len(template.split())
    return n + n // 8


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def places(words: Column, phrase: str) -> Column:
    """Word numbers (from 0) at which the phrase stands."""
    parts = phrase.split()
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    starts = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: F.slice(words, i + 1, len(parts)) == strings(parts)
    )
    return F.when(F.contains(joined, F.lit(f" {phrase} ")), starts).otherwise(F.array().cast("array<int>"))


BLOCKS = "array<struct<length:int,held:array<string>,first:int,last:int,goes_on:boolean>>"


def runs(words: Column, held: Column, sets: Sequence[tuple[int, list[str], int]]) -> Column:
    """(length, held, first, last, goes_on): template words of each run of a template's length, from each of `held` on, and their places.

    sets: (length, distinct words, needed words) of each template. Of a series of overlapping runs
    with equal words the first and the last are given; goes_on tells the last of a series.
    """

    def fits(length: int) -> Column:
        return reduce(or_, [F.size(F.array_intersect(strings(ws), held)) >= need for n, ws, need in sets if n == length])

    lengths = sorted({n for n, _, _ in sets})
    nothing = F.array().cast(BLOCKS)
    if not lengths:
        return nothing
    known = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains(held, x["word"]))
    named = lambda array, made: F.flatten(F.transform(F.array(array), made))  # noqa: E731  an array that is made once and used often

    def of_length(known: Column, n: int) -> Column:
        least = min(need for m, _, need in sets if m == n)
        run = lambda x, i: F.filter(F.slice(known, i + 1, F.lit(n)), lambda y: y["at"] < x["at"] + n)
        block = lambda r: F.struct(
            F.lit(n).alias("length"), F.array_distinct(F.transform(r, lambda y: y["word"])).alias("held"),
            F.get(r, F.lit(0))["at"].cast("int").alias("first"), F.element_at(r, -1)["at"].cast("int").alias("last"),
        )
        full = F.filter(F.flatten(F.transform(known, lambda x, i: F.transform(F.array(run(x, i)), block))), lambda b: F.size(b["held"]) >= least)
        # Equal runs follow one another where a text is of one kind: the ends of each series are left.
        alike = lambda a, b: F.coalesce((a["held"] == b["held"]) & (b["first"] <= a["last"]), F.lit(False))
        told = lambda f: F.transform(f, lambda b, j: F.struct(*[b[c] for c in ("length", "held", "first", "last")], alike(F.get(f, j - 1), b).alias("goes_on"), alike(b, F.get(f, j + 1)).alias("more")))
        ends = lambda f: F.filter(told(f), lambda b: ~(b["goes_on"] & b["more"]))
        once = named(full, lambda f: F.transform(ends(f), lambda b: F.struct(*[b[c] for c in ("length", "held", "first", "last", "goes_on")])))
        return F.when(fits(n), once).otherwise(nothing)

    made = named(known, lambda k: F.concat(*[of_length(k, n) for n in lengths]))
    return F.when(reduce(or_, map(fits, lengths)), made).otherwise(nothing)


def scan(docs: DataFrame, phrases: Mapping[str, str], vocabulary: Sequence[str], sets: Sequence[tuple[int, list[str], int]]) -> DataFrame:
    """One row for each document: base counts and the blocks with enough words of the vocabulary for some template."""
    doc_id, text = columns_of(docs, "doc_id", "text")
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    worded = docs.select(doc_id.alias("doc_id"), words.alias("words"))
    flat = worded.select("*", F.array_intersect(strings(vocabulary), F.col("words")).alias("held"))
    flat = flat.select("doc_id", "words", runs(F.col("words"), F.col("held"), sets).alias("blocks"))

    def labelled(phrase: str, label: str) -> Column:
        return F.transform(places(F.col("words"), phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    found = F.concat(*[labelled(p, label) for p, label in phrases.items()])
    based = flat.select("doc_id", F.size("words").cast("bigint").alias("n_words"), found.alias("found"), "blocks")
    at = F.transform("found", lambda x: x["at"])
    return based.select(
        "doc_id", "n_words", F.size("found").cast("bigint").alias("n_base"), F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"), F.sort_array(F.array_distinct(F.transform("found", lambda x: x["label"]))).alias("base"), "blocks",
    )


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.85) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, found) for each row.

    found: (label, template, containment, first, last) of every block of every template, by label,
    template and place; first and last are word numbers, from 0.
    """
    spark = docs.sparkSession
    sets = [(label, list(dict.fromkeys(t.split()))) for label, t in templates]
    needed = [math.ceil(threshold * len(w) - 1e-9) for _, w in sets]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    lengths = [run_length(t) for _, t in templates]
    scanned = scan(docs, phrases, vocabulary, [(n, w, need) for n, (_, w), need in zip(lengths, sets, needed, strict=True)])
    # The numbers of the rows hold for all that follows, as they are kept by the cut.
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    # One number for each word of the templates comes to the driver.
    frequency = dict(scanned.select(F.explode("blocks").alias("b")).select(F.explode("b.held").alias("w")).groupBy("w").count().collect())
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    rows = []
    for k, ((label, words), need) in enumerate(zip(sets, needed, strict=True)):
        ordered = sorted(words, key=place.__getitem__)
        rows += [(w, p, k, label, ordered, len(ordered), need, lengths[k]) for p, w in enumerate(ordered[: len(ordered) - need + 1])]
    prefixes = F.broadcast(spark.createDataFrame(rows, "word string, p int, template int, label string, words array<string>, size int, need int, n int"))

    first = {r[0] for r in rows}
    ordered = F.transform("blocks", lambda b: F.struct(b["length"], F.array_intersect(strings(order), b["held"]).alias("held"), b["first"], b["last"], b["goes_on"]))
    hit = F.filter(ordered, lambda b: F.arrays_overlap(b["held"], strings(sorted(first))))
    base = [c for c in scanned.columns if c != "blocks"]
    blocks = scanned.select(*base, F.explode_outer(hit).alias("block"))
    tokens = blocks.select(*base, "block", "block.length", "block.held", F.posexplode_outer("block.held").alias("q", "word"))
    room = F.least("p", "q") + 1 + F.least(F.col("size") - F.col("p") - 1, F.size("held") - F.col("q") - 1)
    # A null keeps the document where no template fits.
    fits = (F.size("held") >= F.col("need")) & (room >= F.col("need")) & F.coalesce(F.col("length") == F.col("n"), F.lit(True))
    matched = tokens.join(prefixes, "word", "left").withColumn("common", F.when(fits, F.size(F.array_intersect("words", "held"))))
    share = (F.col("common") / F.col("size")).alias("containment")
    # A run may be met by several of its words: it counts once.
    run = F.struct(F.col("block.first").alias("first"), F.col("block.last").alias("last"), F.col("block.goes_on").alias("goes_on"), share)
    of_template = matched.groupBy(*base, "template").agg(F.max("label").alias("label"), F.sort_array(F.collect_set(F.when(F.col("common") >= F.col("need"), run))).alias("runs"))
    return of_template.groupBy(*base).agg(F.sort_array(F.flatten(F.collect_list(whole_blocks()))).alias("found")).drop("row")


def whole_blocks() -> Column:
    """(label, template, containment, first, last) of the blocks that a template's runs make up, from its columns label, template and runs, in order of place."""
    runs = F.col("runs")
    before = lambda i: F.get(runs, i - 1)
    begins = F.transform(runs, lambda x, i: F.struct(i.alias("i"), ((i == 0) | ((x["first"] > before(i)["last"]) & ~x["goes_on"])).alias("begins")))
    starts = F.transform(F.filter(begins, lambda x: x["begins"]), lambda x: x["i"])
    end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(runs))

    def block(s: Column, i: Column, k: Column) -> Column:
        best = F.array_min(F.transform(F.slice(runs, i + 1, end(s, k) - i), lambda x: F.struct((-x["containment"]).alias("less"), x["first"].alias("first"), x["last"].alias("last"))))
        return F.struct(F.col("label"), F.col("template"), (-best["less"]).alias("containment"), best["first"].alias("first"), best["last"].alias("last"))

    return F.flatten(F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: block(s, i, k))))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    out = license_scan(documents(spark, sf_dir))
    labels = F.sort_array(F.array_distinct(F.concat("base", F.transform("found", lambda x: x["label"]))))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), F.size("found").cast("bigint").alias("n_blocks"),
    )
