"""License scans: places of known phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of words, twice as long as the longest template, so that any passage of a template's
length lies whole in one of them. Words are ordered by their frequency over all documents, rarest first. A block can
contain `threshold` of a template only if it has a word of the template's prefix (the rarest words, one more than may be
missing), if it is long enough, and if enough words stand behind the first shared one in both; pairs that pass these
three filters are verified. Words that no template has can add nothing to an overlap and are left out of the blocks.

Defined cases: a null text is the empty one (no words, no labels, score 0); null ids and repeated rows get results like
any other row; an empty table gives an empty result; a template without words is left out; extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

#: Fixed phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Passages that identify a license, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8
#: A row's key: two hashes of 64 bits.
KEY = ("license_key", "license_key_2")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. lower() does the same to them; two other letters would turn into ASCII, so texts with those go by table."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(text.rlike("[İK]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAK), "")


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(BREAK, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def _places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand one after another."""
    first, *rest = phrase.split(" ")

    def at(w: Column, i: Column) -> Column:
        hit = w == first
        for k, p in enumerate(rest, 1):
            hit = hit & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(hit, i)

    return F.filter(F.transform(words, at), lambda i: i.isNotNull())


def _key() -> list[Column]:
    """128 bits of id and text."""
    return [F.xxhash64("doc_id", "text").alias(KEY[0]), F.xxhash64(F.lit(KEY[1]), "text", "doc_id").alias(KEY[1])]


def _read(docs: DataFrame, vocabulary: list[str], phrases: tuple) -> DataFrame:
    """doc_id, the key's columns, n_words, places (array of one array per phrase), has (template words in it), written to the shared folder."""
    words = F.col("license_words")
    known = sorted({*vocabulary, *(w for p, _ in phrases for w in p.split(" "))})
    cut = docs.select("doc_id", *_key(), base.once(license_words(base.text_of())).alias("license_words"))
    seen = cut.withColumn("has", base.once(F.array_intersect(F.lit(known), words)))
    none = F.array().cast("array<int>")
    places = F.array(*[F.when(_contains_all(F.col("has"), p), _places(words, p)).otherwise(none) for p, _ in phrases])
    return base.saved(seen.select("doc_id", *KEY, F.size(words).cast("long").alias("n_words"), places.alias("places"), "has"), "license-words")


def _contains_all(has: Column, phrase: str) -> Column:
    out = F.lit(True)
    for w in phrase.split(" "):
        out = out & F.array_contains(has, w)
    return out


def containment_join(docs: DataFrame, order: list[str], templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The key's columns, label, score for every block of docs (doc_id, text) that contains `threshold` of a template's words.

    order: the template words, rarest first. The index over the templates' prefixes is as large as the template list,
    a parameter, and is broadcast.
    """
    spark = docs.sparkSession
    place = {w: i for i, w in enumerate(order)}
    sets = [(label, sorted(set(_tokens(t)), key=place.__getitem__)) for label, t in templates if _tokens(t)]
    need = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    index = spark.createDataFrame(
        [(w, k, i, len(s), need[k]) for k, (_, s) in enumerate(sets) for i, w in enumerate(s[: len(s) - need[k] + 1])],
        "token string, template int, t_at int, t_size int, need int",
    )
    known = spark.createDataFrame([(k, label, s) for k, (label, s) in enumerate(sets)], "template int, label string, tokens array<string>")
    size = 2 * max(len(_tokens(t)) for _, t in templates)
    step = size // 2
    prefixes = sorted({w for k, (_, s) in enumerate(sets) for w in s[: len(s) - need[k] + 1]})
    text = base.text_of()
    # The prefix filter for whole texts: without any prefix word no block can pass.
    some = docs.filter(text.rlike("(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, prefixes)) + ")"))
    cut = some.select(*_key(), base.once(license_words(text)).alias("license_words"))
    words = F.col("license_words")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(words) - 1) / step)).cast("int"))
    blocks = cut.select(*KEY, F.explode(F.transform(starts, lambda k: F.array_intersect(F.lit(order), F.slice(words, k * step + 1, size)))).alias("block"))
    b = F.size("block")
    hits = (
        blocks.filter(b >= min(need))
        .select(*KEY, "block", F.posexplode(F.slice("block", 1, b - min(need) + 1)).alias("b_at", "token"))
        .join(F.broadcast(index), "token")
        .filter((b >= F.col("need")) & (1 + F.least(F.col("t_size") - F.col("t_at") - 1, b - F.col("b_at") - 1) >= F.col("need")))
        .dropDuplicates([*KEY, "template", "block"])
        .join(F.broadcast(known), "template")
    )
    shared = F.size(F.array_intersect("block", "tokens"))
    return hits.filter(shared >= F.col("need")).groupBy(*KEY, "label").agg(F.max(shared / F.col("t_size")).alias("score"))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD, phrases: tuple = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row per row of docs.

    score: the largest containment found, 1 where a phrase stands, 0 where nothing is found.
    """
    vocabulary = sorted({w for _, t in templates for w in _tokens(t)})
    read = _read(docs, vocabulary, phrases)
    counted = read.select(F.explode("has").alias("w")).groupBy("w").count()  # a row per template word
    df = {r.w: r["count"] for r in counted.collect()}
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    found = containment_join(docs.select("doc_id", "text"), order, templates, threshold)
    # Written, so that the join is one of two plain shuffles, of which the side of a hot key's rows can be split.
    by_doc = base.saved(found.groupBy(*KEY).agg(F.collect_set("label").alias("more"), F.max("score").alias("best")), "license-labels")
    places = F.flatten("places")
    base_labels = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(F.size(F.get("places", k)) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    joined = read.join(by_doc.hint("merge"), list(KEY), "left")
    n_base = F.size(places)
    return joined.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(base.table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_licenses": op8_licenses}
