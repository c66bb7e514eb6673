"""License statements in texts, in DataFrame functions only: phrases, and an exact set-similarity join.

Text blocks and statement templates are token sets in one order, rarest token first by its count over all blocks. A
block is a run of words across line ends, twice as long as the longest template; the next one begins half a block
later, so a statement wrapped over lines lies whole in some block. A block that holds the needed share of a template
has one of the template's first |T| - need + 1 tokens (prefix filter), is long enough (length filter), and has enough
tokens left behind its first match (positional filter). What passes is compared in full, so the join is exact. Of
templates that hardly differ (a license and its variants) a block has the one that it holds best, then the longest.

Defined results: a null or empty text has no words, labels '' and score 0; repeated rows are scanned one by one; an
empty table gives no rows; other columns pass through whatever their names are, unless they clash with the result,
which then wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, let, lower_ascii, own_columns, stored

# Phrases and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Statements by which texts name their license.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.9  # share of a template's tokens that a block must hold
ALIKE = 0.6  # Jaccard similarity of templates of which a block has only the best


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"([^{NOT_ALNUM}]+)"), F.lit(1))


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """(label, sorted distinct words) of each template."""
    out = []
    for label, text in templates:
        cleaned = "".join(c if not c.isascii() or c.isalnum() else " " for c in text.lower())
        out.append((label, sorted(set(cleaned.split()))))
    return out


def _phrase_places(words: Column) -> Column:
    """Array of (start, label) of all places of the phrases; they all end in the word license."""

    def label(i: Column) -> Column:
        case = None
        for phrase, name in PHRASES.items():
            parts = phrase.split(" ")
            same = F.lit(True)
            for back, part in enumerate(reversed(parts)):
                same = same & (F.get(words, i - back) == part)
            value = F.struct((i - (len(parts) - 1)).cast("bigint").alias("start"), F.lit(name).alias("label"))
            case = F.when(same, value) if case is None else case.when(same, value)
        return case

    places = F.transform(F.sequence(F.lit(0), F.size(words) - 1), label)
    return F.filter(places, lambda p: p.isNotNull())


def needed(words: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def half_block(templates: list[tuple[str, str]]) -> int:
    """Words of half a block: those of the longest template, repeated ones counted."""
    return max(len("".join(c if not c.isascii() or c.isalnum() else " " for c in text).split()) for _, text in templates)


def alike(sets: list[tuple[str, list[str]]]) -> list[tuple[int, list[int]]]:
    """Of each template those that hardly differ from it, itself left out."""
    def similarity(a: list[str], b: list[str]) -> float:
        return len(set(a) & set(b)) / len(set(a) | set(b))

    return [(i, [j for j, (_, b) in enumerate(sets) if j != i and similarity(a, b) >= ALIKE]) for i, (_, a) in enumerate(sets)]


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """Columns of docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sets, half = template_sets(templates), half_block(templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    result = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own, kept = own_columns(docs, *result, text)
    none = F.lit([]).cast("array<struct<start:bigint,label:string>>")
    # A block with the needed share of a template has one of these, as many of its longest words as it may lack and one.
    telling = sorted({w for _, words in sets for w in sorted(words, key=lambda w: (-len(w), w))[:len(words) - needed(words, threshold) + 1]})

    def blocks(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(half)), lambda i: F.slice(words, i + 1, F.lit(2 * half)))
        told = F.filter(runs, lambda run: F.arrays_overlap(run, F.lit(telling)))
        return F.transform(told, lambda run: F.array_intersect(run, F.lit(vocabulary)))

    of_words = let(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.when((F.size(w) > 0) & F.array_contains(w, "license"), _phrase_places(w)).otherwise(none).alias("places"),
        F.when(F.arrays_overlap(w, F.lit(telling)), blocks(w)).otherwise(F.lit([]).cast("array<array<string>>")).alias("blocks")))
    # One pass over the texts: a document's places, and of its blocks the words that occur in some template.
    rows = stored(docs.select(own, of_words.alias("w"), F.monotonically_increasing_id().alias("row")))
    lines = rows.select("row", F.posexplode("w.blocks").alias("block_no", "tokens"))
    counted = lines.select(F.explode("tokens").alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in counted.collect()}  # at most one row per template word
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    prefixes = []
    for number, (_, words) in enumerate(sets):
        tokens = sorted(words, key=rank.__getitem__)
        need = needed(words, threshold)
        prefix = tokens[:len(tokens) - need + 1]
        prefixes += [(token, i, number, need, prefix, tokens) for i, token in enumerate(prefix)]
    least = min(p[3] for p in prefixes)
    starts = spark.createDataFrame(
        prefixes, "token string, i int, template int, need int, prefix array<string>, of array<string>")
    ordered = lines.select("row", "block_no", F.array_intersect(F.lit(order), "tokens").alias("block")).where(
        F.size("block") >= least)
    some = F.lit([w for w in order if w in {p[0] for p in prefixes}])
    exploded = ordered.select("row", "block_no", "block", F.explode(F.array_intersect(some, F.col("block"))).alias("token"))
    first = F.get(F.array_intersect("prefix", "block"), F.lit(0)) == F.col("token")
    behind = F.least(F.size("of") - F.col("i") - 1, F.size("block") - F.array_position("block", F.col("token")))
    candidates = exploded.join(F.broadcast(starts), "token").where(  # a bounded side: a row per prefix word
        first & (F.size("block") >= F.col("need")) & (behind + 1 >= F.col("need")))
    overlap = F.size(F.array_intersect("of", "block"))
    held = candidates.where(overlap >= F.col("need")).groupBy("row", "block_no").agg(F.collect_list(F.struct(
        (overlap / F.size("of")).alias("share"), F.size("of").alias("size"), "template")).alias("held"))
    rivals = F.create_map(*[F.lit(x) for number, others in alike(sets) for x in (number, F.lit(others).cast("array<int>"))])
    labels = F.array(*[F.lit(label) for label, _ in sets])
    best = F.filter("held", lambda x: ~F.exists("held", lambda y: (y > x) & F.array_contains(
        F.element_at(rivals, x["template"]), y["template"])))
    found = held.select("row", F.explode(best).alias("b")).groupBy("row").agg(
        F.collect_set(F.get(labels, F.col("b.template"))).alias("more"), F.max("b.share").alias("share"))
    places, base = F.col("w.places"), F.array_sort(F.array_distinct(F.col("w.places.label")))
    empty = F.lit([]).cast("array<string>")
    return rows.join(found, "row", "left").select(
        *kept,
        F.col("w.n_words").alias("n_words"), F.size(places).cast("bigint").alias("n_base"),
        F.array_min("w.places.start").alias("first_word"), F.array_max("w.places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", empty))), ",").alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
