"""License scans: an exact set-similarity join of text blocks with license templates, in SQL functions only.

A block is a line of a text; blocks and templates are sets of words. A block matches a template
if it contains at least THRESHOLD of the template's words. A notice may be wrapped: so is every run of
consecutive words that goes on beyond a line's end a block for a template, if it is no longer than the
template's words divided by THRESHOLD (``wrapped_matches``). The join of lines follows the usual filters,
all of which are lossless:

* words are ordered by how many blocks of the corpus hold them, rarest first. Only template words
  can add to an overlap, so blocks are reduced to these (in that order) and only these are counted;
  the order has as many entries as the templates have words, whatever the corpus;
* *length*: a block must hold at least ``need`` template words, need = ceil(THRESHOLD * template);
* *prefix*: if overlap >= need, the first len - need + 1 words of template and block share a word;
* *position*: with the shared word at places i and j, at most 1 + min(words after i, words after j)
  more can agree;
* survivors are verified on the full sets.

Everything happens inside a row: no shuffle but the count of template words.

Null texts count as empty, without words, places or labels. Empty lines are empty blocks. Repeated rows
and repeated ids are scanned one by one; other columns pass through, whatever their names, except that
``scan`` is replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SEPARATORS, ascii_lower, let, split_words, strings

THRESHOLD = 0.9
#: Templates are part of the plan: so many words in all of them together, at most.
MAX_TEMPLATE_WORDS = 20_000

# Phrases with the label that a place of theirs gives.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices as licenses ask for them, with their label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
]


def word_list(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def word_set(text: str) -> list[str]:
    return list(dict.fromkeys(word_list(text)))


def needed(words: list[str], threshold: float) -> int:
    return max(1, math.ceil(round(threshold * len(words), 9)))


def blocks(text: Column) -> Column:
    """The words of each line."""
    return F.transform(F.split(ascii_lower(text), "\n"), split_words)


def block_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many blocks each word of ``vocabulary`` occurs: one row for each word at most."""
    held = F.flatten(F.transform(blocks(F.col("text")), lambda b: F.array_intersect(strings(vocabulary), b)))
    found = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    return {w: 0 for w in vocabulary} | {r["word"]: r["count"] for r in found.collect()}


def template_matches(lines: Column, templates: list[tuple[str, str]], counts: dict[str, int], threshold: float) -> Column:
    """array<struct<block, label, overlap, containment>> of the blocks in ``lines``."""
    order = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    sets = [(label, sorted(words, key=order.get)) for label, words in ((n, word_set(t)) for n, t in templates)]
    index = F.array(*[
        F.struct(F.lit(label).alias("label"), strings(words).alias("words"), F.lit(needed(words, threshold)).alias("need"))
        for label, words in sets])
    starts = {w for _, words in sets for w in words[: len(words) - needed(words, threshold) + 1]}

    def candidate(block: Column, t: Column) -> Column:
        def anchored(word: Column, i: Column) -> Column:
            j = F.array_position(block, word)  # from 1; 0: not there
            after = F.least(F.size(t["words"]) - 1 - i, F.size(block) - j)
            return (j > 0) & (j <= F.size(block) - t["need"] + 1) & (after + 1 + i >= t["need"])

        prefix = F.slice(t["words"], 1, F.size(t["words"]) - t["need"] + 1)
        found = F.filter(prefix, anchored)
        return (F.size(block) >= t["need"]) & (F.size(found) > 0)

    def of_block(words: Column, k: Column) -> Column:
        ordered = F.array_intersect(strings(sorted(order, key=order.get)), words)
        joined = let(ordered, lambda block: F.transform(
            F.filter(index, lambda t: candidate(block, t)),
            lambda t: let(F.size(F.array_intersect(t["words"], block)), lambda both: F.struct(
                k.alias("block"), t["label"].alias("label"), both.alias("overlap"), t["need"].alias("need"),
                (both / F.size(t["words"])).alias("containment")))))
        return F.when(F.arrays_overlap(words, strings(sorted(starts))), joined)

    looked_at = F.filter(F.transform(lines, of_block), lambda found: found.isNotNull())
    return F.filter(F.flatten(looked_at), lambda m: m["overlap"] >= m["need"])


def wrapped_matches(lines: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Like ``template_matches``, of the words around the ends of ``lines``: the best run that starts in a line and leaves it.

    A run starts at a word of the template (others in front add nothing), so it has ``reach`` words from there. Templates
    that the whole text, then the words around an end, do not hold often enough are passed over; both lose nothing.
    """
    sets = [(label, word_set(t), math.ceil(round(len(word_list(t)) / threshold, 9))) for label, t in templates]
    index = F.array(*[
        F.struct(F.lit(label).alias("label"), strings(words).alias("words"), F.lit(needed(words, threshold)).alias("need"),
                 F.lit(reach).alias("reach"))
        for label, words, reach in sets])
    most = max(1, *(reach - 1 for _, _, reach in sets))
    vocabulary = strings(sorted({w for _, words, _ in sets for w in words}))

    def of_text(held: Column) -> Column:
        return F.filter(index, lambda t: F.size(F.array_intersect(t["words"], held)) >= t["need"])

    def of_end(tail: Column, ahead: Column, line: Column, possible: Column) -> Column:
        def best(t: Column, run: Column) -> Column:
            first = F.greatest(F.size(tail) - t["reach"] + 2, F.lit(1))
            return F.array_max(F.transform(F.sequence(first, F.size(tail)), lambda i: F.when(
                F.array_contains(t["words"], F.element_at(run, i)), F.size(F.array_intersect(t["words"], F.slice(run, i, t["reach"]))))))

        def match(t: Column, both: Column) -> Column:
            return F.struct(line.alias("block"), t["label"].alias("label"), both.alias("overlap"), t["need"].alias("need"),
                            (both / F.size(t["words"])).alias("containment"))

        return let(F.concat(tail, ahead), lambda run: F.transform(
            F.filter(possible, lambda t: F.size(F.array_intersect(t["words"], run)) >= t["need"]),
            lambda t: let(F.coalesce(best(t, run), F.lit(0)), lambda both: match(t, both))))

    def of_lines(possible: Column) -> Column:
        cut = F.filter(F.transform(lines, lambda b, k: F.struct(
            k.alias("line"), F.slice(b, 1, most).alias("head"), F.slice(b, F.greatest(F.size(b) - most + 1, F.lit(1)), most).alias("tail"))),
            lambda b: F.size(b["head"]) > 0)
        # A line here has a word at least, so the next ``most`` lines hold all that a run can reach.
        return let(cut, lambda held: F.flatten(F.transform(held, lambda b, k: let(b["tail"], lambda tail: let(
            F.slice(F.flatten(F.transform(F.slice(held, k + 2, most), lambda n: n["head"])), 1, most),
            lambda ahead: of_end(tail, ahead, b["line"], possible))))))

    found = let(F.array_intersect(vocabulary, F.flatten(lines)), lambda held: let(of_text(held), lambda possible: F.when(
        F.size(possible) > 0, F.filter(of_lines(possible), lambda m: m["overlap"] >= m["need"]))))
    return F.when(F.size(lines) > 1, found)


def phrase_places(words: Column) -> Column:
    """array<struct<start, label>>: where the words of a phrase stand consecutively."""
    def label_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            here = F.lit(True)
            for k, w in enumerate(phrase.split()):
                here = here & F.coalesce(F.get(words, i + k) == w, F.lit(False))
            out = F.when(here, F.lit(label)).otherwise(out)
        return out

    each = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("start"), label_at(i).alias("label")))
    return F.when(F.size(words) > 0, F.filter(each, lambda p: p["label"].isNotNull()))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``scan``: n_words, places (base phrases) and matches (templates) of ``text``."""
    vocabulary = sorted({w for _, t in templates for w in word_set(t)})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have {len(vocabulary)} words; split them into runs of {MAX_TEMPLATE_WORDS}")
    counts = block_counts(docs, vocabulary)
    # A text in which no phrase can stand needs no look at its words.
    gaps = "|".join(SEPARATORS.join(p.split()) for p in PHRASES)
    return docs.withColumn("scan", let(ascii_lower(F.col("text")), lambda low: let(
        F.transform(F.split(low, "\n"), split_words), lambda lines: F.struct(
            F.aggregate(lines, F.lit(0), lambda n, b: n + F.size(b)).cast("long").alias("n_words"),
            F.when(low.rlike(gaps), let(F.flatten(lines), phrase_places)).alias("places"),
            F.concat(template_matches(lines, templates, counts, threshold), F.coalesce(
                wrapped_matches(lines, templates, threshold),
                F.array().cast("array<struct<block:int,label:string,overlap:int,need:int,containment:double>>"))).alias("matches")))))


def report(scanned: DataFrame) -> DataFrame:
    """One row of figures for each scanned row."""
    places, matches = F.col("scan.places"), F.col("scan.matches")
    base = F.coalesce(F.transform(places, lambda p: p["label"]), strings([]))
    starts = F.transform(places, lambda p: p["start"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform(matches, lambda m: m["containment"]))
    return scanned.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform(matches, lambda m: m["label"]))).alias("labels"),
        F.greatest(F.when(F.size(base) > 0, 1.0).otherwise(0.0), F.coalesce(best, F.lit(0.0))).alias("score"))


def report_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """``report`` over documents as SQL, by comparing every line with every template."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ", ".join(
        f"{{'label': '{label}', 'words': {quoted(w)}, 'need': {needed(w, threshold)}}}"
        for label, w in ((n, word_set(t)) for n, t in templates))
    phrase = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(), 1))
    places = " ".join(f"WHEN {phrase(p)} THEN '{label}'" for p, label in PHRASES.items())
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, {word}) AS w,
  list_transform(string_split(t, chr(10)), lambda b: list_distinct(regexp_extract_all(b, {word}))) AS lines FROM low),
placed AS (SELECT doc_id, w, lines,
  list_filter(list_transform(range(len(w)), lambda i: {{'i': i, 'label': CASE {places} END}}), lambda p: p.label IS NOT NULL) AS p
  FROM words),
matched AS (SELECT doc_id, len(w) AS n_words, list_transform(p, lambda x: x.i) AS starts, list_transform(p, lambda x: x.label) AS base,
  list_filter(flatten(list_transform(lines, lambda b: list_transform([{rows}],
    lambda t: {{'label': t.label, 'need': t.need, 'both': len(list_intersect(b, t.words)), 'size': len(t.words)}}))),
    lambda m: m.both >= m.need) AS m
  FROM placed)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
  CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, list_transform(m, lambda x: x.label)))), ','), '') AS labels,
  greatest(CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
    coalesce(list_max(list_transform(m, lambda x: x.both::DOUBLE / x.size)), 0.0::DOUBLE)) AS score
FROM matched
"""
