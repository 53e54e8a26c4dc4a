"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a sentence or paragraph; one of more than `window` words is cut into windows of that many words which
overlap by half, so a notice of half a window lies whole in one. A template is a set of words. A block holds it if
at least `percent` of a hundred of the template's words occur in the block (containment, counted on whole sets).

The join finds every such pair without comparing blocks and templates one by one. The templates' words are ordered
by the number of their occurrences in the whole corpus, the rarest first. Prefix filter: a block that holds a
template has one of its first |T| - need + 1 words, so blocks meet templates at these words alone. Length filter:
it has `need` words of all templates or more. Positional filter: where the shared word stands at place i of the
template and j of the block, 1 + min(|T| - i, |B| - j) words at most can be common (places from 1), and a pair
goes on only if that reaches `need` at one of its words; at the first common word it does for every true pair.
The rest is confirmed on the whole sets. Words outside all templates can't be common, so blocks leave them out.

Each text is read once: what is written for it are its counts, its phrases and the templates' words of its blocks;
the join works on that. Labels found are a property of the text alone: they are aggregated by a digest of it, on
the map side first, and joined back by the digest, so no hot text gathers anywhere. Templates are a parameter of the
driver; words, counts and prefixes of them are all that is broadcast. Built from DataFrame functions alone.

Words are runs of digits, ASCII letters (A-Z lower-cased) and all characters beyond ASCII.

Edge cases: null and empty texts have no words, no places, empty label texts and a score of 0. Rows count one by
one, whatever doc_id they bear; null ids stay null. Templates without words never match. An empty table gives an
empty result. Extra columns are dropped.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, written

WINDOW, PERCENT = 64, 90
#: What stands between words, and what ends a block.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_END = r"[.!?;][\x20\x09-\x0D]+|\x0A[\x20\x09-\x0D]*\x0A"
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and wording of common public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "Licensed under a Creative Commons Attribution License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "Dedicated to the public domain under CC0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
Templates = list[tuple[str, str]]
#: What a translation turns into spaces, and A-Z into a-z.
_FROM = "".join(chr(c) for c in range(0x80) if not (chr(c).isdigit() or chr(c).islower()))
_TO = "".join(c.lower() if c.isupper() else " " for c in _FROM)


def plain(text: Column) -> Column:
    """The words of text, each with one space before and after; one space where there is none. Case is kept."""
    words = F.trim(F.regexp_replace(text, BETWEEN, " "))
    return F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("bigint")


def words_in(block: Column) -> Column:
    """The lower-cased words of a block: one pass that turns all else into spaces, then a split."""
    return F.array_remove(F.split(F.translate(block, _FROM, _TO), " "), "")


def with_phrases(rows: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Adds n_base, first_word, last_word and __base (labels) to rows (text, n_words); only texts with a phrase are looked at twice.

    No phrase may overlap another or itself. The cut text tells the words before the first and behind the last place.
    """
    anywhere = "|".join(BETWEEN.join(map(re.escape, p.split())) for p in phrases)
    rows = rows.withColumn("__plain", F.when(F.col("text").rlike(f"(?i)(?:{anywhere})"), plain(F.col("text"))))
    pattern = F.lit(f"(?i) (?:{'|'.join(map(re.escape, phrases))})(?= )")
    rows = rows.withColumn("__found", F.regexp_extract_all("__plain", pattern, F.lit(0)))
    n_base = F.coalesce(F.size("__found"), F.lit(0)).cast("bigint")
    rows = rows.withColumn("n_base", F.greatest(n_base, F.lit(0).cast("bigint")))
    some = F.col("n_base") > 0
    rows = rows.withColumn("__cut", F.when(some, F.split("__plain", pattern)))
    last = F.element_at("__cut", -1)
    there = F.array_distinct(F.transform("__found", F.lower))
    labels = F.array_compact(F.array(*[F.when(F.array_contains(there, f" {p}"), label) for p, label in phrases.items()]))
    facts = {
        "first_word": F.when(some, spaces(F.element_at("__cut", 1))),
        "last_word": F.when(some, F.col("n_words") - (spaces(last) - 1) - spaces(F.element_at("__found", -1))),
        "__base": F.when(some, labels).otherwise(F.array().cast("array<string>")),
    }
    return rows.withColumns(facts).drop("__plain", "__found", "__cut")


def facts_of(docs: DataFrame, sets: list[tuple[str, list[str]]], percent: int, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, __base, __key (digest of the text) and __held for every row; each text is read once.

    __held: of every block the distinct words that any template has, where these are as many as the template of
    the fewest words needs (the length filter that holds for all templates).
    """
    known, fewest = sorted({w for _, words in sets for w in words}), min((need(len(words), percent) for _, words in sets), default=1)
    rows = docs.select("doc_id", "text", F.transform(F.split(F.coalesce("text", F.lit("")), BLOCK_END), words_in).alias("__blocks"))
    n_words = F.aggregate("__blocks", F.lit(0).cast("bigint"), lambda n, b: n + F.size(b))
    starts = lambda b: F.sequence(F.lit(0), F.size(b) - window // 2 - 1, F.lit(window // 2))
    windows = F.flatten(F.transform("__blocks", lambda b: F.when(F.size(b) <= window, F.array(b)).otherwise(F.transform(starts(b), lambda at: F.slice(b, at + 1, window)))))
    held = F.transform(windows, lambda b: F.array_distinct(F.filter(b, lambda w: w.isin(known))))
    held = F.filter(held, lambda h: F.size(h) >= max(fewest, 1))
    rows = rows.select("doc_id", "text", n_words.alias("n_words"), F.md5("text").alias("__key"), held.alias("__held"))
    return with_phrases(rows).drop("text")


def need(size: int, percent: int) -> int:
    return math.ceil(percent * size / 100)


def words_of(template: str) -> list[str]:
    return sorted({w.lower() for w in re.split(BETWEEN, template) if w})


def constants(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """A frame of constant rows, made without Python workers."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def find_templates(facts: DataFrame, sets: list[tuple[str, list[str]]], percent: int) -> DataFrame:
    """digest, label, score: the largest containment of a template of that label in a block of the text, where it reaches `percent`."""
    spark, blocks = facts.sparkSession, facts.select(F.col("__key").alias("digest"), F.explode("__held").alias("words"))
    # How often every word of a template occurs in these blocks; at most one row a word reaches the driver.
    often = {r.word: r["count"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    order = sorted({w for _, words in sets for w in words}, key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    prefixes = []
    for number, (label, words) in enumerate(sets):
        own, least = sorted(words, key=rank.__getitem__), need(len(words), percent)
        for i, w in enumerate(own[: len(own) - least + 1] if own else [], 1):
            prefixes.append(F.struct(F.lit(w).alias("key"), F.lit(number).alias("template"), F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(least).alias("need"), F.array(*map(F.lit, own)).alias("own")))
    if not prefixes:
        return facts.select(F.col("__key").alias("digest"), F.lit("").alias("label"), F.lit(0.0).alias("score")).limit(0)
    met = blocks.select("digest", "words", F.explode("words").alias("key")).join(F.broadcast(constants(spark, prefixes)), "key")
    met = met.filter(F.size("words") >= F.col("need"))
    met = met.withColumn("held", F.array_intersect(F.array(*map(F.lit, order)), F.col("words")))
    left = F.least(F.size("own") - F.col("i"), F.size("held") - F.array_position("held", F.col("key")))
    met = met.filter(1 + left >= F.col("need"))
    met = met.withColumn("common", F.size(F.array_intersect("held", "own"))).filter(F.col("common") >= F.col("need"))
    return met.groupBy("digest", "label").agg(F.max(F.col("common") / F.size("own")).alias("score"))


def scan(docs: DataFrame, templates: Templates = TEMPLATES, percent: int = PERCENT, window: int = WINDOW, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text)."""
    folder, sets = shared_folder(docs.sparkSession), [(label, words_of(text)) for label, text in templates]
    facts = written(facts_of(docs, sets, percent, window), folder, "facts")
    found = find_templates(facts, sets, percent)
    found = found.groupBy("digest").agg(F.collect_set("label").alias("__own"), F.max("score").alias("__score"))
    found = written(found, folder, "licensed")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    rows = facts.drop("__held").join(found, F.col("__key") == F.col("digest"), "left")
    own = F.coalesce("__own", F.array().cast("array<string>"))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.round("__score", 6), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("__base")).alias("base_labels"), joined(F.concat("__base", own)).alias("labels"), score.alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan(table(spark, sf_dir, "documents"))


_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEXT = _WORDS.format(x=_LOWER.format(x="coalesce(text, '')"))
_KNOWN = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in words_of(text))}])" for k, (label, text) in enumerate(TEMPLATES))
#: Every block against every template, on the sets.
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_TEXT} AS ws FROM documents),
p AS (SELECT * FROM (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')) AS t(ph, label)),
o AS (SELECT r, label, i - 1 AS pos FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE list_contains(ws, 'cc') OR list_contains(ws, 'public') OR list_contains(ws, 'rights')), p WHERE ws[i : i + len(ph) - 1] = ph),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM o GROUP BY 1),
t AS (SELECT * FROM (VALUES {_KNOWN}) AS t(template, label, words)),
s AS (SELECT r, {_WORDS.format(x=_LOWER.format(x="block"))} AS ws FROM (SELECT r, unnest(string_split_regex(text, '[.!?;][\x20\x09-\x0D]+|\x0A[\x20\x09-\x0D]*\x0A')) AS block FROM d WHERE text IS NOT NULL)),
w AS (SELECT r, list_distinct(ws[pos + 1 : pos + {WINDOW}]) AS ws FROM (SELECT r, ws, unnest(CASE WHEN len(ws) <= {WINDOW} THEN [0] ELSE range(0, len(ws) - {WINDOW // 2}, {WINDOW // 2}) END) AS pos FROM s)),
f AS (SELECT r, label, len(list_intersect(ws, words)) AS common, len(words) AS size FROM w, t WHERE 100 * len(list_intersect(ws, words)) >= {PERCENT} * len(words)),
m AS (SELECT r, list(DISTINCT label) AS labels, max(common / size) AS score FROM f GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(score, 0), 6) END::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""
