"""Licence scan: an exact set-similarity join of text blocks with licence templates, on built-in functions only.

A block is a line of a document and the words that follow it, as many as the longest template has, so that a notice is found however its
lines are wrapped; lines without words don't count, and tokens are the words of op6's contract. A block meets a
template when it holds at least ``threshold`` of the template's distinct tokens. Tokens outside the
templates cannot change an overlap, so a block is reduced to the template tokens it holds, put in
global frequency order (rarest first, counted over all documents of the corpus). Prefix filter: a
block that meets a template of n tokens with overlap a holds one of the template's n - a + 1 rarest
tokens. Length filter: it holds a template tokens at least. Positional filter: from the first common
token on, the rest of either side must still allow a. What passes is verified by set intersection. A document
without any prefix token has no such block, and its lines aren't looked at.

Nulls count as empty texts; a text of any length is read whole. Empty texts have no words and no labels. Identical rows get identical
results. Only the named columns are read, so extra columns, whatever they are called, do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Templates of common licence notices, with their labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("reserved", "copyright all rights reserved"),
)
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WITHIN_LINES = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _squeezed(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(text, SEPARATORS, " "))


def _needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(n * threshold - 1e-9))


def _held(words: Column, order: list[str]) -> Column:
    """The tokens that the words (with one space between them) hold, in the given order."""
    return F.array_intersect(F.array(*[F.lit(t) for t in order]), F.split(F.translate(words, UPPER, LOWER), " "))


def _blocks(docs: DataFrame, order: list[str], rare: list[str], further: int) -> DataFrame:
    """A row for each line and the ``further`` words behind it that hold template tokens, of documents that hold a rare one: its key and those tokens, in the given order."""
    some = docs.where(F.col("text").rlike("(?i)" + "|".join(rare)))

    def blocks(lines: Column) -> Column:
        # A line with words has one at least, so what follows lies in as many lines, and in their first words.
        return F.element_at(F.transform(F.array(F.transform(lines, lambda line: F.substring_index(line, " ", further))), lambda heads: F.transform(lines, lambda line, k: F.concat_ws(" ", line, F.substring_index(F.array_join(F.slice(heads, k + 2, further), " "), " ", further)))), 1)

    lines = F.filter(F.transform(F.split(F.regexp_replace("text", WITHIN_LINES, " "), "\n"), lambda line: F.trim(line)), lambda line: line != "")
    # The lines are bound by a lambda and the blocks made within the row.
    every = F.element_at(F.transform(F.array(lines), blocks), 1)
    runs = some.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(every).alias("run"))
    return runs.where(F.col("run").rlike("(?i)" + "|".join(rare))).select("doc_id", "text_key", _held(F.col("run"), order).alias("held")).where(F.size("held") > 0)


def frequency_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' tokens, rarest first by documents of the corpus that hold them. As many rows as the templates have tokens reach the driver."""
    vocabulary = sorted({t for _, text in templates for t in text.split()})
    counted = docs.select(F.explode(_held(_squeezed(F.col("text")), vocabulary)).alias("token")).groupBy("token").count()
    count = {r.token: r["count"] for r in counted.collect()}
    return sorted(vocabulary, key=lambda t: (count.get(t, 0), t))


def longest(templates) -> int:
    return max(len(text.split()) for _, text in templates)


def template_join(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, label, containment: one row for each label that a block of the document meets."""
    order = frequency_order(docs, templates)
    rank = {t: k for k, t in enumerate(order)}
    rows, least = [], 10**9
    for n, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=rank.get)
        need = _needed(len(tokens), threshold)
        least = min(least, need)
        rows += [(n, label, tokens, len(tokens), need, t, j) for j, t in enumerate(tokens[: len(tokens) - need + 1])]
    spark = docs.sparkSession
    prefixes = spark.createDataFrame(rows, "template int, label string, tokens array<string>, n int, need int, token string, at int")
    first = sorted({r[5] for r in rows})
    blocks = _blocks(docs, order, first, longest(templates)).where((F.size("held") >= least) & F.arrays_overlap("held", F.array(*[F.lit(t) for t in first])))
    # A block's own prefix: any later token leaves fewer than the least overlap.
    entries = blocks.select("*", F.posexplode(F.slice("held", 1, F.size("held") - least + 1)).alias("place", "token"))
    pairs = entries.join(F.broadcast(prefixes), "token").where(
        (F.size("held") >= F.col("need")) & (F.least(F.size("held") - F.col("place"), F.col("n") - F.col("at")) >= F.col("need"))
    )
    overlap = F.size(F.array_intersect("held", "tokens"))
    met = pairs.select("doc_id", "text_key", "label", (overlap / F.col("n")).alias("containment"), overlap.alias("overlap"), "need").where("overlap >= need")
    return met.groupBy("doc_id", "text_key", "label").agg(F.max("containment").alias("containment"))


def phrase_places(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """doc_id, text_key, n_words, n_base, first_word, last_word, base: the places where phrases stand."""
    any_phrase = "(?i) (?:" + "|".join(p for p, _ in phrases) + ") "
    df = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.concat(F.lit(" "), _squeezed(F.col("text")), F.lit(" ")).alias("padded"))
    df = df.withColumn("found", F.when(F.col("padded").rlike(any_phrase), F.translate("padded", UPPER, LOWER)).otherwise(F.lit("")))
    n_words = F.when(F.octet_length("padded") <= 2, F.lit(0)).otherwise(_spaces(F.col("padded")) - 1).cast("long")
    number, first, last, labels = [], [], [], []
    for phrase, label in phrases:
        count = F.regexp_count("found", F.lit(f"(?<= ){phrase}(?= )"))
        here = count > 0
        number.append(count)
        first.append(F.when(here, _spaces(F.regexp_extract("found", f"(?s)^(.*?) {phrase} ", 1))))
        last.append(F.when(here, _spaces(F.regexp_extract("found", f"(?s)^(.*) {phrase} ", 1))))
        labels.append(F.when(here, F.lit(label)))
    return df.select(
        "doc_id", "text_key", n_words.alias("n_words"), sum(number[1:], number[0]).cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"),
    )


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=PHRASES) -> DataFrame:
    """Per document: word and phrase counts, base_labels, labels, and score, the largest containment met (1 where a phrase stands)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    met = template_join(docs, templates, threshold).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("met"), F.max("containment").alias("most"))
    base, met = phrase_places(docs, phrases).alias("b"), met.alias("m")
    both = base.join(met, F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_key") == F.col("m.text_key")), "left")
    empty = F.array().cast("array<string>")
    return both.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("met", empty))), ",").alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same by comparing every line and what follows with every template."""
    words = "list_filter(regexp_split_to_array(translate({0}, '" + UPPER + "', '" + LOWER + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    place = lambda p: "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")"
    rows = ", ".join(f"('{label}', {sorted(set(text.split()))}, {_needed(len(set(text.split())), THRESHOLD)})" for label, text in TEMPLATES)
    at = ", ".join(f"{place(p)} AS p{k}" for k, (p, _) in enumerate(PHRASES))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    names = "[" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t(label, tokens, need) AS (VALUES {rows}),
f AS (SELECT doc_id, k, {words.format("line")} AS w FROM (SELECT doc_id, unnest(f) AS line, generate_subscripts(f, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS f FROM d))),
l AS (SELECT doc_id, g.w[f.past + 1 - len(f.w):f.past + {longest(TEMPLATES)}] AS w FROM (SELECT f.*, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS past FROM f) f JOIN (SELECT doc_id, {words.format("text")} AS w FROM d) g USING (doc_id) WHERE len(f.w) > 0),
m AS (SELECT doc_id, list(DISTINCT label) AS met, max(len(list_intersect(w, tokens))::DOUBLE / len(tokens)) AS most
      FROM l JOIN t ON len(list_intersect(w, tokens)) >= need GROUP BY doc_id),
b AS (SELECT doc_id, w, {at} FROM (SELECT doc_id, {words.format("text")} AS w FROM d)),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, {every} AS places, list_filter({names}, lambda x: x IS NOT NULL) AS base FROM b)
SELECT c.doc_id, n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(met, []))), ',') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0::DOUBLE) END AS score
FROM c LEFT JOIN m USING (doc_id)"""
