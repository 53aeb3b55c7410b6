"""License notices: fixed phrases, and templates by an exact set-similarity join.

A template is named when ``SPREAD`` times its number of words, taken in a row anywhere in the text, hold
at least ``threshold`` of its distinct words; line breaks do not count. First texts and templates are
compared as sets of words: a text keeps only template words, ordered by how many texts hold them,
rarest first. To reach the needed overlap, one of a template's first ``size - needed + 1`` words must
be in the text: those prefixes are joined by word. Texts with fewer template words than needed (length
filter) and pairs whose words after the first common one cannot suffice (positional filter) are
dropped. The rest are verified at each place of a template's word, with the words that follow it.

The templates are a parameter, so the ordered word list that the driver holds is bounded by them.
Prefix words are rare by choice; an equi-join on them carries only lines that may match.

Defined results: null and empty texts have no words, null positions, empty labels and score 0.
Repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import literal_rows, saved

# Fixed values of the contract: phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Opening or whole notices of common licenses, and their labels.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-release", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
THRESHOLD = 0.9
SPREAD = 2

_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # code points outside words, before lower-casing
_WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"  # the others; ranges match far faster than a negated set
WORDS = f"[{_WORD}]+"


def _pattern(*phrases: str) -> str:
    places = "|".join(f"[{_GAP}]+".join(p.split(" ")) for p in phrases)
    return f"(?i)(?<![{_WORD}])(?:{places})(?![{_WORD}])"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+", text.lower())))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the largest share of a template found in one place, 0 below ``threshold``)."""
    spark = docs.sparkSession
    sets = [(label, _template_words(t)) for label, t in templates]
    spans = {label: SPREAD * len(re.findall(r"[0-9a-z]+", t.lower())) for label, t in templates}
    vocabulary = sorted({w for _, words in sets for w in words})
    phrase = _pattern(*[p for p, _ in PHRASES])
    # A plain search for the last words spares most texts the patterns.
    hint = F.contains("low", F.lit("license")) | F.contains("low", F.lit("cc"))
    counts = [F.when(hint, _count(F.col("t"), _pattern(p))).otherwise(F.lit(0).cast("long")) for p, _ in PHRASES]
    # Two letters beyond ASCII have ASCII lower cases; they are replaced, as their words match no template.
    plain = F.lower(F.replace(F.replace(F.col("t"), F.lit("İ"), F.lit("ı")), F.lit("K"), F.lit("ǩ")))
    known = F.array(*[F.lit(w) for w in vocabulary])
    enough = [F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), F.col("words"))) >= math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    all_words = F.split("low", f"[{_GAP}]+")
    places = F.filter(F.transform(all_words, lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: F.array_contains(known, x["w"]))
    scanned = saved(
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
        .withColumn("low", plain)
        .withColumn("words", F.array_intersect(known, all_words))
        .select(
            F.monotonically_increasing_id().alias("row"), "doc_id",
            _count(F.col("t"), WORDS).alias("n_words"),
            F.array(*counts).alias("found"),
            F.when(hint & F.col("t").rlike(phrase), _count(F.regexp_extract(F.col("t"), f"(?s)^(.*?){phrase}", 1), WORDS)).alias("first_word"),
            F.when(hint & F.col("t").rlike(phrase), _count(F.regexp_extract(F.col("t"), f"(?s)^(.*){phrase}", 1), WORDS)).alias("last_word"),
            "words",
            F.when(F.greatest(*enough, F.lit(False)), places).alias("places"),
        )
    )
    texts = scanned.select("row", "words").where(F.size("words") > 0)
    # Template words by the number of texts that hold them: at most one row per word of the templates.
    held = {r["w"]: r["n"] for r in texts.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, words in sets:
        ranked = sorted(words, key=place.__getitem__)
        needed = math.ceil(threshold * len(ranked) - 1e-9)
        prefixes += [(w, label, i, len(ranked), needed, ranked) for i, w in enumerate(ranked[: len(ranked) - needed + 1])]
    index = literal_rows(spark, ["w", "label", "i", "size", "needed", "template", "span"], [(*p[:5], list(p[5]), spans[p[1]]) for p in prefixes])
    ordered = texts.withColumn("words", F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words")))
    candidates = (
        ordered.select("row", "words", F.posexplode("words").alias("j", "w"))
        .join(index, "w")
        .where(F.size("words") >= F.col("needed"))  # length
        .where(F.least(F.col("size") - F.col("i"), F.size("words") - F.col("j")) >= F.col("needed"))  # position
    )
    pairs = candidates.where(F.size(F.array_intersect("template", "words")) >= F.col("needed")).select("row", "label", "template", "size", "span").distinct()
    words = scanned.select("row", "places").join(pairs, "row").select("row", "label", "template", "size", "span", F.inline("places"))
    # Places over the span: the words less than one span after a place are those of its range.
    reach = 1 - 0.5 / max(spans.values(), default=1)
    near = F.expr(f"collect_set(w) OVER (PARTITION BY row, label ORDER BY x RANGE BETWEEN CURRENT ROW AND {reach!r}D FOLLOWING)")
    share = F.size(near) / F.col("size")
    found = words.where(F.array_contains("template", F.col("w"))).withColumn("x", F.col("at") / F.col("span"))
    matched = found.select("row", "label", share.alias("share")).where(F.col("share") >= threshold - 1e-12)
    named = matched.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("score"))
    base = F.array_compact(F.array(*[F.when(F.col("found")[i] > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    out = scanned.drop("words", "places").join(named, "row", "left").withColumn("base", F.array_sort(base))
    return out.select(
        "doc_id", "n_words",
        F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_base"),
        "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _phrase_sql(phrase: str, label: str) -> str:
    words = phrase.split(" ")
    at = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"SELECT r, i - 1 AS i, '{label}' AS label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) WHERE {at}"


_WORDS_SQL = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
LICENSE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '{_WORDS_SQL}') AS ws FROM d),
b AS ({" UNION ALL ".join(_phrase_sql(p, label) for p, label in PHRASES)}),
n AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM b GROUP BY r),
t AS (SELECT unnest({[{"label": label, "ws": _template_words(x)} for label, x in TEMPLATES]!r}, recursive := true)),
l AS (SELECT r, regexp_extract_all(unnest(string_split(t, chr(10))), '{_WORDS_SQL}') AS ws FROM d),
m AS (SELECT r, list_distinct(list(label)) AS more, max(score) AS score FROM (
      SELECT r, label, len(list_intersect(t.ws, l.ws)) / len(t.ws) AS score FROM l, t) WHERE score >= {THRESHOLD} - 1e-12 GROUP BY r)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n.n_base, 0)::BIGINT AS n_base, n.first_word::BIGINT AS first_word, n.last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(n.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(n.labels, []), coalesce(m.more, [])))), ',') AS labels,
       coalesce(m.score, 0)::DOUBLE AS score
FROM w LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
