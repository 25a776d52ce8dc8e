"""License scans: MinHash bands over overlapping text windows, then exact containment.

Only DataFrame functions, and only narrow ones: a document never leaves its row.

A text becomes the hashes of its word trigrams. Windows of 10 words start at
every fourth word, so any 7 words in a row lie in one window. Two MinHashes of a
window are the least and the greatest of its hashes after an exclusive or with
a mask; masks and their complements begin with all patterns of four bits, so
they look for their extremes in different parts of the hash range. Each MinHash
is a band of one row: a window of 8 trigrams that shares 3 with a template, as
with the shortest one, misses all 16 bands of all its windows with a probability
of 0.00003, and a text that holds 4 of the 5 trigrams of a template, each in a
place of its own, with 0.0001 (found by trials over random hashes, at the worst
place of the windows); longer templates have several windows. The templates that a band of the
document retrieves are verified: a template is reported if at least
``containment`` of its distinct trigrams occur in the text.

Nulls and edge cases: words are runs of ASCII letters and digits, A-Z
lower-cased. Null texts and those of fewer than three words match nothing.
Repeated rows are reported each; other columns are ignored; a text of any
length is read whole. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, WINDOW, STEP = 3, 10, 4
MASKS = 8  #: each gives two bands
CONTAINMENT = 0.8

# Notices and permission texts of common licenses.
TEMPLATES = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice-2", "This project is licensed under the MIT License."),
    ("MIT", "permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "notice", "This library is licensed under the GNU Lesser General Public License."),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "notice-2", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
)


def masks() -> list[int]:
    """64-bit masks: the patterns of the four highest bits that begin with 0, mixed bits below."""
    return [0] + [(i << 60) | ((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 60) - 1)) for i in range(1, MASKS)]


def words_of(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hashes of all word trigrams, in order."""
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))


def turn(hashes: Column, mask: int) -> Column:
    return F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask))) if mask else hashes


def window_extremes(turned: Column) -> list[Column]:
    """The least and the greatest hash of each window, given all hashes after one mask."""
    starts = F.sequence(F.lit(1), F.size(turned), F.lit(STEP))
    none = F.array().cast("array<bigint>")
    found = (F.transform(starts, lambda i: pick(F.slice(turned, i, WINDOW - SHINGLE + 1))) for pick in (F.array_min, F.array_max))
    return [F.when(F.size(turned) > 0, f).otherwise(none) for f in found]


def once(df: DataFrame, name: str, value: Column, *others: str) -> DataFrame:
    """``df`` with a computed column that later steps read as it is.

    Lambdas evaluate the expressions in them for every element, so what they
    read must be a column. A generator of one row keeps the optimizer from
    putting the expression back in its place, or a filter below it.
    """
    return df.select(*others, F.explode(F.array(value)).alias(name))


def banded(texts: DataFrame, *others: str) -> DataFrame:
    """``others``, ``hashes`` and ``bands`` (two arrays for each mask) of rows with ``text``."""
    df = once(texts, "words", words_of(F.col("text")), *others)
    df = once(df, "hashes", shingles_of(F.col("words")), *others)
    turned = F.struct(*(turn(F.col("hashes"), m).alias(f"m{k}") for k, m in enumerate(masks())))
    df = once(df, "turned", turned, "hashes", *others)
    df = df.select("hashes", *others, *(F.col(f"turned.m{k}").alias(f"m{k}") for k in range(MASKS)))
    return once(df, "bands", F.array(*(b for k in range(MASKS) for b in window_extremes(F.col(f"m{k}")))), "hashes", *others)


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """license, template, shingles and bands of each template."""
    rows = spark.createDataFrame([(a, b, c) for a, b, c in templates], "license string, template string, text string")
    return banded(rows, "license", "template").select("license", "template", F.array_distinct("hashes").alias("shingles"), "bands")


def scan_licences(documents: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, template, n_matched, n_shingles, containment of each match (documents: doc_id, text)."""
    spark = documents.sparkSession
    # The templates are a list of fixed length: a literal of the plan.
    known = [r for r in template_table(spark, templates).collect() if r["shingles"]]
    bigint = "array<bigint>"
    literal = F.array(
        *(
            F.struct(
                F.lit(r["license"]).alias("license"),
                F.lit(r["template"]).alias("template"),
                F.array(*map(F.lit, r["shingles"])).cast(bigint).alias("shingles"),
                F.array(*(F.array(*map(F.lit, b)).cast(bigint) for b in r["bands"])).alias("bands"),
            )
            for r in known
        )
    )
    every = [F.array(*(F.lit(v) for v in sorted({v for r in known for v in r["bands"][k]}))).cast(bigint) for k in range(2 * MASKS)]
    rows = banded(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    meets = reduce(lambda a, b: a | b, (F.arrays_overlap(F.col("bands")[k], every[k]) for k in range(2 * MASKS)))
    retrieved = F.filter(literal, lambda t: reduce(lambda a, b: a | b, (F.arrays_overlap(F.col("bands")[k], t["bands"][k]) for k in range(2 * MASKS))))
    found = rows.where(meets).select("doc_id", F.array_distinct("hashes").alias("hashes"), F.explode(retrieved).alias("t"))
    shared = F.size(F.array_intersect("t.shingles", "hashes")).cast("long")
    total = F.size("t.shingles").cast("long")
    out = found.select("doc_id", "t.license", "t.template", shared.alias("n_matched"), total.alias("n_shingles"))
    return out.withColumn("containment", F.col("n_matched") / F.col("n_shingles")).where(F.col("containment") >= containment)


def oracle_sql(templates=TEMPLATES, containment: float = CONTAINMENT) -> str:
    """Exact containment of every template in every document, without windows or bands."""
    quoted = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in templates)
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))"
    return f"""
WITH templates(license, template, text) AS (VALUES {quoted}),
t AS (SELECT license, template, unnest({grams}) AS s, len({grams}) AS n FROM (SELECT license, template, {words} AS ws FROM templates) WHERE len(ws) >= 3),
d AS (SELECT row, doc_id, unnest({grams}) AS s FROM (SELECT row_number() OVER () AS row, doc_id, {words} AS ws FROM documents) WHERE len(ws) >= 3)
SELECT doc_id, license, template, count(*) AS n_matched, CAST(n AS BIGINT) AS n_shingles, count(*) / n AS containment
FROM d JOIN t USING (s) GROUP BY row, doc_id, license, template, n HAVING count(*) / n >= {containment}
"""
