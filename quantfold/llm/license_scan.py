"""License scan: MinHash bands over overlapping windows, then exact containment.

Native expressions only. Texts and templates are lower-cased word sequences
(``[a-z0-9]+``); a shingle is two consecutive words.

1. A window is ``WINDOW`` consecutive shingles, every ``WINDOW / 2``. Its
   band i is the minimum of ``hash ^ seed_i`` over the window, a MinHash of
   one row. Template windows start at every word.
2. A window that lies inside a template equals one of its windows and
   collides with certainty. A template of ``m`` shingles inside one window has
   Jaccard ``s = m / WINDOW`` at least, and a window and a template collide in
   some of ``b`` bands with probability ``1 - (1 - s)^b``. ``bands_for`` picks
   the least b that leaves ``miss`` for the shortest template.
3. A collision names template and place; the words around it are taken along
   and the share of the template's distinct shingles among them is counted
   exactly. ``threshold`` of them make a match.

The template windows are a lookup of bounded size (``MAX_KEYS``, checked).
Everything before the match is one narrow pass over the whole texts.

Edge cases: null, empty and one-word texts match nothing. Templates of less
than two words are refused. A text that holds a license twice gets one row.
Repeated rows give repeated results per doc_id merged into one; rows without
doc_id are reported under a null doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 8
MAX_KEYS = 200_000

#: Short public licence notices.
TEMPLATES = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at"),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def bands_for(shortest: int, miss: float = 1e-3) -> int:
    """Bands that miss a template of ``shortest`` shingles with probability ``miss`` at most."""
    s = min(1.0, shortest / WINDOW)
    return 1 if s == 1.0 else math.ceil(math.log(miss) / math.log(1.0 - s))


def words_of(text: Column) -> Column:
    """Lower-case words; an empty array for null or wordless text."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "^[^a-z0-9]+|[^a-z0-9]+$", "")
    return F.when(F.length(bare) > 0, F.split(bare, "[^a-z0-9]+")).otherwise(F.array().cast("array<string>"))


def _shingles(words: Column) -> Column:
    return F.when(F.size(words) >= 2, F.transform(
        F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))).otherwise(
            F.array().cast("array<long>"))


def _seed(band: int) -> int:
    x = (band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 31) - (1 << 63)


def template_keys(templates: DataFrame, bands: int) -> list[tuple[int, int, str, int]]:
    """(band, key, license_id, offset) of every window of every template."""
    rows = (templates.select("license_id", words_of(F.col("text")).alias("w"))
            .select("license_id", _shingles(F.col("w")).alias("g")).collect())
    out = []
    for r in rows:
        g = r["g"]
        if not g:
            raise ValueError(f"template {r['license_id']} has less than two words")
        for at in range(max(1, len(g) - WINDOW + 1)):
            for b in range(bands):
                out.append((b, min(x ^ _seed(b) for x in g[at:at + WINDOW]), r["license_id"], at))
        if len(out) > MAX_KEYS:
            raise ValueError(f"the templates have more than {MAX_KEYS} band keys")
    return out


def _collisions(bands: int, known: list[int]) -> Column:
    """(band, j, key) of the windows of ``g`` whose minimum in some band's order is a template's."""
    seeds = F.array(*[F.lit(_seed(b)) for b in range(bands)])
    windows = F.sequence(F.lit(0), F.expr(f"greatest(size(g) - 1, 0) DIV {WINDOW // 2}").cast("int"))
    turned = F.transform(seeds, lambda seed: F.transform("g", lambda x: x.bitwiseXOR(seed)))

    def of_band(values: Column, band: Column) -> Column:
        low = lambda j: F.array_min(F.slice(values, j * (WINDOW // 2) + 1, WINDOW))
        return F.transform(F.filter(windows, lambda j: low(j).isin(known)),
                           lambda j: F.struct(band.alias("band"), j.alias("j"), low(j).alias("key")))

    return F.flatten(F.transform(turned, of_band))


def scan(docs: DataFrame, templates: DataFrame, *, threshold: float = 0.8, miss: float = 1e-3) -> DataFrame:
    """(doc_id, license_id, containment, first_word): templates found in each text."""
    spark: SparkSession = docs.sparkSession
    shapes = (templates.select("license_id", words_of(F.col("text")).alias("tw"))
              .withColumn("tg", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("tw") - 2),
                                                            lambda i: F.concat_ws(" ", F.get("tw", i), F.get("tw", i + 1))))))
    size = shapes.agg(F.min(F.size("tw") - 1).alias("least"), F.max(F.size("tw")).alias("most")).first()
    if size["least"] is None:
        return docs.select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).limit(0)
    bands = bands_for(size["least"], miss)
    keys = template_keys(templates, bands)
    reach = size["most"]
    a = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    b = a.select("doc_id", "w", _shingles(F.col("w")).alias("g"))
    # explode_outer: no filter on the hits is derived and pushed below them, they are computed once
    hits = (b.select("doc_id", "w", F.explode_outer(_collisions(bands, sorted({k for _, k, _, _ in keys}))).alias("hit"))
            .filter("hit IS NOT NULL"))
    around = F.greatest(F.col("hit.j") * (WINDOW // 2) - reach, F.lit(0))
    hits = hits.select("doc_id", "hit.band", "hit.key", around.alias("from"),
                       F.slice("w", around + 1, 2 * reach + WINDOW).alias("near"))
    table = spark.createDataFrame([(n, k, t) for n, k, t, _ in keys], "band int, key long, license_id string").distinct()
    matched = (hits.join(F.broadcast(table), ["band", "key"])      # MAX_KEYS rows at most
               .dropDuplicates(["doc_id", "license_id", "from", "near"])
               .join(F.broadcast(shapes), "license_id"))
    there = F.transform(F.sequence(F.lit(0), F.size("near") - 2), lambda i: F.concat_ws(" ", F.get("near", i), F.get("near", i + 1)))
    share = F.size(F.array_intersect("tg", "there")) / F.size("tg")
    at = F.array_min(F.filter(F.transform("tg", lambda s: F.array_position("there", s)), lambda p: p > 0))
    return (matched.withColumn("there", there).withColumn("containment", share).filter(F.col("containment") >= threshold)
            .withColumn("first_word", (F.col("from") + at - 1).cast("int"))
            .groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word")))
