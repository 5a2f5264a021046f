"""License scan, on DataFrame functions alone: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

Words are lower-cased runs of letters and digits; shingles are five words. Templates fall into classes by their number of
shingles (a power of two c at least as large); a class's windows have 2c shingles and begin every c/2, so that any stretch of
1.5c lies whole in one. A window and a template that it holds to ``percent`` have at least a known Jaccard similarity;
:func:`bands_for` picks bands so that one collides with at least the target probability. A candidate counts if the
window holds at least ``percent`` of the template's distinct shingles.

A window is looked at only if it holds a cue: a word from a set chosen so that without any of them fewer than ``percent`` of
the shingles of any template can occur. That rule follows from the templates and loses no match.

Edge cases: null and empty text have no match, nor have texts of fewer than five words. Rows with the same id count as one
document, a null id as one too. An empty table gives an empty table. Very long texts are cut into overlapping pieces of bounded size first.
Repeated and equal windows of a text count once a place. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.runtime import small_enough

#: Notices and passages of public licenses, by which a text is recognised.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-short": "Released under the BSD License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "public-domain": "This work has been released into the public domain by its author.",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

K = 5
#: Words of a piece into which long texts are cut.
PIECE = 4096
#: Band keys of a class that are asked for before windows leave their piece (more are found by the join alone), and rows of templates that are broadcast.
LITERAL_KEYS, TEMPLATE_ROWS = 1 << 12, 1 << 12


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(" ".join(words[i : i + K]) for i in range(len(words) - K + 1)))


def class_of(n: int) -> int:
    return max(4, 1 << math.ceil(math.log2(n)))


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def bands_for(similarity: float, target: float = 0.999, most: int = 64) -> tuple[int, int]:
    """(bands, rows) with the most rows a band for which pairs of at least ``similarity`` collide with probability ``target``."""
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - target) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = bands, rows
    return best or (math.ceil(math.log(1 - target) / math.log(1 - similarity)), 1)


def cues(templates: dict[str, str], percent: int) -> list[str]:
    """Words one of which any match holds: without them, fewer than ``percent`` of a template's shingles are left. The longest words that do."""
    chosen: set[str] = set()
    for text in templates.values():
        shingles = [s.split() for s in template_shingles(text)]
        open_ones = lambda: [s for s in shingles if not chosen & set(s)]
        while len(open_ones()) >= needed(len(shingles), percent):
            words = {w for s in open_ones() for w in s}
            chosen.add(max(words, key=lambda w: (w.startswith("licens"), len(w) > 5, sum(w in s for s in open_ones()), len(w), w)))
    return sorted(chosen)


def _least_hash(array, band, row: int):
    """One MinHash value of an array of hashes."""
    return F.array_min(F.transform(array, lambda h: F.xxhash64(h, band, F.lit(row))))


def _window_starts(width: int, step: int):
    """Starts of the windows of shingles [start, start + width) whose words, which reach K - 1 further, hold a cue."""

    def of(q):
        first = F.greatest(F.lit(0), F.ceil((q - width - K + 2) / F.lit(step)).cast("int"))
        return F.transform(F.sequence(first, F.floor(q / F.lit(step)).cast("int")), lambda s: s * step)

    return F.array_distinct(F.flatten(F.transform("cues", lambda q: of(q))))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """(doc_id, license_id, containment, n_windows): a row for each document and template found, the best containment and in how many windows."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    shingles = {name: template_shingles(text) for name, text in templates.items()}
    if short := [name for name, s in shingles.items() if not s]:
        raise ValueError(f"templates of fewer than {K} words: {short}")
    found_by = cues(templates, percent)
    classes: dict[int, list[str]] = {}
    for name, s in shingles.items():
        classes.setdefault(class_of(len(s)), []).append(name)
    bands = {}
    for c, names in classes.items():
        # a window of 2c shingles that holds what is needed of the smallest template
        least = min(needed(len(shingles[n]), percent) / (2 * c + len(shingles[n]) - needed(len(shingles[n]), percent)) for n in names)
        bands[c] = bands_for(least)

    def signature(array, c):
        """Band keys of an array of shingle hashes."""
        n, rows = bands[c]
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, *(_least_hash(array, b, r) for r in range(rows))))

    rows = [(c, name, s) for c, names in classes.items() for name in names for s in [shingles[name]]]
    table = spark.createDataFrame(rows, "c int, license_id string, s array<string>").withColumn("t", F.transform("s", lambda x: F.xxhash64(x))).drop("s")
    # the templates come from the driver's memory, and their hashes go back there
    index = {c: table.where(F.col("c") == c).withColumn("t_bands", signature(F.col("t"), c)).drop("c").collect() for c in classes}

    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    any_cue = F.lit(False)
    for w in found_by:
        any_cue = any_cue | F.contains(F.col("text"), F.lit(w))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(any_cue)
    words = F.split(F.trim(F.regexp_replace("text", "[^\\p{L}\\p{N}]+", " ")), " ")
    longest = 2 * max(classes) + K
    # the pieces are sliced off first, so that no row but the first carries the words of a whole text
    cut = lambda at: F.struct(at.alias("from"), F.slice("all", at + 1, F.lit(PIECE + longest)).alias("words"))
    pieces = slim.select("doc_id", words.alias("all")).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(PIECE)), cut)).alias("p"))
    pieces = pieces.select("doc_id", "p.from", "p.words").where(F.size("words") >= K)
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, K), " ")))
    cue_at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(found_by), i)), lambda i: i.isNotNull())
    pieces = pieces.withColumn("cues", cue_at).where(F.size("cues") > 0).withColumn("h", hashes).select("doc_id", "from", "h", "cues")

    def windows_of(c):
        """The windows of one class in a piece that collide with a template in a band (where so few keys are to be asked for)."""
        width, step = 2 * c, c // 2
        # starts are even in the whole text, as PIECE is a multiple of any step
        at = F.filter(_window_starts(width, step), lambda s: (s < F.size("h")) & (s < PIECE))
        made = F.transform(at, lambda s: F.struct(F.lit(c).alias("c"), s.alias("at"), F.slice("h", s + 1, F.lit(width)).alias("w")))
        keyed = F.transform(made, lambda x: F.struct(x.c.alias("c"), x.at.alias("at"), x.w.alias("w"), signature(x.w, c).alias("bands")))
        keys = sorted({k for row in index[c] for k in row["t_bands"]})
        return F.filter(keyed, lambda x: F.arrays_overlap(x.bands, F.array(*map(F.lit, keys)))) if len(keys) <= LITERAL_KEYS else keyed

    # all classes at once: texts are read, split and hashed a single time
    windows = pieces.select("doc_id", "from", F.explode(F.concat(*(windows_of(c) for c in classes))).alias("x"))
    by_band = spark.createDataFrame([(c, k, row["license_id"], row["t"]) for c in classes for row in index[c] for k in row["t_bands"]], "c int, band long, license_id string, t array<long>")
    hit = windows.select("doc_id", "from", "x.*").withColumn("band", F.explode(F.array_distinct("bands"))).join(small_enough(by_band, TEMPLATE_ROWS), ["c", "band"])
    held = F.size(F.array_intersect("w", "t"))
    hit = hit.withColumn("held", held).withColumn("m", F.size("t")).where(100 * F.col("held") >= percent * F.col("m"))
    out = hit.select("doc_id", "license_id", (F.col("from") + F.col("at")).alias("start"), (F.col("held") / F.col("m")).alias("containment"))
    # a window that collides with a template in several bands counts once
    return out.groupBy("doc_id", "license_id", "start").agg(F.max("containment").alias("containment")).groupBy("doc_id", "license_id").agg(F.round(F.max("containment"), 6).alias("containment"), F.count(F.lit(1)).alias("n_windows"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _values() -> str:
    rows = []
    for name, text in TEMPLATES.items():
        s = template_shingles(text)
        rows += [f"('{name}', {class_of(len(s))}, {len(s)}, '{x}')" for x in s]
    return ", ".join(rows)


OP9_SQL = rf"""
WITH t(license_id, c, m, g) AS (VALUES {_values()}),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, len(w) - 4 AS n, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT s.doc_id, s.n, s.pos, t.license_id, t.c, t.m, t.g FROM s JOIN t USING (g)),
v AS (SELECT *, unnest(generate_series(CASE WHEN pos < 2 * c THEN 0 ELSE (pos - 2 * c) // (c // 2) + 1 END, pos // (c // 2))) * (c // 2) AS start FROM h),
k AS (SELECT doc_id, license_id, start, count(DISTINCT g) AS held, any_value(m) AS m FROM v WHERE start >= 0 AND start <= pos AND pos < start + 2 * c GROUP BY doc_id, license_id, start)
SELECT doc_id, license_id, round(max(held / m), 6) AS containment, count(*) AS n_windows FROM k WHERE 100 * held >= 80 * m GROUP BY doc_id, license_id
"""
