"""License scans as DataFrame operations only.

Texts are lower-cased (A-Z) and cut into words ``[a-z0-9]+``. For each template length class, overlapping windows of one and
a half template lengths slide by a quarter, so a passage of up to a quarter more words than the template lies whole in a
window. Windows and templates are sets of word shingles (five words; a shorter template is one shingle). Each of BANDS
MinHash bands of one row retrieves the templates that share the band's minimum: a window that holds three quarters of a
template has a Jaccard similarity of at least 1/4 with it, so the chance that no band meets is at most (3/4) ** BANDS, 1e-6.
Retrieved pairs are then checked exactly: a match has at least CONTAINED of the template's shingles in one window.

Windows are built only where an anchor word of some template of the class stands. Anchors are chosen so that more than a
quarter of the template's shingles cannot do without them, hence a window without any holds no match: nothing is dropped.

The result has one row per document row and template found: containment is the best over windows, first_word the place
of the first best window's first word. Null and empty texts give no row; ties take the smaller place; repeated rows repeat.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.base import let

SHINGLE, CONTAINED, BANDS = 5, 0.75, 48

# Public notices and grants by which licenses are applied.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
    " compliance with the License. You may obtain a copy of the License at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the"
    " GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
    " option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles_of(words: list[str], n: int) -> list[str]:
    return sorted({" ".join(words[i:i + n]) for i in range(len(words) - n + 1)})


def anchors_of(shingles: list[str]) -> list[str]:
    """Few words, long ones first since they are rare, without which fewer than CONTAINED of the shingles are left."""
    left, chosen = list(shingles), []
    while len(left) >= CONTAINED * len(shingles):
        counts: dict[str, int] = {}
        for s in left:
            for w in set(s.split()):
                counts[w] = counts.get(w, 0) + 1
        word = max(counts, key=lambda w: (min(len(w), 8), counts[w], w))
        chosen.append(word)
        left = [s for s in left if word not in s.split()]
    return chosen


def catalogue(templates: dict[str, str]) -> list[dict]:
    """name, size of shingles (n), shingles, window and stride of each template; names with equal geometry share windows."""
    out = []
    for name, text in sorted(templates.items()):
        words = words_of(text)
        n = min(SHINGLE, len(words))
        found = shingles_of(words, n)
        out.append({"name": name, "n": n, "shingles": found, "anchors": anchors_of(found),
                    "window": math.ceil(1.5 * len(words)), "stride": max(1, len(words) // 4)})
    return out


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bands(shingles: Column) -> Column:
    return let(shingles, lambda own: F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.array_min(F.transform(own, lambda s: F.xxhash64(s, k)))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document row and template: doc_id, license, containment, first_word."""
    spark, kinds = docs.sparkSession, catalogue(templates or TEMPLATES)
    every = sorted({a for k in kinds for a in k["anchors"]})
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(f"(?i)(?:{'|'.join(every)})")).select(
        "doc_id", F.regexp_extract_all(_lower(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0)).alias("w")).withColumn(
        "row", F.struct("doc_id", F.xxhash64("w").alias("h")))
    shapes = sorted({(k["n"], k["window"], k["stride"]) for k in kinds})
    anchors = {shape: sorted({a for k in kinds if (k["n"], k["window"], k["stride"]) == shape for a in k["anchors"]}) for shape in shapes}
    each = F.array(*[F.struct(F.lit(no).alias("shape"), F.lit(n).alias("n"), F.lit(window).alias("window"), F.lit(stride).alias("stride"),
                              F.array(*map(F.lit, anchors[n, window, stride])).alias("anchors"))
                     for no, (n, window, stride) in enumerate(shapes)])
    seen = rows.select("row", "w", F.inline(each)).where(F.arrays_overlap("w", "anchors") & (F.size("w") >= F.col("n"))).select(
        "row", "w", "shape", "n", "window", "anchors",
        F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"), F.col("stride"))).alias("first_word")).select(
        "row", "first_word", "shape", "n", "anchors", F.slice("w", F.col("first_word") + 1, F.col("window")).alias("x")).where(
        F.arrays_overlap("x", "anchors")).select("row", "first_word", "shape", F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size("x") - F.col("n") + 1), lambda i: F.array_join(F.slice("x", i, F.col("n")), " "))).alias("own"))
    known = spark.createDataFrame(
        [(k["name"], shapes.index((k["n"], k["window"], k["stride"])), k["shingles"]) for k in kinds],
        "license string, shape int, shingles array<string>")
    keyed = known.select("license", "shape", "shingles", F.posexplode(_bands(F.col("shingles"))).alias("band", "value"))
    # the templates are the fixed list above or a caller's few: rows of the parameter, not of the corpus
    met = seen.select("*", F.posexplode(_bands(F.col("own"))).alias("band", "value")).join(
        F.broadcast(keyed), ["shape", "band", "value"])
    scored = met.select("row", "license", "first_word", (F.size(F.array_intersect("own", "shingles")) / F.size("shingles")).alias("containment"))
    best = scored.where(F.col("containment") >= CONTAINED).groupBy("row", "license").agg(
        F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("best"))
    copies = rows.groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")
    out = best.join(copies, "row", "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
    return out.select("row.doc_id", "license", F.col("best.containment").alias("containment"),
                      (-F.col("best.back")).cast("long").alias("first_word"))


def sql(templates: dict[str, str] | None = None) -> str:
    """The same by exact containment of every window, without bands."""
    kinds = catalogue(templates or TEMPLATES)
    values = ", ".join("('{}', {}, {}, {}, [{}])".format(k["name"], k["n"], k["window"], k["stride"], ", ".join(f"'{s}'" for s in k["shingles"]))
                       for k in kinds)
    anchors = "|".join(sorted({a for k in kinds for a in k["anchors"]}))
    return f"""
WITH known(license, n, win, stride, shingles) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents WHERE regexp_matches(text, '(?i)({anchors})')),
wins AS (SELECT r, doc_id, license, n, shingles, f AS first_word, w[f + 1 : f + win] AS x
         FROM docs, known, unnest(generate_series(0, len(w) - n, stride)) AS u(f)),
sets AS (SELECT *, list_distinct(list_transform(generate_series(1, len(x) - n + 1), lambda i: array_to_string(x[i : i + n - 1], ' '))) AS own
         FROM wins),
scored AS (SELECT r, doc_id, license, first_word, len(list_intersect(own, shingles)) / len(shingles) AS containment FROM sets)
SELECT doc_id, license, max(containment) AS containment, arg_min(first_word, (-containment, first_word)) AS first_word
FROM scored WHERE containment >= {CONTAINED} GROUP BY r, doc_id, license
"""
