"""License scans (operator 10), in DataFrame functions only.

A text is cut into words (runs of characters other than ASCII marks and blanks, lower case) and 5-word shingles. For a
template of n shingles the windows are 2n shingles long and start at every n-th, so each occurrence lies whole within
one. Windows and templates meet by MinHash, `BANDS` bands of one hash each: at full containment the Jaccard similarity
is 1/2 or more and a window is missed with probability 2**-BANDS, at the least containment of 80 % it is 0.36 or more
and the probability is under 1e-6. A window that meets a template is verified by exact containment of its shingles.

A band can only agree where the window holds the shingle that gives the template's minimum. Those few shingles are known
beforehand, so texts and windows without any of them are passed over before signatures are computed; no meeting is lost.

Cases: null, empty and short texts have no shingle and no row; equal rows give equal rows only once a doc_id (results
are by doc_id and template; a null id is an id); extra columns are ignored; very long texts are scanned
whole, their windows being rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = 32
N_GRAM = 5
LEAST_PER_CENT = 80

# ASCII marks and blanks, which part words.
MARKS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

# The notices looked for, in their usual words.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT notice": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
}


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once: an array of one, exploded. The optimizer neither copies the
    expression into filters and lambdas above nor moves it, as it does with a plain alias."""
    return rows.withColumn(name, F.explode(F.array(value)))


def shingled(rows: DataFrame, text: str) -> DataFrame:
    """rows with `h`: hashes of all 5-word shingles of the text in their order; empty where there are fewer words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), MARKS), "")
    w, at = F.col("__words"), F.sequence(F.lit(1), F.size("__words") - (N_GRAM - 1))
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(N_GRAM)]))
    cut = once(rows, "__words", words)
    return once(cut, "h", F.when(F.size(w) >= N_GRAM, hashed).otherwise(F.array().cast("array<bigint>"))).drop("__words")


def minimum(hashes: Column, band: int) -> Column:
    """The least hash of a set of shingles under one of the hash functions."""
    return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(band))))


def template_table(docs: DataFrame, templates: dict[str, str]) -> list:
    """template, shingles (distinct), telling (those that give a minimum in some band): a row a template, on the driver."""
    spark = docs.sparkSession
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])).alias("t"))
    rows = shingled(rows.select("t.template", "t.text"), "text").select("template", F.array_distinct("h").alias("shingles")).filter(F.size("shingles") > 0)
    telling = F.array_distinct(F.array(*[F.expr(f"min_by(s, xxhash64(s, {b}))") for b in range(BANDS)]))
    spread = rows.select("template", F.explode("shingles").alias("s")).groupBy("template").agg(telling.alias("telling"))
    return rows.join(spread, "template").orderBy("template").collect()


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least_per_cent: int = LEAST_PER_CENT) -> DataFrame:
    """doc_id, template, windows (that hold it), containment (the largest) and first_word (of the first such window)."""
    known = template_table(docs, templates)
    longs = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    telling = sorted({x for r in known for x in r["telling"]})
    hashed = shingled(docs.select("doc_id", "text"), "text").select("doc_id", "h").filter(F.arrays_overlap("h", longs(telling)))
    # Windows by template: of the texts left, and of those only the windows with a telling shingle.
    per_template = F.array(*[F.struct(F.lit(r["template"]).alias("template"), longs(r["shingles"]).alias("shingles"), longs(r["telling"]).alias("telling"), F.lit(len(r["shingles"])).alias("n")) for r in known])
    wanted = hashed.select("doc_id", "h", F.explode(F.filter(per_template, lambda t: F.arrays_overlap(F.col("h"), t["telling"]))).alias("t"))
    starts = F.sequence(F.lit(0), F.size("h") - 1, F.col("t.n"))
    windows = wanted.select("doc_id", "t", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("h", s + 1, F.col("t.n") * 2).alias("own")))).alias("w"))
    windows = windows.select("doc_id", "t", "w.start", "w.own").filter(F.arrays_overlap("own", F.col("t.telling")))
    # The bands: the window meets the template if any of the minima agree.
    agree = [minimum(F.col("own"), b) == minimum(F.col("t.shingles"), b) for b in range(BANDS)]
    meet = agree[0]
    for a in agree[1:]:
        meet = meet | a
    held = F.size(F.array_intersect("own", F.col("t.shingles")))
    found = windows.filter(meet).select("doc_id", F.col("t.template").alias("template"), "start", F.col("t.n").alias("n"), held.alias("held")).filter(F.col("held") * 100 >= F.col("n") * least_per_cent)
    return found.distinct().groupBy("doc_id", "template").agg(F.count(F.lit(1)).alias("windows"), (F.max("held") / F.max("n")).alias("containment"), F.min("start").cast("long").alias("first_word"))


def _oracle() -> str:
    quoted = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    cut = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{MARKS}'), lambda x: x <> '')"
    made = "SELECT {0}, unnest(range(len(w) - 4)) AS pos, w FROM {1} WHERE len(w) >= 5"
    five = " || ' ' || ".join(f"w[pos + {k}]" for k in range(1, 6))
    return f"""
WITH t AS (SELECT * FROM (VALUES {quoted}) AS v(template, text)),
tw AS (SELECT template, {cut} AS w FROM t),
ts AS (SELECT DISTINCT template, {five} AS s FROM ({made.format('template', 'tw')})),
tn AS (SELECT template, s, count(*) OVER (PARTITION BY template) AS n FROM ts),
dw AS (SELECT doc_id, {cut} AS w FROM documents),
ds AS (SELECT doc_id, pos, {five} AS s FROM ({made.format('doc_id', 'dw')})),
hit AS (SELECT DISTINCT doc_id, template, pos, s, n FROM ds JOIN tn USING (s)),
win AS (SELECT doc_id, template, s, n, (pos // n) * n AS start FROM hit UNION ALL
        SELECT doc_id, template, s, n, (pos // n) * n - n AS start FROM hit WHERE pos >= n),
held AS (SELECT doc_id, template, start, n, count(DISTINCT s) AS held FROM win GROUP BY ALL HAVING 100 * count(DISTINCT s) >= {LEAST_PER_CENT} * n)
SELECT doc_id, template, count(*) AS windows, max(held)::DOUBLE / max(n) AS containment, min(start)::BIGINT AS first_word
FROM held GROUP BY doc_id, template
"""


ORACLE = _oracle()
