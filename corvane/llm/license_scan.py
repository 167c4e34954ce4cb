"""License scans: MinHash bands over windows retrieve templates, exact containment verifies them.

A text is its words (runs of letters and digits, in lower case) and their 5-word
shingles. Overlapping windows of shingles lie over every text, at every ``STRIDE``-th
place, and over every template, at every place. A window's signature has ``BANDS``
MinHash values, each a band: its least shingle hash under a mask of that band. Windows
of similarity J meet in a band with a probability of about 1 - (1 - J) ** BANDS, 0.94
for J = 0.5, 0.998 for J = 0.8, and equal windows always meet. A template is retrieved
by the bands that it shares with a text.

The window is chosen so that a text with 0.8 of a template's shingles has a window
equal to one of the template's. A changed word takes away 5 shingles and an inserted
one 4, so a template of m shingles is broken up 0.2 m / 4 times at most, and a run of
at least 7 of its shingles is left if it has 8 or more. A run of WINDOW + STRIDE - 1
shingles holds a whole window of the text. Shorter templates are met by single
shingles, which are their own signatures.

A retrieved template counts if enough of its shingles stand close together in the
text (within twice its length). All of it is DataFrame operations. Bands of the
templates are worked off in blocks of at most ``KEYS_AT_ONCE``, so what is sent to the
executors is bounded; each further block is another pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SHINGLE, WINDOW, STRIDE = 5, 5, 3
#: Masks of the bands: they differ in their first bits, which decide most about what is least.
MASKS = (0x1B873593CC9E2D51, 0x5A308D313198A2E0, -0x4B9F5C2E1D73A86F, -0x165667B19E3779F9)
BANDS = len(MASKS)
#: Templates of so many shingles are met by windows, shorter ones by single shingles.
LEAST_WINDOWED = 8
LEAST_CONTAINMENT = 0.8
#: Bands of templates that are sent to the executors at once.
KEYS_AT_ONCE = 50_000

#: Notices of public licenses.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once: as a column, it could be written into each place that reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingled(text: Column) -> Column:
    """The hashes of all shingles of a text in order."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words = F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
    return _bound(words, lambda h: F.when(F.size(h) >= SHINGLE, each(h)).otherwise(F.array().cast("array<bigint>")))


def _band_keys(s: Column, stride: int) -> Column:
    """The band keys of all windows over shingles: for each band, the least masked hash of every window."""
    at = F.when(F.size(s) >= WINDOW, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - WINDOW + 1), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    least = lambda i, hashes: F.array_min(F.slice(hashes, i, F.lit(WINDOW)))
    return _bound(at, lambda at: F.concat(*[_bound(_masked(s, m), lambda hashes: F.transform(at, lambda i: least(i, hashes))) for m in MASKS]))


def _known_keys(s: Column, known: list[int]) -> Column:
    """The keys of a text, its shingles and its bands, that are among the templates' keys."""
    return F.filter(F.concat(s, _band_keys(s, STRIDE)), lambda key: key.isin(known))


def _masked(s: Column, mask: int) -> Column:
    return F.transform(s, lambda x: x.bitwiseXOR(F.lit(mask)))


def _templates(spark, notices) -> DataFrame:
    rows = spark.sql("select explode(array(" + ",".join(f"struct({i} as template, {_quoted(n)} as license, {_quoted(t)} as text)" for i, (n, t) in enumerate(notices)) + ")) as r").select("r.*")
    return rows.select("template", "license", _shingled(F.col("text")).alias("s")).where(F.size("s") > 0)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _blocks(templates: DataFrame) -> list[list[tuple[int, int]]]:
    """Blocks of at most ``KEYS_AT_ONCE`` (template, band key); a template may lie in several."""
    keys = F.when(F.size("s") >= LEAST_WINDOWED, _band_keys(F.col("s"), 1)).otherwise(F.col("s"))
    rows = templates.select("template", F.explode(keys).alias("key")).distinct().orderBy("template", "key").collect()
    return [[(r["template"], r["key"]) for r in rows[k : k + KEYS_AT_ONCE]] for k in range(0, len(rows), KEYS_AT_ONCE)]


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """One row per document and license found: ``id, license, containment, word_start``.

    ``containment`` is the largest share of a template's shingles that stand
    together, ``word_start`` the number of the first word of the first such place.
    Null and empty texts match nothing; repeated rows match each; an empty table
    gives an empty result; other columns are not read. Templates can be notices or
    whole license texts; those of fewer than five words are ignored. Templates of
    equal words match each on their own.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "licenses")
    templates = _templates(spark, notices)
    every = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shingles = templates.select("template", "license", F.array_distinct("s").alias("t"))
    best = None
    for k, block in enumerate(_blocks(templates)):
        known = sorted({key for _, key in block})
        found = _bound(_shingled(F.col("text")), lambda s: F.struct(s.alias("s"), _known_keys(s, known).alias("keys")))
        near = every.select("rid", "doc_id", found.alias("f")).where(F.size("f.keys") > 0)
        near = tmp.save(near.select("rid", "doc_id", "f.s", F.array_distinct("f.keys").alias("keys")), f"near{k}")
        pairs = spark.createDataFrame(block, "template int, key long")
        met = near.select("rid", F.explode("keys").alias("key")).join(F.broadcast(pairs), "key").select("rid", "template").distinct()
        met = tmp.save(met, f"met{k}")
        mine = shingles.join(F.broadcast(pairs.select("template").distinct()), "template", "left_semi")
        rows = near.join(met, "rid").join(F.broadcast(mine), "template")
        own = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda p: F.array_contains("t", F.get("s", p)))
        rows = rows.select("rid", "doc_id", "license", "s", "t", own.alias("own"))

        def together(p: Column, k: Column) -> Column:
            reach = 2 * F.size("t")
            close = F.filter(F.slice("own", k + 1, reach), lambda q: q < p + reach)
            return F.struct(F.size(F.array_distinct(F.transform(close, lambda q: F.get("s", q)))).alias("n"), (-p).alias("back"))

        one = rows.select("rid", "doc_id", "license", F.size("t").alias("m"), F.array_max(F.transform("own", together)).alias("b"))
        one = one.select("rid", "doc_id", "license", (F.col("b.n") / F.col("m")).alias("c"), F.col("b.back").alias("back")).where(F.col("c") >= least)
        best = one if best is None else best.unionByName(one)
    if best is None:
        return spark.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, license string, containment double, word_start int")
    best = best.groupBy("rid", "doc_id", "license").agg(F.max(F.struct("c", "back")).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), "license", F.col("b.c").alias("containment"), (-F.col("b.back")).alias("word_start"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses of every document by the notices; null and empty texts as in :func:`license_matches`."""
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = ",\n".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(NOTICES))
    words = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
    return f"""
WITH notices(template, license, text) AS (VALUES {rows}),
twords AS (SELECT template, license, {words} AS w FROM notices),
tsh AS (SELECT DISTINCT template, license, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM twords WHERE len(w) >= 5)),
tn AS (SELECT template, license, count(*) AS m FROM tsh GROUP BY ALL),
dwords AS (SELECT doc_id, {words} AS w FROM documents),
dsh AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM dwords WHERE len(w) >= 5)),
hits AS (SELECT doc_id, p, x, template, license, m FROM dsh JOIN tsh USING (x) JOIN tn USING (template, license)),
close AS (SELECT a.doc_id, a.license, a.template, a.p, a.m, count(DISTINCT b.x) AS n
          FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.template = b.template AND b.p >= a.p AND b.p < a.p + 2 * a.m GROUP BY ALL),
good AS (SELECT doc_id, license, n / m AS c, p FROM close WHERE n / m >= {LEAST_CONTAINMENT})
SELECT doc_id, license, max(c)::DOUBLE AS containment, arg_min(p, (-c, p))::INT AS word_start FROM good GROUP BY doc_id, license
"""


ORACLE = _oracle()
