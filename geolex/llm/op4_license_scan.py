"""License scan: MinHash bands over overlapping windows retrieve license templates,
exact shingle containment verifies them.  DataFrame functions only.

Texts are lower-cased words (runs of letters and digits) in shingles of five.  A
window is a few consecutive shingles, and windows overlap so that any stretch as
long as a template piece lies wholly in one.  Two window lengths are used:

  length  stride  pieces of     an intact piece's share of its window
  2       1       1-2 shingles  at least 1/2
  6       3       3-4 shingles  at least 1/2

Longer templates are cut into pieces of 3-4 shingles (of five: 2 and 3).  There are
``BANDS`` = 10 bands of one row each.  A band orders the 64-bit shingle hashes by
their exclusive-or with its mask, which is a permutation; the masks are evenly
spaced, so that the bands' minima spread over a window better than random ones
would: an intact piece (similarity 1/2 and more) shares a band with its window
with probability over 0.9995 (random permutations: 1 - (1/2)^10 = 0.9990), and any
one piece retrieves its template.
A retrieved (document, license) is then verified on the whole text: the share of
the template's distinct shingles that the document has must be ``CONTAINED`` (0.8)
or more.

The windows are walked inside each row, and retrieved rows are written and verified where they
stand: no text is shuffled.  Templates (a parameter) are the only broadcast.

Rules: null text counts as empty; texts under five words match nothing; templates
must have five words.  Repeated occurrences count once.  A repeated row is
reported as often as it stands in the table; a null id is reported as null.  Only
``doc_id`` and ``text`` are read, extra columns of any name play no part.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.llm.common import cut, named, table

SHINGLE, BANDS, CONTAINED = 5, 10, 0.8
#: Evenly spaced over 64 bits, as signed integers.
MASKS = tuple(((2 * j + 1) << 63) // BANDS - (1 << 63) for j in range(BANDS))
#: (window length, stride, most shingles in a piece)
SCALES = ((2, 1, 2), (6, 3, 4))

# --- fixed values: public license notices -------------------------------------
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                   "associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0-notice", "You may not use this file except in compliance with the License. Unless required by "
                          "applicable law or agreed to in writing, software distributed under the License is "
                          "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                   "GNU General Public License as published by the Free Software Foundation."),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                   "provided that the following conditions are met."),
    ("MIT-warranty", "The software is provided \"as is\", without warranty of any kind, express or implied, including but "
                     "not limited to the warranties of merchantability, fitness for a particular purpose and "
                     "noninfringement."),
    ("MIT-reference", "Licensed under the MIT License."),
    ("BSD-reference", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                          "or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0-spdx", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-spdx", "SPDX-License-Identifier: GPL-2.0"),
    ("BSD-3-Clause-spdx", "SPDX-License-Identifier: BSD-3-Clause"),
    ("LGPL-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                    "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                    "License, or (at your option) any later version."),
    ("AGPL-notice", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                    "later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-reference", "licensed under CC BY-SA 4.0"),
    ("CC-BY-reference", "licensed under CC BY 4.0"),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work."),
)
# --- end of fixed values --------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: an expression that a lambda
    mentions would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(of: Column, make: Callable[[list[Column]], Column]) -> Column:
    """``make`` of each SHINGLE neighbours of the array, in order."""
    ends = F.size(of) - (SHINGLE - 1)
    return F.when(ends > 0, F.transform(F.sequence(F.lit(0), ends - 1), lambda i: make(
        [F.get(of, i + k) for k in range(SHINGLE)])))


def hashes(text: Column) -> Column:
    """The hash of each shingle; null if there is none."""
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: shingles(h, lambda parts: F.xxhash64(*parts)))


def band_keys(window: Column) -> Column:
    """MinHash of a window of shingle hashes in each band of one row."""
    masks = F.array(*[F.lit(m) for m in MASKS])
    return F.transform(masks, lambda mask: F.array_min(F.transform(window, lambda x: x.bitwiseXOR(mask))))


def template_bands(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, shingles, hashes, keys) of the templates; ``keys`` are (scale, key) of each piece and band."""
    given = spark.createDataFrame(list(templates), "license string, notice string")
    exact = given.select("license", let(words(F.col("notice")), lambda w: F.array_distinct(
        shingles(w, lambda parts: F.concat_ws(" ", *parts)))).alias("shingles"), hashes(F.col("notice")).alias("_h"))
    if exact.filter("shingles IS NULL").count():
        raise ValueError(f"templates need at least {SHINGLE} words")
    # pieces: as few as allowed, of sizes that differ by one at most
    n = F.col("_n")
    most = F.when(n <= SCALES[0][2], SCALES[0][2]).otherwise(SCALES[1][2])
    sized = exact.withColumn("_n", F.size("_h")).withColumn("_scale", F.when(n <= SCALES[0][2], 0).otherwise(1))
    pieces = sized.withColumn("_pieces", F.ceil(n / most).cast("int"))
    keys = F.flatten(F.transform(F.expr("sequence(0, _pieces - 1)"), lambda p: F.transform(
        band_keys(F.slice("_h", F.floor(n * p / F.col("_pieces")).cast("int") + 1,
                          (F.floor(n * (p + 1) / F.col("_pieces")) - F.floor(n * p / F.col("_pieces"))).cast("int"))),
        lambda key: F.struct(F.col("_scale").alias("scale"), key.alias("key")))))
    return pieces.select("license", "shingles", F.col("_h").alias("hashes"), F.array_distinct(keys).alias("keys"))


def retrieve(docs: DataFrame, bands: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_id, _text, _hits): the rows of which a window and a template piece share a band, and the bands shared.

    A window's key is one of its shingle hashes under a mask, so it can only be a template's key if that
    shingle is a template's: texts without any are dropped in the same expression before their windows
    are walked, and the others' windows without one are skipped.  That loses no key."""
    rows = bands.collect()  # the templates: a parameter
    wanted = {s: sorted({k.key for r in rows for k in r["keys"] if k.scale == s}) for s in range(len(SCALES))}
    known = sorted({h for r in rows for h in r.hashes})

    def hits(sh: Column, scale: int) -> Column:
        length, stride, _ = SCALES[scale]
        starts = F.sequence(F.lit(1), F.size(sh), F.lit(stride))
        windows = F.filter(F.transform(starts, lambda i: F.slice(sh, i, length)),
                           lambda window: F.exists(window, lambda h: h.isin(known)))
        return F.transform(F.flatten(F.transform(windows, lambda window: F.filter(
            band_keys(window), lambda key: key.isin(wanted[scale])))),
            lambda key: F.struct(F.lit(scale).alias("scale"), key.alias("key")))

    def all_hits(sh: Column) -> Column:
        return F.array_distinct(F.concat(*[hits(sh, s) for s in wanted if wanted[s]]))

    return docs.select(named(doc_id).alias("_id"), named(text).alias("_text"), let(hashes(named(text)), lambda sh: F.when(
        F.exists(sh, lambda h: h.isin(known)), all_hits(sh))).alias("_hits")).filter(F.size("_hits") > 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, containment) of verified matches."""
    bands = cut(template_bands(docs.sparkSession, templates), "op4-templates")
    found = cut(retrieve(docs, bands, doc_id, text), "op4-retrieved")
    # the templates as one row; each retrieved row is verified where it stands
    listed = bands.agg(F.collect_list(F.struct("license", "shingles", "keys")).alias("_templates"))
    have = let(words(F.col("_text")), lambda w: F.coalesce(
        shingles(w, lambda parts: F.concat_ws(" ", *parts)), F.array().cast("array<string>")))
    rows = found.crossJoin(F.broadcast(listed)).withColumn(
        "_met", F.filter("_templates", lambda t: F.arrays_overlap(t["keys"], F.col("_hits"))))
    verified = rows.select("_id", let(have, lambda sh: F.transform("_met", lambda t: F.struct(
        t["license"].alias("license"),
        (F.size(F.array_intersect(t["shingles"], sh)) / F.size(t["shingles"])).alias("containment")))).alias("_found"))
    return (verified.select(F.col("_id").alias(doc_id), F.explode("_found").alias("_f"))
            .select(doc_id, "_f.license", "_f.containment").filter(F.col("containment") >= contained))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH t AS (
  SELECT license, regexp_extract_all(lower(notice), '[\\p{{L}}\\p{{N}}]+') AS w
  FROM (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEMPLATES)}) v(license, notice)),
ts AS (
  SELECT license, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
ds AS (
  SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS s
  FROM d WHERE len(w) >= 5),
m AS (
  SELECT doc_id, license, len(list_intersect(ts.s, ds.s))::DOUBLE / len(ts.s) AS containment FROM ds CROSS JOIN ts)
SELECT * FROM m WHERE containment >= 0.8
"""
