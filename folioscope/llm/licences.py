"""Licence scans: Dice coefficient over word bigrams; DataFrame functions only.

Method. A text's units are its lines, its paragraphs (parts between blank lines) and the
whole text. A unit is normalised to lower-case runs of letters and digits. With n words it
has n - 1 bigrams, repeats counted, and so has each licence template. Their Dice
coefficient is twice the number of common bigrams over the sum of both sizes. A coefficient
of t needs sizes within t / (2 - t) and (2 - t) / t of each other, so a unit is compared
with templates of such sizes only, and units that fit no template are dropped before any
bigram is made. Bigrams of the other units meet the templates' in an equality join with a
small table of fixed size, which is broadcast; only matches are shuffled.

Defined results: null and empty texts have no match; a unit or template of one word has no
bigram and no match; ties go to the licence first by name; rows that repeat get equal
results; a row with a null id is matched like any other; an empty table gives an empty
table; other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence notices and texts, as their publishers give them.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TERM = r"[\p{L}\p{N}]+"


def template_bigrams(templates: list[tuple[str, str]]) -> list[tuple[int, str, int, str, int]]:
    """(template, licence, bigrams of it, bigram, its count) for each template's bigrams."""
    out = []
    for i, (name, text) in enumerate(templates):
        words = re.findall(r"[^\W_]+", text.lower())
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        out += [(i, name, len(pairs), p, pairs.count(p)) for p in sorted(set(pairs))]
    return out


def scan(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_matches, licence, dice) of each row: how many units match a licence, and the best match."""
    spark: SparkSession = docs.sparkSession
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    table = template_bigrams(templates)
    known = spark.createDataFrame(table, "template int, licence string, n_b int, bigram string, c_b int")
    sizes = sorted({r[2] for r in table})
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n[ \t\r]*\n"), F.array("text")))
    rows = docs.select("id", "h", F.posexplode(units).alias("unit", "u"))
    # sizes that some template is near to, joined to a few ranges
    n = F.col("n_a")
    fits = None
    for lo, hi in _ranges([(s * low, s * high) for s in sizes]):
        inside = (n >= lo) & (n <= hi)
        fits = inside if fits is None else fits | inside
    rows = rows.withColumn("n_a", F.regexp_count("u", F.lit(TERM)) - 1).where(fits if fits is not None else F.lit(False))
    words = F.regexp_extract_all(F.lower("u"), F.lit(TERM), F.lit(0))
    rows = rows.select("id", "h", "unit", "n_a", words.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.size("w") - 1), lambda x, i: F.concat_ws(" ", x, F.element_at("w", i + 2)))
    rows = rows.select("id", "h", "unit", "n_a", F.posexplode(pairs).alias("place", "bigram"))
    vocabulary = spark.createDataFrame([(b,) for b in sorted({r[3] for r in table})], "bigram string")
    rows = rows.join(F.broadcast(vocabulary), "bigram", "left_semi").distinct()  # rows that repeat count once
    counts = rows.groupBy("id", "h", "unit", "n_a", "bigram").agg(F.count(F.lit(1)).alias("c_a"))
    near = counts.join(F.broadcast(known), (counts["bigram"] == known["bigram"]) & F.col("n_a").between(F.col("n_b") * low, F.col("n_b") * high))
    dice = near.groupBy("id", "h", "unit", "n_a", "template", "licence", "n_b").agg(F.sum(F.least("c_a", "c_b")).alias("common"))
    dice = dice.withColumn("dice", 2.0 * F.col("common") / (F.col("n_a") + F.col("n_b"))).where(F.col("dice") >= threshold)
    # the best of each unit's, then of each text's; the least name wins a tie
    dice = dice.groupBy("id", "h", "unit").agg(F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("best"))
    dice = dice.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_matches"), F.min("best").alias("best"))
    found = dice.select(F.col("id").alias("id2"), F.col("h").alias("h2"), "n_matches", F.col("best.licence").alias("licence"), (-F.col("best.d")).alias("dice"))
    out = docs.select("id", "h").join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "licence", F.coalesce("dice", F.lit(0.0)).alias("dice"))


def _ranges(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Overlapping spans as one."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out
