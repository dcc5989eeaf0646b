"""Licence scans: Dice coefficient over word bigrams between parts of a text and licence templates.

Texts and templates are normalised alike (A-Z lower-cased, words of a-z and
0-9, so comment marks vanish) and turned into sets of word bigrams. A text is
compared with a template of w words as a whole, and by runs of its lines
(lines without a word left out): from each line that shares a bigram with the
template that line alone, the shortest run of w words or more, and that run
without its last line. The best of them counts.

Dice = 2 * shared / (unit + template) can reach ``threshold`` only if unit and
template are within a factor of r = threshold / (2 - threshold) in size and
share r of the template's bigrams. So a text is compared with a template only
if it has one of its 1 - r rarest bigrams (a prefix of the template: its
bigrams that the fewest templates have, longest first), found by joining the
texts' bigrams to that fixed list, and then if it has r of all of them. All of
it is DataFrame functions.

Null texts, empty texts and texts of fewer than two words match nothing. Texts
of any length are compared as a whole. What holds of a text holds of all rows
with it, so repeated rows and null or repeated ids get that text's answer.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontospark.runtime import materialize

THRESHOLD = 0.8
#: Candidates (three numbers each) up to which they go to every task rather than through a shuffle with the texts.
BROADCAST_ROWS = 1 << 20

#: Licence names and short notices they are known by. Whole licences are the files in ``licence_texts``.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
]
TEMPLATES = NOTICES + [(path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLACK = 1e-9


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(words_: Column) -> Column:
    """The bigrams of an array of words as 64-bit hashes, in order."""

    def pairs(w: Column) -> Column:
        many = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), many), F.slice(w, F.lit(2), many), lambda a, b: F.xxhash64(a, b))

    return _let(words_, pairs)


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``(template, license, length, grams)``: the words' number and the distinct bigrams; templates of one word match nothing."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, text string")
    cut = rows.select("template", "license", words(F.col("text")).alias("w"))
    return cut.select("template", "license", F.size("w").alias("length"), F.array_distinct(bigrams(F.col("w"))).alias("grams")).where(F.size("grams") > 0)


def _rare_bigrams(table: DataFrame, spark: SparkSession, templates: list[tuple[str, str]], ratio: float) -> DataFrame:
    """``(bigram, template)``: of each template so many bigrams that a matching text has one of them."""
    rows = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(templates)], "template int, text string").select("template", words(F.col("text")).alias("w"))
    several = F.size("w") > 1
    spelled = rows.where(several).select("template", F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(F.xxhash64(a, b).alias("bigram"), (F.length(a) + F.length(b)).alias("long")))).alias("b"))
    each = spelled.select("template", "b.bigram", "b.long").distinct()
    owners = each.groupBy("bigram").agg(F.count("*").alias("owners"))
    listed = each.join(owners, "bigram").groupBy("template").agg(F.array_sort(F.collect_list(F.struct("owners", (-F.col("long")).alias("short"), "bigram"))).alias("b"))
    many = F.size("b") - F.ceil(F.size("b") * ratio - SLACK).cast("int") + 1
    return listed.select("template", F.explode(F.slice("b", F.lit(1), many)).alias("b")).select("template", "b.bigram")


def _best_dice(threshold_ratio: float) -> Column:
    """The largest Dice of a text's units with one template, of columns ``w`` (words), ``line`` of each word, ``starts`` of lines, ``b`` (bigrams), ``grams`` and ``length``."""
    n, lines, size = F.size("w"), F.size("starts"), F.size("grams")

    def ended(common: Column) -> Column:
        def dice(first: Column, last: Column) -> Column:
            """Of the words from ``first`` up to ``last``, counted from zero."""
            part = F.slice("b", first + 1, F.greatest(last - first - 1, F.lit(0)))
            return _let(F.array_distinct(part), lambda d: 2 * F.size(F.array_intersect(d, common)) / (F.size(d) + size))

        def end(k: Column) -> Column:
            return F.when(k + 1 < lines, F.get("starts", k + 1)).otherwise(n)

        def runs(first: Column, k: Column) -> Column:
            inside = F.slice("b", first + 1, F.greatest(end(k) - first - 1, F.lit(0)))
            last = F.get("line", F.least(first + F.col("length"), n) - 1)  # the line in which the run reaches the template's length
            units = _let(last, lambda x: F.greatest(dice(first, end(k)), dice(first, end(x)), F.when(x > k, dice(first, F.get("starts", x))).otherwise(F.lit(0.0))))
            return F.when(F.arrays_overlap(inside, common), units).otherwise(F.lit(0.0))

        best = F.greatest(dice(F.lit(0), n), F.array_max(F.transform("starts", runs)))
        return F.when(F.size(common) >= size * threshold_ratio - SLACK, best).otherwise(F.lit(0.0))

    return _let(F.array_intersect(F.array_distinct("b"), F.col("grams")), ended)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_matches, licenses, best_score)`` per row of ``docs``.

    ``n_matches``: templates whose best Dice with the text is ``threshold`` or
    more; ``licenses``: their licences, distinct and sorted, joined by commas
    (empty: none); ``best_score``: the largest Dice (null: none).
    """
    spark = docs.sparkSession
    ratio = threshold / (2 - threshold)
    table = template_table(spark, templates)
    keys = [F.xxhash64(text_col).alias("th"), F.crc32(F.col(text_col).cast("binary")).alias("tc")]
    slim = docs.select(F.col(id_col).alias("id"), *keys, F.col(text_col).alias("text"))
    each = slim.where(F.octet_length("text") > 0).select("th", "tc", F.explode(F.array_distinct(bigrams(words(F.col("text"))))).alias("bigram"))
    rare = F.broadcast(materialize(_rare_bigrams(table, spark, templates, ratio), "rare"))
    wanted = materialize(each.join(rare, "bigram").select("th", "tc", "template").distinct().groupBy("th", "tc").agg(F.collect_list("template").alias("templates")), "candidates")
    few = (wanted.agg(F.sum(F.size("templates"))).first()[0] or 0) <= BROADCAST_ROWS
    some = slim.join(F.broadcast(wanted) if few else wanted, ["th", "tc"])
    by_line = F.filter(F.transform(F.split("text", "\n"), words), lambda w: F.size(w) > 0)
    some = some.select("th", "tc", "templates", by_line.alias("lines"))
    some = some.select("th", "tc", "templates", F.flatten("lines").alias("w"), F.flatten(F.transform("lines", lambda ws, k: F.transform(ws, lambda _: k))).alias("line"))
    first = F.filter(F.transform("line", lambda k, p: F.when((p == 0) | (F.get("line", p - 1) != k), p).otherwise(F.lit(-1))), lambda p: p >= 0)
    some = some.select("th", "tc", "templates", "w", "line", first.alias("starts"), bigrams(F.col("w")).alias("b"))
    pairs = some.withColumn("template", F.explode("templates")).join(F.broadcast(table), "template")
    scored = pairs.select("th", "tc", "template", "license", _best_dice(ratio).alias("dice")).where(F.col("dice") >= threshold).distinct()
    found = scored.groupBy("th", "tc").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("best_score"))
    found = materialize(found, "licenses")
    few = found.count() <= BROADCAST_ROWS
    out = slim.select("id", "th", "tc").join(F.broadcast(found) if few else found, ["th", "tc"], "left")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), "best_score")
