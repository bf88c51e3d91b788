"""License scans by diagonal voting, with DataFrame operations only.

Every rolling k-gram of words of every text meets, by its hash, the places where license templates have it. A passage that
follows a template puts its hits on one diagonal (place in the text minus place in the template), and on a near one behind
each word that was added or left out. So hits are counted by diagonal, neighbouring diagonals are merged to spans, and a
span counts if equal words cover enough of the template and of the span itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import table

#: Words of a gram, and how far apart diagonals may be that belong together.
GRAM, APART = 4, 3
#: A span counts if it holds this share of its template's words, or so many of them, and they are this share of its own.
SHARE, MANY, DENSE = 0.6, 25, 0.6
#: The score of a text that only names a license.
NAMED = 0.5

# fixed values: phrases that name a license, and texts of public licenses and their usual notices
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("agpl", """GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all that is not ASCII, with A-Z in lower case; null counts as empty."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _CAPITALS, _SMALL), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def grams(w: Column, k: int = GRAM) -> Column:
    """Hashes of the k words from each word on; places where fewer are left have none."""
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))
    return F.when(F.size(w) >= k, F.slice(hashed, 1, F.size(w) - (k - 1))).otherwise(F.array().cast("array<long>"))


def named(w: Column) -> Column:
    """(at, label) of each place where the words of a phrase stand one after the other."""

    def here(x: Column, i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in reversed(PHRASES):
            first, *more = phrase.split()
            met = x == first
            for j, other in enumerate(more, 1):
                met = met & (F.get(w, i + j) == other)
            found = F.when(met, label).otherwise(found)
        return F.when(found.isNotNull(), F.struct(i.cast("long").alias("at"), found.alias("label")))

    return F.filter(F.transform(w, here), lambda p: p.isNotNull())


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = GRAM) -> DataFrame:
    """(gram, template, label, length, there, same): each gram of each template with its place and its words."""
    given = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for n, (label, text) in enumerate(templates)))
    cut = spark.range(1).select(F.inline(given)).select("template", "label", words(F.col("text")).alias("w")).withColumn("grams", grams(F.col("w"), k))
    cut = cut.select("template", "label", "w", F.posexplode("grams").alias("there", "gram"))
    return cut.select("gram", "template", "label", F.size("w").alias("length"), "there", F.slice("w", F.col("there") + 1, k).alias("same"))


#: Stands in for a gram behind the last one of a text, and for the template that it meets: the row that each text has.
_END, _NONE = -1, -1


def spans(rows: DataFrame, keep: list[str], templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = GRAM) -> DataFrame:
    """(row, label, first_word, last_word, covered, share, kept): the spans of each row that follow a template.

    rows: (row, w, keep ...), with unique `row` and the words of a text. A span goes from the first to the last word
    (from 0); covered is how many of the template's words it has, share their part of the template. Besides, each row
    has one result without a label, whose `kept` holds the columns `keep`; so no join is needed to bring both together.
    """
    # the templates are a fixed list, and so are their grams: the broadcast doesn't grow with the texts
    end = rows.sparkSession.range(1).select(F.lit(_END).cast("long").alias("gram"), F.lit(_NONE).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(1).alias("length"), F.lit(0).alias("there"), F.array().cast("array<string>").alias("same"))
    known = template_grams(rows.sparkSession, templates, k).unionByName(end)
    cut = rows.withColumn("_grams", F.concat(grams(F.col("w"), k), F.array(F.lit(_END).cast("long"))))
    cut = cut.select("row", "w", *keep, F.posexplode("_grams").alias("here", "gram"))
    last = F.greatest(F.size("w") - (k - 1), F.lit(0))
    equal = F.when(F.col("template") == _NONE, F.col("here") == last).otherwise(F.slice("w", F.col("here") + 1, k) == F.col("same"))
    hits = cut.join(F.broadcast(known), "gram").where(equal)
    kept = F.when(F.col("template") == _NONE, F.struct(*keep)).alias("kept")
    hits = hits.select("row", "template", "label", "length", "there", "here", F.when(F.col("template") == _NONE, 0).otherwise(F.col("here") - F.col("there")).alias("diagonal"), kept)
    lines = hits.groupBy("row", "template", "label", "length", "diagonal").agg(F.min("here").alias("first"), (F.max("here") + k).alias("stop"), F.collect_set("there").alias("there"), F.max("kept").alias("kept"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > APART
    lines = lines.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("span", F.sum("_new").over(order))
    merged = lines.groupBy("row", "template", "label", "length", "span").agg(F.min("first").alias("first"), F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_list("there"))).alias("there"), F.max("kept").alias("kept"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("there", lambda t: F.sequence(t, t + (k - 1))))))
    found = merged.withColumn("covered", F.when(F.col("template") == _NONE, 0).otherwise(covered)).withColumn("share", F.col("covered") / F.col("length"))
    follows = ((F.col("share") >= SHARE) | (F.col("covered") >= MANY)) & (F.col("covered") >= DENSE * (F.col("stop") - F.col("first")))
    span = lambda c: F.when(F.col("template") != _NONE, F.col(c).cast("long"))
    return found.where((F.col("template") == _NONE) | follows).select("row", "label", span("first").alias("first_word"), (span("stop") - 1).alias("last_word"), "covered", "share", "kept")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of the phrases, first_word and last_word are the least and greatest of them (else null),
    base_labels their labels. spans are (first_word, last_word, label, share) of the passages that follow a template, in
    order; labels holds the labels of both. The score is the greatest share, NAMED at least where a phrase stands, 0
    without either. Null and empty texts have no words, no labels ("") and 0. Repeated rows give equal rows, and ids may
    be null; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).withColumn("named", named(F.col("w")))
    at, names = F.col("named")["at"], F.array_sort(F.array_distinct(F.col("named")["label"]))
    rows = rows.select("row", "w", "doc_id", F.size("w").cast("long").alias("n_words"), F.size("named").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), names.alias("names"))
    keep = ["doc_id", "n_words", "n_base", "first_word", "last_word", "names"]
    found = spans(rows, keep, templates)
    span = F.when(F.col("label").isNotNull(), F.struct("first_word", "last_word", "label", "share"))
    one = found.groupBy("row").agg(F.max("kept").alias("kept"), F.sort_array(F.collect_list(span)).alias("spans"))
    labels = F.array_sort(F.array_union("kept.names", F.col("spans")["label"]))
    score = F.greatest(F.coalesce(F.array_max(F.col("spans")["share"]), F.lit(0.0)), F.when(F.col("kept.n_base") > 0, F.lit(NAMED)).otherwise(F.lit(0.0)))
    return one.select("kept.doc_id", "kept.n_words", "kept.n_base", "kept.first_word", "kept.last_word", F.array_join("kept.names", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({n}, {quoted(label)}, {quoted(text)})" for n, (label, text) in enumerate(TEMPLATES))
    phrases = " ".join(f"WHEN {' AND '.join(f'w[i + {j}] = {quoted(x)}' for j, x in enumerate(p.split()))} THEN {quoted(label)}" for p, label in PHRASES)
    breaks = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{breaks}'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT template, label, {split} AS w FROM (VALUES {templates}) v(template, label, text)),
tg AS (SELECT template, label, len(w) AS length, i AS there, w[i:i + 3] AS gram FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
p AS (SELECT r, i, CASE {phrases} END AS label FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
b AS (SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS names FROM p WHERE label IS NOT NULL GROUP BY r),
h AS (SELECT r, template, label, length, there, i FROM (SELECT r, i, w[i:i + 3] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 2)) AS i FROM d)) JOIN tg USING (gram)),
l AS (SELECT r, template, label, length, i - there AS diagonal, min(i) AS first, max(i) + 4 AS stop FROM h GROUP BY ALL),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {APART} THEN 1 ELSE 0 END AS fresh FROM l)),
m AS (SELECT r, template, label, length, span, min(first) AS first, max(stop) AS stop FROM s GROUP BY ALL),
c AS (SELECT r, template, span, count(DISTINCT there + k) AS covered FROM h JOIN s USING (r, template), range(4) x(k) WHERE h.i - h.there = s.diagonal GROUP BY ALL),
f AS (SELECT r, list(DISTINCT label) AS found, max(covered / length) AS share FROM m JOIN c USING (r, template, span)
  WHERE (covered / length >= {SHARE} OR covered >= {MANY}) AND covered >= {DENSE} * (stop - first) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(names), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(found, [])))), ','), '') AS labels,
  greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN {NAMED} ELSE 0 END) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""


OP11_SQL = _sql()
