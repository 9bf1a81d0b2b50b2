"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of a text are hashed and joined to the grams of the
templates. A match votes for its diagonal (text position minus template
position). A phrase whose grams all vote for one diagonal stands there word for
word. For longer templates neighbouring diagonals are merged in bands of a
bounded width, so that inserted or dropped words do not hide a text, and the
span is verified: the words of every match are compared, each place of the
template counts once, matches must go forward in text and template alike, and
the words so covered are weighed against template and span.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.session import prepare

#: Phrases that count where their words stand consecutively: (words, label).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Texts and notices of licenses as their authors publish them.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
    " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
    " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
    " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright"
    " notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or"
    " (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR"
    " PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled"
    " binary, for any purpose, commercial or non-commercial, and by any means."
)
#: Longer templates that need only be nearly whole: (words, label).
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    (MIT, "mit-text"), (BSD, "bsd-text"), (ISC, "isc-text"), (APACHE, "apache-2.0-text"), (GPL, "gpl-3.0-text"), (UNLICENSE, "unlicense-text"),
)
#: Words in a gram (two-word phrases have grams of two), and the least share of a template's words that must be covered.
GRAM, COVERAGE = 3, 0.7
#: Diagonals that far apart can be merged: a share of the template's words, two at least; a band is twice as wide and overlaps its neighbours by half.
DRIFT = 8
# Fixed value: what is not part of a word (ASCII other than digits and letters).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _templates(spark, phrases, templates) -> DataFrame:
    """(t, label, whole, n_grams, n_template, drift, tpos, k, gram, terms), and a row with gram 0 that every text matches once."""
    rows = []
    for t, (text, label, whole) in enumerate([*((a, b, True) for a, b in phrases), *((a, b, False) for a, b in templates)]):
        w = template_words(text)
        if len(w) < 2:
            raise ValueError("a phrase needs two words")
        k = min(GRAM, len(w))
        rows += [(t, label, whole, len(w) - k + 1, len(w), max(2, len(w) // DRIFT), i, k, w[i : i + k]) for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "t int, label string, whole boolean, n_grams int, n_template int, drift int, tpos int, k int, terms array<string>")
    pair = F.xxhash64(F.get("terms", 0), F.get("terms", 1))
    df = df.withColumn("gram", F.when(F.col("k") == 2, pair).otherwise(F.xxhash64(pair, F.get("terms", 2))))
    return df.unionByName(spark.createDataFrame([(-1, 0)], "t int, gram long"), allowMissingColumns=True)


def _chain(places: Column, k: Column) -> Column:
    """Template words covered, first and last text word of the matches that go forward in template and text, from (tpos, pos) in order."""
    start = F.struct(F.lit(-1).alias("tpos"), F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("covered"), F.lit(0).alias("end"), F.lit(-1).cast("long").alias("first"))

    def step(s: Column, x: Column) -> Column:
        on = F.struct(
            x["tpos"].alias("tpos"), x["pos"].alias("pos"), (s["covered"] + F.least(k, x["tpos"] + k - s["end"])).alias("covered"), (x["tpos"] + k).alias("end"),
            F.when(s["first"] < 0, x["pos"]).otherwise(s["first"]).alias("first"),
        )
        return F.when((x["tpos"] > s["tpos"]) & (x["pos"] > s["pos"]), on).otherwise(s)

    return F.aggregate(places, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    n_base counts all places of ``phrases``, first_word and last_word are their
    smallest and largest start (null: none); base_labels and labels are distinct,
    sorted and comma-joined ('' for none), labels with those of ``templates``
    of which COVERAGE is found; score is the best share of one found (1 for a
    phrase, 0 for nothing): words covered by the longer of template and span.
    Only ``id_col`` and ``text_col`` are read. A null text is empty; rows with
    equal or null ids stay separate rows; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(lowered, SEPARATORS), "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), words.alias("words"))
    n = F.size("words")
    later = lambda i: F.slice("words", i + 1, F.greatest(n - i, F.lit(0)))
    table = _templates(spark, phrases, templates)
    listed = [r["gram"] for r in table.select("gram").distinct().collect()]  # a constant of the caller: some hundreds
    rows = rows.withColumn("pairs", F.zip_with("words", later(1), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))
    rows = rows.withColumn("triples", F.zip_with("pairs", later(2), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))
    # only grams that some template has are made rows
    met = lambda c: F.filter(F.transform(c, lambda h, i: F.struct(i.alias("pos"), h.alias("gram"))), lambda x: x["gram"].isin(listed))
    own = F.array(F.struct(n.alias("pos"), F.lit(0).cast("long").alias("gram")))
    kinds = ([met("pairs")] if any(len(template_words(p)) == 2 for p, _ in (*phrases, *templates)) else []) + [met("triples")]
    grams = rows.select("doc_id", "rid", n.cast("long").alias("n_words"), "words", F.explode(F.concat(*kinds, own)).alias("x"))
    grams = grams.select("doc_id", "rid", "n_words", "words", F.col("x.pos").cast("long").alias("pos"), "x.gram")
    hits = grams.join(F.broadcast(table), "gram").filter((F.col("t") < 0) | (F.slice("words", (F.col("pos") + 1).cast("int"), F.col("k")) == F.col("terms")))
    # a text has few matches besides its own row: one exchange by text serves all groupings below
    hits = hits.drop("words", "terms", "gram").repartition("rid")

    key = ["rid", "doc_id", "n_words", "t", "label", "whole", "n_grams", "n_template", "k"]
    diagonal, width = F.col("pos") - F.coalesce("tpos", F.lit(0)), F.col("drift") * 2
    bands = F.when(F.coalesce("whole", F.lit(True)), F.array(diagonal)).otherwise(F.array(F.floor(diagonal / width) * 2, F.floor((diagonal + F.col("drift")) / width) * 2 + 1))
    banded = hits.select(*key, "tpos", "pos", F.explode(bands).alias("band"))
    # a band holds at most its width times the template's grams, however often a text repeats them
    spans = banded.groupBy(*key, "band").agg(F.array_sort(F.collect_list(F.struct("tpos", "pos"))).alias("places"))
    spans = spans.withColumn("chain", F.when(~F.col("whole"), _chain(F.col("places"), F.col("k"))))
    share = F.col("chain.covered") / F.greatest(F.col("n_template").cast("long"), F.col("chain.pos") + F.col("k") - F.col("chain.first"))
    base = F.col("whole") & (F.size("places") == F.col("n_grams"))
    start = F.col("band")
    found = base | (~F.col("whole") & (F.col("chain.covered") >= F.lit(COVERAGE) * F.col("n_template")))
    out = spans.groupBy("rid", "doc_id", "n_words").agg(
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, start)).alias("first_word"),
        F.max(F.when(base, start)).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(found, share)), F.lit(0.0)).alias("score"),
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
