"""Licence scans by diagonal voting, with DataFrame functions only.

All rolling word k-grams of a text are joined by hash to the positions of the same k-grams in licence
templates, and their words compared. A hit votes for its diagonal (place in the text minus place in the template);
neighbouring diagonals are merged, and a merged span counts once enough of the template's words are in it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motifstream.llm.common import ascii_lower, documents, materialize

#: Words, phrases with their labels, licence templates (notices and whole short licences) with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEXTS = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {WARRANTY}"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)
TEMPLATES = tuple((label, " ".join(re.findall(r"[0-9a-z]+", text.lower()))) for label, text in TEXTS)
K, GAP, COVER = 3, 2, 0.6


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(k)))


def _grams(words: Column, k: int) -> Column:
    """(pos, gram) of all rolling k-grams."""
    none = F.array().cast("array<struct<pos:int,gram:bigint>>")
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(i.alias("pos"), _gram(words, i, k).alias("gram")))).otherwise(none)


def template_grams(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(tpl, label, n_tpl, tpos, gram, own): a table whose size is fixed by the templates in the code; ``own`` are the gram's words."""
    rows = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(templates))
    t = spark.sql(f"SELECT tpl, label, split(text, ' ') AS words FROM VALUES {rows} AS t(tpl, label, text)")
    t = t.select("tpl", "label", F.size("words").alias("n_tpl"), "words", F.explode(_grams(F.col("words"), k)).alias("g"))
    return t.select("tpl", "label", "n_tpl", F.col("g.pos").alias("tpos"), F.col("g.gram").alias("gram_t"), F.slice("words", F.col("g.pos") + 1, F.lit(k)).alias("own"))


def license_hits(docs: DataFrame, *, templates=TEMPLATES, k: int = K) -> DataFrame:
    """In the shared folder: a row with ``pos`` -1 and the base counts for each row of ``docs``, and one for each k-gram that a template has.

    ``th`` is the hash of the text, so that rows which share an id do not mix. Texts are read and split once.
    Templates are a constant of the code, so their join is broadcast whatever the corpus holds.
    """
    text = ascii_lower(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), text.alias("low")).select(
        "doc_id", "th", (F.contains("low", F.lit("license")) | F.contains("low", F.lit("cc"))).alias("maybe"), F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("words"))
    w = F.col("words")
    starts = [(label, phrase.split(" ")) for phrase, label in PHRASES]
    here = lambda i, p: reduce(lambda a, b: a & b, [F.get(w, i + j) == x for j, x in enumerate(p)])
    which = lambda i: reduce(lambda a, b: a.when(here(i, b[1]), b[0]), starts[1:], F.when(here(i, starts[0][1]), starts[0][0]))
    places = F.when(F.col("maybe") & (F.size(w) >= 2), F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.struct(i.alias("at"), which(i).alias("label"))), lambda x: x["label"].isNotNull()))
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("gram")))
    # grams are a column before they are exploded, so that compiled code passes words on without a copy for each gram;
    # none of the arrays is empty, but explode() would have Spark filter on their size first, with all of them made anew
    rows = base.select("doc_id", "th", "words", places.alias("places"), F.concat(own, _grams(w, k)).alias("grams"))
    rows = rows.select("doc_id", "th", "words", "places", F.explode_outer("grams").alias("g")).select("doc_id", "th", "words", "places", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))
    met = rows.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), F.col("gram") == F.col("gram_t"), "left")
    met = met.filter((F.col("pos") < 0) | (F.slice("words", F.col("pos") + 1, F.lit(k)) == F.col("own")))
    first = lambda c: F.when(F.col("pos") < 0, c)
    return materialize(met.select("doc_id", "th", "pos", "tpl", "label", "n_tpl", "tpos", first(F.size("words").cast("long")).alias("n_words"), first(F.col("places")).alias("places")), "licence-hits")


def license_spans(hits: DataFrame, *, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Verified spans: (doc_id, th, tpl, label, first_word, last_word, covered), one row for each merged diagonal.

    ``covered`` is the share of the template's words that stand in the span, in k-grams of equal words. Votes are
    summed before they are shuffled.
    """
    key = ["doc_id", "th", "tpl"]
    votes = hits.filter("pos >= 0").groupBy(*key, "label", "n_tpl", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("tpos").alias("places"))
    # a diagonal starts a span of its own unless the one before it is within the gap
    by = W.partitionBy(*key).orderBy("diag")
    fresh = F.when(F.col("diag") - F.lag("diag").over(by) <= gap, 0).otherwise(1)
    words = lambda places: F.array_distinct(F.flatten(F.transform(places, lambda t: F.sequence(t, t + (k - 1)))))
    merged = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(by)).groupBy(*key, "label", "n_tpl", "span").agg(
        F.min("lo").alias("first_word"), (F.max("hi") + (k - 1)).alias("last_word"), F.size(words(F.array_distinct(F.flatten(F.collect_list("places"))))).alias("found"))
    covered = F.col("found") / F.col("n_tpl")
    return merged.withColumn("covered", covered).filter(covered >= cover).select(*key, "label", "first_word", "last_word", "covered")


def scan_licenses(docs: DataFrame, *, templates=TEMPLATES, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """One row per document: its words, phrase places, labels and score (best covered share of a template).

    Null and empty texts have no words: zeros, null places, empty labels, score 0. Rows that share id and text
    get equal results; null ids match themselves; other columns are ignored.
    """
    hits = license_hits(docs, templates=templates, k=k)
    none = F.array().cast("array<string>")
    base = hits.filter("pos < 0").select("doc_id", "th", "n_words", F.coalesce(F.size("places"), F.lit(0)).alias("n"), F.get("places", F.lit(0))["at"].cast("long").alias("first_word"),
        F.element_at(F.when(F.size("places") > 0, F.col("places")), -1)["at"].cast("long").alias("last_word"), F.coalesce(F.array_sort(F.array_distinct(F.col("places.label"))), none).alias("found"))
    more = license_spans(hits, k=k, gap=gap, cover=cover).groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("covered").alias("covered"))
    more = more.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "more", "covered")
    both = base.join(more, base["doc_id"].eqNullSafe(more["d"]) & base["th"].eqNullSafe(more["t"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("found", F.coalesce("more", none))))
    return both.select(
        "doc_id", "n_words", F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join("found", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.round(F.coalesce("covered", F.lit(0.0)), 6).alias("score"))


def op6_diagonals(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    test = lambda p: " AND ".join(f"words[i + {j}] = '{x}'" for j, x in enumerate(p.split(" ")))
    case = "CASE " + " ".join(f"WHEN {test(p)} THEN '{label}'" for p, label in PHRASES) + " END"
    tpl = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(TEMPLATES))
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS words FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, words FROM d),
        w AS (SELECT doc_id, i, words[i] AS w, words[i + 1] AS w1, words[i + 2] AS w2 FROM p),
        phrases AS (SELECT doc_id, i - 1 AS place, {case} AS label FROM p),
        base AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS found FROM phrases WHERE label IS NOT NULL GROUP BY 1),
        t AS (SELECT * FROM (VALUES {tpl}) v(tpl, label, words)),
        q AS (SELECT tpl, label, len(words) AS n_tpl, words, unnest(range(1, len(words) - {K - 2})) AS i FROM t),
        tg AS (SELECT tpl, label, n_tpl, i - 1 AS tpos, words[i] AS w, words[i + 1] AS w1, words[i + 2] AS w2 FROM q),
        votes AS (SELECT doc_id, tpl, label, n_tpl, w.i - 1 - tpos AS diag, list(DISTINCT tpos) AS places FROM w JOIN tg USING (w, w1, w2) GROUP BY ALL),
        fresh AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tpl ORDER BY diag) <= {GAP} THEN 0 ELSE 1 END AS f FROM votes),
        spans AS (SELECT *, sum(f) OVER (PARTITION BY doc_id, tpl ORDER BY diag ROWS UNBOUNDED PRECEDING) AS span FROM fresh),
        merged AS (SELECT doc_id, tpl, label, len(list_distinct(flatten(list_transform(flatten(list(places)), lambda t: range(t, t + {K}))))) / n_tpl AS covered FROM spans GROUP BY doc_id, tpl, label, n_tpl, span),
        more AS (SELECT doc_id, list(DISTINCT label) AS more, max(covered) AS covered FROM merged WHERE covered >= {COVER} GROUP BY 1)
        SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(more, [])))), ','), '') AS labels,
            round(coalesce(covered, 0), 6)::DOUBLE AS score
        FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


QUERIES = {"op6_diagonals": op6_diagonals}
SQL = {"op6_diagonals": _sql()}
