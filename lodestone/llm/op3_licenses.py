"""License scans by the Dice coefficient over word bigrams, with DataFrame functions only.

1. Templates and texts are normalised: lower case, anything but letters and digits as one blank.
   Units of a text are its lines, its paragraphs (between blank lines), the whole, and passages: as
   many words as a template has, from any of the template's bigrams on. So a notice is found within
   prose, wrapped over lines, or laid out in several paragraphs of a longer text.
2. Dice of at least THRESHOLD needs |unit| between t/(2-t) and (2-t)/t times |template|, in distinct
   bigrams. Templates are listed by the sizes they allow, and lines, paragraphs and wholes join them
   by size alone.
3. It also needs ceil(t/(2-t) * |template|) bigrams in common, so that of any |template| less that
   plus one bigrams a unit has one at least. Those with a few long words are taken; a text
   or unit without any of these words is dropped before it is split up. Words of few letters
   aren't used where a unit without the longer ones would have to hold all other bigrams.
4. For passages, the bigrams of the texts left are joined with those of the templates. A passage
   can match only if as many of a template's bigrams as needed begin within its words, which the sorted
   places tell; only those few are taken from the text and compared.
5. Dice of the pairs left; each unit keeps its best template, ties going to the first by name. Of
   passages a text keeps the best (then the first) of each template, and of overlapping ones that
   with most bigrams in common (then the better, then the first by name).

Null and empty texts have no units. Units that are equal because a text is one line or paragraph
are reported as each kind. Rows are told apart by doc_id and text, a null doc_id is one value; rows
that repeat both are reported once. Long texts are scanned whole. Further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spooled, pick, spool

THRESHOLD = 0.8
#: Letters of the words that a unit is told by: as many if these suffice, else fewer.
LETTERS = (6, 4)

#: Short notices and opening paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD notice": "Released under the BSD License.",
    "CC-BY notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY long notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT notice": "Released under the MIT License.",
    "MIT long notice": "Licensed under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_bigrams(text: str) -> list[str]:
    w = re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def markers(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[str], list[list[str]]]:
    """Words and lists of bigrams: a unit that can match some template holds one of the words, or
    all bigrams of one of the lists.

    As many bigrams of a template may be missing as its threshold allows, so words are taken until
    they touch one more than that, those first that do most for all templates. Where words of few
    letters would be needed for the last one, a unit without the others holds all the rest.
    """
    left = {name: g for name, text in templates.items() if (g := set(template_bigrams(text)))}
    most = {name: math.floor(2 * len(g) * (1 - threshold) / (2 - threshold) + 1e-9) for name, g in left.items()}
    lacks = {name: n + 1 for name, n in most.items()}
    out: list[str] = []
    rest: list[list[str]] = []
    for letters in (*LETTERS, 1):
        if letters == 1:
            rest = [sorted(left[n]) for n, k in lacks.items() if k == 1]
            lacks = {n: k for n, k in lacks.items() if k > 1}
        while True:
            gains: Counter[str] = Counter()
            for n, k in lacks.items():
                touches = Counter(w for g in left[n] for w in set(g.split()) if len(w) >= letters)
                gains.update({w: min(k, c) for w, c in touches.items()})
            if not gains:
                break
            out.append(max(gains, key=lambda w: (gains[w], len(w), w)))
            for n in list(lacks):
                kept = {g for g in left[n] if out[-1] not in g.split()}
                lacks[n] -= len(left[n]) - len(kept)
                left[n] = kept
            lacks = {n: k for n, k in lacks.items() if k > 0}
    return sorted(w for w in out if not any(o != w and o in w for o in out)), rest


def marked(text: Column, words: list[str], rest: list[list[str]]) -> Column:
    """Whether a text holds any of ``words``, or all bigrams of a list; words first, as the cheaper."""

    def within(low: Column) -> Column:
        tests = [F.contains(low, F.lit(w)) for w in words]
        for grams in rest:
            parts = sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w))
            pairs = [F.regexp_like(low, F.lit(r"[^\p{L}\p{N}]+".join(g.split()))) for g in grams]
            tests.append(reduce(and_, [*[F.contains(low, F.lit(w)) for w in parts], *pairs]))
        return reduce(or_, tests)

    # a lambda's variable holds the lower-cased text for all tests
    return F.exists(F.array(F.lower(text)), within)


def bigrams(normal: Column) -> Column:
    w = F.split(normal, " ")
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def _unit(kind: str) -> Callable[[Column, Column], Column]:
    return lambda text, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("unit"), text.alias("text"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def units(texts: DataFrame, words: list[str], rest: list[list[str]]) -> DataFrame:
    """doc_id, text_key, kind, unit, text of every line, paragraph and whole that is ``marked``."""
    kinds = [("line", F.split("text", r"\r?\n")), ("paragraph", F.split("text", r"\r?\n[ \t]*\r?\n")), ("whole", F.array("text"))]
    parts = F.flatten(F.array(*[F.transform(a, _unit(k)) for k, a in kinds]))
    found = texts.select("doc_id", "text_key", F.explode(parts).alias("u")).select("doc_id", "text_key", "u.kind", "u.unit", "u.text")
    return found.where(marked(F.col("text"), words, rest))


def least_common(n: int, threshold: float) -> int:
    """Bigrams that a unit must have in common with a template of n."""
    return math.ceil(threshold / (2 - threshold) * n - 1e-9)


def in_units(texts: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """The best template of each line, paragraph and whole."""
    rows = [(n, m, g) for n, text in sorted(templates.items()) if (g := template_bigrams(text)) for m in range(least_common(len(g), threshold), math.floor((2 - threshold) / threshold * len(g) + 1e-9) + 1)]
    listed = F.broadcast(texts.sparkSession.createDataFrame(rows, "license string, size int, template array<string>"))  # fixed templates
    key = ["doc_id", "text_key", "kind", "unit"]
    found = units(texts, *markers(templates, threshold)).select(*key, normalised(F.col("text")).alias("normal")).where(F.contains("normal", F.lit(" ")))
    found = found.select(*key, bigrams(F.col("normal")).alias("grams")).withColumn("size", F.size("grams"))
    common = F.size(F.array_intersect("grams", "template"))
    found = found.join(listed, "size").withColumn("dice", 2.0 * common / (F.col("size") + F.size("template"))).where(F.col("dice") >= threshold)
    best = found.groupBy(*key).agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    return best.select("doc_id", "kind", "unit", "best.license", (-F.col("best.less")).alias("dice"))


def in_passages(texts: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """The best passages of each text; unit is a passage's first word."""
    grams = {n: g for n, text in templates.items() if (g := template_bigrams(text))}
    length = {n: len(re.sub(r"[\W_]+", " ", templates[n].lower()).split()) for n in grams}
    spark, key = texts.sparkSession, ["doc_id", "text_key"]
    listed = F.broadcast(spark.createDataFrame([(x, n) for n, g in grams.items() for x in g], "gram string, license string"))  # fixed templates
    plan = F.broadcast(spark.createDataFrame([(n, g, length[n], least_common(len(g), threshold)) for n, g in grams.items()], "license string, template array<string>, n_words int, needed int"))
    w = F.split(normalised(F.col("text")), " ")
    words = texts.select(*key, w.alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    at = words.select(*key, F.posexplode(pairs).alias("at", "gram")).join(listed, "gram").groupBy(*key, "license").agg(F.sort_array(F.collect_list("at")).alias("at")).join(plan, "license")
    # as many hits as needed begin within the words of a passage that starts at this one
    starts = F.filter("at", lambda x, i: F.get("at", i + F.col("needed") - 1) <= x + F.col("n_words") - 2)
    found = spool(at.select(*key, "license", "template", "n_words", starts.alias("starts")).where(F.size("starts") > 0), "op3-passages")

    def compared(x: Column) -> Column:
        part = F.slice("w", x + 1, F.col("n_words"))
        n = F.greatest(F.size(part) - 1, F.lit(0))
        own = F.array_distinct(F.zip_with(F.slice(part, F.lit(1), n), F.slice(part, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))
        common = F.size(F.array_intersect(own, F.col("template")))
        return F.struct((-2.0 * common / (F.size(own) + F.size("template"))).alias("less"), x.alias("unit"), common.alias("common"))

    # a row that comes twice has the same passages
    best = join_spooled(words, found.drop("doc_id"), "text_key", "inner").select(*key, "license", "n_words", F.array_min(F.transform("starts", compared)).alias("b")).where(F.col("b.less") <= -threshold)
    ranked = best.select(*key, F.struct((-F.col("b.common")).alias("rank"), F.col("b.less").alias("less"), "license", F.col("b.unit").alias("unit"), (F.col("b.unit") + F.col("n_words")).alias("end")).alias("p"))
    lists = ranked.groupBy(*key).agg(F.collect_set("p").alias("all"))  # a template each
    lone = F.filter("all", lambda p: ~F.exists("all", lambda q: (q < p) & (q["unit"] < p["end"]) & (p["unit"] < q["end"])))
    return lists.select("doc_id", F.explode(lone).alias("p")).select("doc_id", F.lit("passage").alias("kind"), "p.unit", "p.license", (-F.col("p.less")).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind, unit, license, dice: the best template of every unit that matches one."""
    texts = pick(docs, doc_id="bigint", text="string").where(marked(F.col("text"), *markers(templates, threshold)))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text")
    texts = spool(texts.select("doc_id", F.md5(named).alias("text_key"), "text"), "op3-marked")
    return in_units(texts, templates, threshold).unionByName(in_passages(texts, templates, threshold))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_GRAMS = "list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])"
ORACLE_SQL = rf"""
WITH t AS (
  SELECT license, w AS template_words, {_GRAMS} AS template FROM (SELECT license, string_split({_NORMAL.format('text')}, ' ') AS w FROM (VALUES {", ".join(f"({_text(n)}, {_text(x)})" for n, x in sorted(TEMPLATES.items()))}) v(license, text))
), docs AS (
  SELECT DISTINCT doc_id, text FROM documents
), u AS (
  SELECT doc_id, text, 'line' AS kind, unnest(range(0, len(a))) AS unit, unnest(a) AS x FROM (SELECT doc_id, text, regexp_split_to_array(text, '\r?\n') AS a FROM docs)
  UNION ALL SELECT doc_id, text, 'paragraph', unnest(range(0, len(a))), unnest(a) FROM (SELECT doc_id, text, regexp_split_to_array(text, '\r?\n[ \t]*\r?\n') AS a FROM docs)
  UNION ALL SELECT doc_id, text, 'whole', 0, text FROM docs
), g AS (
  SELECT doc_id, text, kind, unit, {_GRAMS} AS grams FROM (SELECT *, string_split({_NORMAL.format('x')}, ' ') AS w FROM u) WHERE len(w) > 1
), d AS (
  SELECT *, 2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)) AS dice FROM g, t
), best AS (
  SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, license, dice FROM d WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, text, kind, unit ORDER BY dice DESC, license) = 1
), hits AS (
  SELECT doc_id, text, license, w[pos + 1:pos + len(template_words)] AS w, pos, pos + len(template_words) AS stop, template
  FROM (SELECT doc_id, text, words AS w, unnest(range(0, len(words) - 1)) AS pos FROM (SELECT doc_id, text, string_split({_NORMAL.format('text')}, ' ') AS words FROM docs)) p, t
  WHERE list_contains(template, w[pos + 1] || ' ' || w[pos + 2])
), passages AS (
  SELECT *, len(list_intersect(grams, template)) AS common, 2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)) AS dice FROM (SELECT *, {_GRAMS} AS grams FROM hits)
), top AS (
  SELECT * FROM passages WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, text, license ORDER BY dice DESC, pos) = 1
)
SELECT * FROM best
UNION ALL SELECT doc_id, 'passage', CAST(pos AS INTEGER), license, dice FROM top p WHERE NOT EXISTS (
  SELECT 1 FROM top q WHERE q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.text = p.text AND q.pos < p.stop AND p.pos < q.stop
    AND (q.common > p.common OR q.common = p.common AND (q.dice > p.dice OR q.dice = p.dice AND q.license < p.license)))
"""
