"""License scans: Dice coefficient over word bigrams against license templates.

Texts and templates are normalised alike: lower case, everything but letters and digits
parts words. A template of ``w`` words is compared with every window of ``w`` words that
begins at a bigram of the template (windows end with the text), so a notice is found in
the middle of a line, a paragraph or a program as well as alone. Dice is
``2 * common / (window + template)`` over the different bigrams of both, so a text scores 1
against itself. For each license that reaches ``least`` somewhere, the best window is
reported, the first of equal ones.

What prunes: as ``common`` is at most both sizes, ``least`` needs at least
``least / (2 - least)`` of the template's bigrams. Of any set with all but that many and one of
them, a text must hold one, so a few words stand for a template: a text with none of
them is done after plain substring searches, before it is cut into words. Of what is left only
templates with enough bigrams in the whole text are compared window by window.

Only DataFrame functions run here. Templates are a parameter; they are a small list that
becomes part of the plan. Each text is matched on its own row, so nothing is joined or
shuffled.

Defined results: null and empty texts and texts with less than two words match nothing;
several licenses of one text are several rows; repeated rows give repeated results; a null
id is kept; an empty table and an empty list of templates give no rows. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermark.llm.common import table, text_of
from rivermark.registry import query

LEAST = 0.8

# Public license notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        'by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _words_py(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _bigrams_py(text: str) -> list[str]:
    words = _words_py(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _needed(grams: list[str], least: float) -> int:
    """How many of a template's bigrams any matching window holds."""
    return max(1, math.ceil(least / (2 - least) * len(grams) - 1e-9))


def needles(templates: dict[str, list[str]], least: float) -> tuple[list[str], list[str]]:
    """Words and bigrams one of which is in every text that matches a template.

    For each template they are taken until the bigrams without any of them are fewer than a
    match needs: words of six letters or more first, which can be searched for as
    they are, then whole bigrams. What was taken for smaller templates counts.
    """
    words: set[str] = set()
    pairs: set[str] = set()
    for grams in sorted(templates.values(), key=len):
        left = [g.split(" ") for g in grams if g not in pairs and not any(w in g for w in words)]
        while len(left) >= _needed(grams, least):
            counts = Counter(w for g in left for w in g if len(w) >= 6)
            if counts:
                best = max(counts, key=lambda w: (counts[w], len(w), w))
                words.add(best)
                left = [g for g in left if not any(best in w for w in g)]
            else:
                best = max(left, key=lambda g: (len(g[0] + g[1]), g))
                pairs.add(" ".join(best))
                left.remove(best)
    return sorted(w for w in words if not any(v != w and v in w for v in words)), sorted(pairs)


def _likely(text: Column, grams: dict[str, list[str]], least: float) -> Column:
    words, pairs = needles(grams, least)
    tests = [F.contains(text, F.lit(w)) for w in words]
    if pairs:
        tests.append(text.rlike("|".join(r"[^\p{L}\p{N}]+".join(re.escape(w) for w in p.split(" ")) for p in pairs)))
    return reduce(lambda a, b: a | b, tests)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, position (of the window's first word, from 0) and dice."""
    grams = {name: g for name, text in sorted(templates.items()) if (g := _bigrams_py(text))}
    if not grams:
        return docs.limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0).alias("position"), F.lit(0.0).alias("dice"))
    lowered = docs.select("doc_id", F.lower(text_of()).alias("text"))
    cut = lowered.filter(_likely(F.col("text"), grams, least)).select("doc_id", _words(F.col("text")).alias("words")).filter(F.size("words") >= 2)
    # An array that is made by exploding it is made once, however often it is read below.
    pairs = F.expr("transform(sequence(0, size(words) - 2), i -> concat(words[i], ' ', words[i + 1]))")
    made = cut.select("doc_id", F.explode(F.array(pairs)).alias("grams"))
    every = F.lit(sorted(set().union(*grams.values())))
    known = made.select("doc_id", "grams", F.explode(F.array(F.array_intersect("grams", every))).alias("known")).filter(F.size("known") > 0)
    fits = F.array_compact(F.array(*[
        F.when(F.size(F.array_intersect("known", F.lit(g))) >= _needed(g, least), F.struct(
            F.lit(name).alias("license"), F.lit(len(_words_py(templates[name]))).alias("w"), F.lit(g).alias("own")
        ))
        for name, g in grams.items()
    ]))
    pair = known.select("doc_id", "grams", F.explode(fits).alias("t")).select("doc_id", "grams", "t.*")
    begins = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains("own", g), i)), lambda i: i.isNotNull())

    def scored(i: Column) -> Column:
        window = F.slice("grams", i + 1, F.col("w") - 1)
        common = F.size(F.array_intersect(window, "own"))
        return F.struct((2.0 * common / (F.size(F.array_distinct(window)) + F.size("own"))).alias("dice"), (-i).alias("back"))

    best = pair.select("doc_id", "license", F.explode(F.array(F.array_max(F.transform(begins, scored)))).alias("best"))
    return best.filter(F.col("best.dice") >= least).select("doc_id", "license", (-F.col("best.back")).alias("position"), "best.dice")


def _sql(templates: dict[str, str], least: float) -> str:
    rows = ", ".join(
        f"('{name}', {len(_words_py(text))}, [{', '.join(repr(g) for g in _bigrams_py(text))}])" for name, text in sorted(templates.items())
    )
    return rf"""
WITH t(license, w, own) AS (VALUES {rows}),
tg AS (SELECT license, w, own, unnest(own) AS gram FROM t),
d AS (SELECT row_number() OVER () AS doc, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc, doc_id, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) AS grams FROM d WHERE len(ws) >= 2),
p AS (SELECT doc, i, grams[i + 1] AS gram FROM g, unnest(range(len(grams))) r(i)),
h AS (SELECT p.doc, p.i, tg.license, tg.w, tg.own FROM p JOIN tg USING (gram)),
s AS (SELECT g.doc, g.doc_id, h.license, h.i, 2.0::DOUBLE * len(list_intersect(grams[h.i + 1 : h.i + h.w - 1], own)) / (len(list_distinct(grams[h.i + 1 : h.i + h.w - 1])) + len(own)) AS dice
  FROM h JOIN g USING (doc))
SELECT doc_id, license, i::INTEGER AS position, dice FROM s WHERE dice >= {least}
QUALIFY row_number() OVER (PARTITION BY doc, license ORDER BY dice DESC, i) = 1
"""


@query("op4_license_scan", _sql(TEMPLATES, LEAST))
def op4_license_scan(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"))
