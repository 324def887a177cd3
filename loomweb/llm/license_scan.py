"""Operator 9, licence scans, in DataFrame functions only and without a shuffle.

A text, its paragraphs and its lines are normalised to lower-case ASCII words and compared to
licence templates by the Dice coefficient of their sets of word bigrams.  So are windows of the whole
text as long as a template, which begin at one of its bigrams: a notice within a longer paragraph or
spread over comment lines.  Exact bounds prune: a template is a candidate only for sizes b with
a*t/(2-t) <= b <= a*(2-t)/t  (a: its own size, t: the threshold); a window needs the lower number of the
template's bigrams; and a text or unit is looked at only if it has one of the words (of a short one, the word beside a
neighbour) without which too few of a template's bigrams are left to reach t.

Defined results: null or empty text, or one without a match: no licences, dice null; ties: the
template named first, the window that starts first; a window is reported besides a line,
paragraph or text that it equals; repeated rows: judged row by row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.llm.shared import table

THRESHOLD = 0.8
#: Words up to this length are looked for with a neighbour.
SHORT = 5
#: Licence notices and short licences.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed_words(bigrams: list[str], threshold: float) -> dict[str, set[str]]:
    """Words, with bigrams that have them: any text with that Dice has at least one of these bigrams, for too few are left without them."""
    least = math.ceil(threshold * len(bigrams) / (2 - threshold) - 1e-9)
    left, found = list(bigrams), {}
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        if len(left) < least:
            break
        found[word] = {b for b in left if word in b.split()}
        left = [b for b in left if b not in found[word]]
    return found


def has_needed(text: Column, low: Column, needed: dict[str, set[str]]) -> Column:
    """Whether a text (low: in lower case) has a needed word; of a short word, which many texts have by chance, also one of its bigrams.

    Each search for a plain string is one quick pass; a pattern of all the words would try each at each character."""
    of = lambda word: F.contains(low, F.lit(word))
    beside = lambda bigram: F.rlike(text, F.lit("(?i)" + bigram.replace(" ", "[^a-z0-9]+")))
    tests = [of(w) if len(w) > SHORT else of(w) & reduce(lambda a, b: a | b, map(beside, sorted(found))) for w, found in sorted(needed.items())]
    return reduce(lambda a, b: a | b, tests)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and matches: array<struct<kind, position, license, dice>>, the best template for each text, paragraph and line, and
    each template's best window (position: its first word's number)."""
    grams = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    needed: dict[str, set[str]] = {}
    for g in grams.values():
        for word, found in needed_words(g, threshold).items():
            needed.setdefault(word, set()).update(found)
    has_one = lambda raw: has_needed(raw, F.lower(raw), needed)
    described = ((n, g, len(template_words(templates[n]))) for n, g in grams.items())
    table_of = F.array(*(F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("size"), F.lit(k).alias("words")) for n, g, k in described))
    sizes = [len(g) for g in grams.values()]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    slack = 1e-9

    def units(kind: str, texts: Column) -> Column:
        at = F.transform(texts, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), t.alias("raw")))
        return F.filter(at, lambda u: has_one(u["raw"]))

    text = F.coalesce("text", F.lit(""))
    every = F.concat(units("line", F.split(text, "\n")), units("paragraph", F.split(text, "\n[ \t\r]*\n")), units("text", F.array(text)))
    split = F.transform(every, lambda u: F.struct(u["kind"].alias("kind"), u["position"].alias("position"), F.split(normalised(u["raw"]), " ").alias("words")))
    # A text of n words has at most n - 1 distinct bigrams; repeats can only lower that, so only a lower bound holds here.
    short = F.filter(split, lambda u: F.size(u["words"]) - 1 >= math.ceil(low * min(sizes) - slack))
    with_grams = F.transform(
        short,
        lambda u: F.struct(
            u["kind"].alias("kind"),
            u["position"].alias("position"),
            F.array_distinct(F.transform(F.slice(u["words"], F.lit(2), F.size(u["words"])), lambda w, i: F.concat(F.element_at(u["words"], i + 1), F.lit(" "), w))).alias("grams"),
        ),
    )
    sized = F.filter(with_grams, lambda u: F.size(u["grams"]) <= math.floor(high * max(sizes) + slack))

    def best(u: Column) -> Column:
        near = F.filter(table_of, lambda t: (F.size(u["grams"]) >= t["size"] * low - slack) & (F.size(u["grams"]) <= t["size"] * high + slack))
        scored = F.transform(near, lambda t: F.struct((-(2.0 * F.size(F.array_intersect(t["grams"], u["grams"])) / (t["size"] + F.size(u["grams"])))).alias("minus"), t["license"].alias("license")))
        return F.array_min(scored)

    found = F.transform(sized, lambda u: F.struct(u["kind"].alias("kind"), u["position"].alias("position"), best(u).alias("best")))
    matches = F.transform(
        F.filter(found, lambda u: -u["best"]["minus"] >= threshold),
        lambda u: F.struct(u["kind"].alias("kind"), u["position"].alias("position"), u["best"]["license"].alias("license"), (-u["best"]["minus"]).alias("dice")),
    )
    bigrams = let(F.split(normalised(text), " "), lambda w: F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, i: F.concat(F.element_at(w, i + 1), F.lit(" "), x)))

    def window(b: Column, t: Column) -> Column:
        """struct<minus, position> of a template's best window among the bigrams b; null if none has bigrams enough."""
        least = F.ceil(t["size"] * low - slack).cast("int")
        hits = F.filter(F.transform(b, lambda g, i: F.when(F.array_contains(t["grams"], g), i)), lambda i: i.isNotNull())
        starts = let(hits, lambda h: F.filter(F.transform(h, lambda i, k: F.when(F.get(h, k + least - 1) < i + t["words"] - 1, i)), lambda i: i.isNotNull()))

        def dice(i: Column) -> Column:
            own = F.array_distinct(F.slice(b, i + 1, t["words"] - 1))
            return let(own, lambda o: F.struct((-(2.0 * F.size(F.array_intersect(o, t["grams"])) / (t["size"] + F.size(o)))).alias("minus"), i.alias("position")))

        return F.array_min(F.transform(starts, dice))

    def windows(b: Column) -> Column:
        near = F.filter(table_of, lambda t: F.size(F.array_intersect(b, t["grams"])) >= t["size"] * low - slack)
        best_of = F.transform(near, lambda t: F.struct(t["license"].alias("license"), window(b, t).alias("best")))
        return F.transform(
            F.filter(best_of, lambda x: -x["best"]["minus"] >= threshold),
            lambda x: F.struct(F.lit("window").alias("kind"), x["best"]["position"].alias("position"), x["license"].alias("license"), (-x["best"]["minus"]).alias("dice")),
        )

    none = F.array().cast("array<struct<kind:string,position:int,license:string,dice:double>>")
    return docs.select("doc_id", F.when(has_one(text), F.concat(matches, let(bigrams, windows))).otherwise(none).alias("matches"))


def let(x: Column, body) -> Column:
    """body(x), with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_max(F.transform("matches", lambda m: m["dice"])).alias("dice"),
        F.array_join(F.transform("matches", lambda m: F.concat(m["kind"], F.lit(":"), m["position"].cast("string"), F.lit(":"), m["license"])), ",").alias("places"),
    )


def _sql() -> str:
    values = ", ".join(f"('{name}', [{', '.join(repr(g) for g in template_bigrams(text))}], {len(template_words(text))}, {n})" for n, (name, text) in enumerate(sorted(TEMPLATES.items())))
    return rf"""
WITH templates(license, grams, length, n) AS (VALUES {values}), docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), units AS (
  SELECT row, 1 AS k, 'line' AS kind, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM docs
  UNION ALL
  SELECT row, 2, 'paragraph', unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')), generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) - 1 FROM docs
  UNION ALL SELECT row, 3, 'text', text, 0 FROM docs
), worded AS (
  SELECT *, string_split(trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS words FROM units
), grammed AS (
  SELECT *, list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS g FROM worded
), scored AS (
  SELECT row, k, kind, position, license, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grammed, templates
  WHERE len(g) >= len(grams) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(g) <= len(grams) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9
), best AS (
  SELECT * FROM scored WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY row, k, position ORDER BY dice DESC, license) = 1
), whole AS (
  SELECT row, [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] AS b FROM worded WHERE k = 3
), hits AS (
  SELECT row, license, i - 1 AS i, g FROM (SELECT row, unnest(b) AS g, generate_subscripts(b, 1) AS i FROM whole) JOIN (SELECT license, unnest(grams) AS g FROM templates) USING (g)
), windows AS (
  SELECT f.row, f.license, f.i, count(DISTINCT h.g) AS shared FROM hits f JOIN templates t USING (license) JOIN hits h ON h.row = f.row AND h.license = f.license AND h.i BETWEEN f.i AND f.i + t.length - 2
  GROUP BY ALL HAVING count(DISTINCT h.g) >= any_value(len(t.grams)) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9
), rated AS (
  SELECT row, license, n, i, 2.0::DOUBLE * shared / (len(list_distinct(b[i + 1:i + length - 1])) + len(grams)) AS dice FROM windows JOIN templates USING (license) JOIN whole USING (row)
), every AS (
  SELECT row, k, position AS ord, kind, position, license, dice FROM best
  UNION ALL SELECT row, 4, n, 'window', i, license, dice FROM rated WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY row, license ORDER BY dice DESC, i) = 1
), by_doc AS (
  SELECT row, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS dice,
    string_agg(kind || ':' || position || ':' || license, ',' ORDER BY k, ord) AS places FROM every GROUP BY row
)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, dice, coalesce(places, '') AS places FROM docs LEFT JOIN by_doc USING (row)
"""


OP9_SQL = _sql()
