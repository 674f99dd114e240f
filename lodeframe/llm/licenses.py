"""License scans in DataFrame functions: Dice coefficients of word bigrams against templates.

A document's passages are its lines, its paragraphs of more than one line (blank lines separate
them), the whole text where it has more than one paragraph, and windows.  A passage and a template
are normalised alike: lower case, every run of characters other than letters and digits a space.
With A and B their sets of word bigrams, Dice is 2 |A and B| / (|A| + |B|).

A window finds a template anywhere, whatever stands around it or breaks its lines: it is any run of as many
words as the template has (fewer at the text's end).  Of a text's windows for a template the best is given, of
equals the first; ``number`` is the word at which it starts.  A window that reaches a Dice of t shares at least
t |B| / (2 - t) bigrams with the template, so the places where a template's bigrams stand in a text, in order, give all
windows to be tried: those that hold so many places.

Pruning loses nothing.  Dice of at least t needs |B| t / (2 - t) <= |A| <= |B| (2 - t) / t: the size
bounds under which a template is a candidate.  It also needs t |B| / (2 - t) shared bigrams or
more, so of any set of more than the rest of a template's bigrams at least one is shared; each
template names such a set by a few words (``signature``), and a text without any signature word
is not cut into passages.  The templates, a fixed number, are all that is broadcast.

Cases: null text counts as empty and matches nothing; a null id stays null; repeated rows give
repeated matches; of templates that tie on a passage the first by name is given; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.texts import id_and_text
from lodeframe.storage import stored

#: Public licenses ("full"), the passages that long ones begin with ("text"), and the
#: notices that licenses ask for or that are in common use, by SPDX name.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without written permission.",
    "All-rights-reserved": 'All rights reserved.',
    "Apache-2.0-text": 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.',
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-2.0-text": 'The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.',
    "GPL-3.0-text": 'The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.',
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-or-later": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.',
    "LGPL-3.0-or-later": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.',
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0-text": 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: Words that are in any English text; a signature takes them last.
COMMON = set("a all an and any are as at be by following for from in is it may no not of on one or other see that the this to under use with without work you".split())

NOT_ALNUM = r"[^\p{L}\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def signature(bigrams: list[str], threshold: float) -> set[str]:
    """Words of which every text that reaches ``threshold`` has at least one: they meet more
    bigrams than such a text may lack.  Long words first, as they are rare.

    >>> sorted(signature(template_bigrams("Licensed under CC BY-NC 4.0."), 0.8))
    ['cc', 'licensed']
    """
    spare = len(bigrams) - ceil(threshold * len(bigrams) / (2 - threshold) - 1e-9)
    met, chosen = set(), set()
    words = Counter(w for b in bigrams for w in set(b.split()))
    for word in sorted(words, key=lambda w: (w in COMMON, -len(w), -words[w], w)):
        if len(met) > spare:
            break
        chosen.add(word)
        met |= {b for b in bigrams if word in b.split()}
    return chosen


def _passages(text: Column) -> Column:
    blank = r"\n[\x20\x09-\x0D]*\n"
    lines = F.split(text, "\n", -1)
    paragraphs = F.filter(F.split(text, blank, -1), lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(F.regexp_like(text, F.lit(blank)), F.array(text)).otherwise(F.array().cast("array<string>"))
    kinds = ((lines, "line"), (paragraphs, "paragraph"), (whole, "text"))

    def named(kind: str):
        return lambda p, k: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("number"), p.alias("passage"))

    return F.concat(*(F.transform(parts, named(kind)) for parts, kind in kinds))


def _normal_words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), NOT_ALNUM, " ")), " ")


def _pairs(w: Column) -> Column:
    """The bigrams of an array of words, in order."""
    return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _bigrams(passage: Column) -> Column:
    # transform() of one value works out the words once, not once for each pair
    return F.element_at(F.transform(F.array(_normal_words(passage)), lambda w: F.array_distinct(_pairs(w))), 1)


def n_words(text: str) -> int:
    return len(re.sub(r"[\W_]+", " ", text).split())


def _windows(hit: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(doc_id, number, license, dice) of each text's best window for each template."""
    spark = hit.sparkSession
    known = [(name, n_words(text), b, ceil(threshold * len(b) / (2 - threshold) - 1e-9)) for name, text in sorted(templates.items()) if (b := template_bigrams(text))]
    listed = F.broadcast(spark.createDataFrame([(x, name) for name, _, b, _ in known for x in b], "bigram string, license string"))
    shapes = F.broadcast(spark.createDataFrame(known, "license string, n_words int, b array<string>, least int"))
    # stored, as rows are numbered and used twice
    words = stored(hit.select("doc_id", F.monotonically_increasing_id().alias("row"), _normal_words(F.col("text")).alias("w")), "words")
    each = words.select("row", F.posexplode(_pairs(F.col("w"))).alias("at", "bigram"))
    # a text's own places, no more than it has words
    held = each.join(listed, "bigram").groupBy("row", "license").agg(F.sort_array(F.collect_list("at")).alias("p")).join(shapes.drop("b"), "license").where(F.size("p") >= F.col("least"))
    runs = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("least")), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", i + F.col("least") - 1).alias("z"), F.coalesce(F.get("p", i - 1), F.lit(-1)).alias("before")))
    full = held.select("row", "license", "n_words", F.explode(F.filter(runs, lambda r: r["z"] - r["a"] <= F.col("n_words") - 2)).alias("r"))
    # starts at or before the place before belong to the run before
    tried = full.select("row", "license", "n_words", F.explode(F.sequence(F.greatest(F.col("r.z") - F.col("n_words") + 2, F.col("r.before") + 1), F.col("r.a"))).alias("first"))
    # the window by itself first: what works on its words would unpack the whole text for each
    own = words.join(tried, "row").select("row", "doc_id", "license", "first", F.explode(F.array(F.slice("w", F.col("first") + 1, F.col("n_words")))).alias("v"))
    cut = own.select("row", "doc_id", "license", "first", F.explode(F.array(F.array_distinct(_pairs(F.col("v"))))).alias("a"))
    scored = cut.join(shapes, "license").select("row", "doc_id", "license", "first", (2.0 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))).alias("dice")).where(F.col("dice") >= threshold)
    best = scored.groupBy("row", "license").agg(F.max(F.struct("dice", (-F.col("first")).alias("place"), "doc_id")).alias("best"))
    return best.select("best.doc_id", (-F.col("best.place")).cast("long").alias("number"), "license", "best.dice")


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage that a template matches: doc_id, kind and number of the passage, the
    best template's name and its Dice coefficient; windows have a row for each template."""
    known = {name: b for name, text in sorted(templates.items()) if (b := template_bigrams(text))}
    wanted = sorted(set().union(*(signature(b, threshold) for b in known.values())))
    smallest = min(map(len, known.values())) * threshold / (2 - threshold)
    largest = max(map(len, known.values())) * (2 - threshold) / threshold
    rows = id_and_text(docs, id_col, text_col)
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(wanted)})(?![\p{{L}}\p{{N}}])"
    # stored: few texts have a signature word, and they are cut in two ways
    hit = stored(rows.where(F.regexp_like(F.lower("text"), F.lit(pattern))), "hit")
    passages = hit.select("doc_id", F.explode(_passages(F.col("text"))).alias("p")).select("doc_id", "p.*")
    # explode() of one value keeps the optimizer from repeating it wherever it is used
    cut = passages.select("doc_id", "kind", "number", F.explode(F.array(_bigrams(F.col("passage")))).alias("bigrams"))
    cut = cut.select("*", F.explode(F.array(F.size("bigrams"))).alias("n")).where((F.col("n") >= smallest - 1e-9) & (F.col("n") <= largest + 1e-9))
    # a template is compared only within its size bounds
    scores = [
        F.when(F.col("n").between(len(b) * threshold / (2 - threshold) - 1e-9, len(b) * (2 - threshold) / threshold + 1e-9), F.struct((2.0 * F.size(F.array_intersect("bigrams", F.array(*map(F.lit, b)))) / (F.col("n") + len(b))).alias("dice"), F.lit(-k).alias("place"), F.lit(name).alias("license")))
        for k, (name, b) in enumerate(known.items())
    ]
    best = F.array_max(F.filter(F.array(*scores), lambda s: s["dice"] >= threshold))
    found = cut.select("doc_id", "kind", "number", F.explode(F.array(best)).alias("best")).where("best IS NOT NULL").select("doc_id", "kind", "number", "best.license", "best.dice")
    return found.unionByName(_windows(hit, templates, threshold).withColumn("kind", F.lit("window")))


def oracle_sql(templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same scan in DuckDB SQL, without the pruning."""
    listed = lambda bigrams: ", ".join(f"'{b}'" for b in bigrams)
    values = ", ".join(f"('{name}', [{listed(template_bigrams(text))}])" for name, text in sorted(templates.items()))
    lengths = ", ".join(f"('{name}', {n_words(text)})" for name, text in sorted(templates.items()))
    return f"""
WITH templates(license, b) AS (VALUES {values}),
lengths(license, n_words) AS (VALUES {lengths}),
texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
split_up AS (
  SELECT doc_id, 'line' AS kind, string_split(text, chr(10)) AS parts FROM texts
  UNION ALL SELECT doc_id, 'paragraph', list_filter(string_split_regex(text, '\\n[\\x20\\x09-\\x0D]*\\n'), lambda p: contains(p, chr(10))) FROM texts
  UNION ALL SELECT doc_id, 'text', CASE WHEN regexp_matches(text, '\\n[\\x20\\x09-\\x0D]*\\n') THEN [text] ELSE [] END FROM texts),
passages AS (SELECT doc_id, kind, unnest(range(len(parts))) AS number, unnest(parts) AS passage FROM split_up),
cut AS (SELECT doc_id, kind, number, string_split(trim(regexp_replace(lower(passage), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM passages),
pairs AS (SELECT doc_id, kind, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM cut WHERE len(w) >= 2),
scored AS (
  SELECT doc_id, kind, number, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM pairs JOIN templates ON len(a) BETWEEN len(b) * {threshold} / (2 - {threshold}) - 1e-9 AND len(b) * (2 - {threshold}) / {threshold} + 1e-9),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, number ORDER BY dice DESC, license) AS r FROM scored WHERE dice >= {threshold}),
words AS (SELECT row, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM texts),
own AS (SELECT row, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM words),
tried AS (SELECT row, license, n_words, unnest(range(len(g))) AS first FROM own, templates JOIN lengths USING (license) WHERE len(list_intersect(g, b)) >= len(b) * {threshold} / (2 - {threshold}) - 1e-9),
windows AS (SELECT row, doc_id, license, first, w[first + 1 : first + n_words] AS v FROM tried JOIN words USING (row)),
sets AS (SELECT row, doc_id, license, first, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS a FROM windows),
rated AS (SELECT row, doc_id, license, first, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM sets JOIN templates USING (license)),
top AS (SELECT *, row_number() OVER (PARTITION BY row, license ORDER BY dice DESC, first) AS r FROM rated WHERE dice >= {threshold})
SELECT doc_id, kind, number::BIGINT AS number, license, dice::DOUBLE AS dice FROM best WHERE r = 1
UNION ALL SELECT doc_id, 'window', first::BIGINT, license, dice::DOUBLE FROM top WHERE r = 1"""
