"""License scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Texts are lower-cased and cut into words (digits, letters and everything outside ASCII), so line
breaks, comment signs and punctuation do not matter. A run of words with the bigram set A matches a
template's set B if 2|A & B| / (|A| + |B|) >= ``THRESHOLD``. For threshold t that needs at least
t / (2 - t) * |B| bigrams in common. This size bound is applied to the text as a whole first: it
leaves the few templates of which a text has enough bigrams, and for nearly all texts none. For these
the text is looked at in windows of the template's own length, one from each place where a bigram of
the template stands, ended at the last of its bigrams. So a licence is found as a line, a comment
block, a paragraph, inside a sentence, or as a file of its own.

All of it happens inside the scan of a text; only hits are shuffled. Templates are a list in the
driver's program, which is put into the plan.

Defined results for odd input
* Null and empty texts, and texts of fewer than two words, have no bigrams and no hits.
* Several windows and several templates of a licence give one row with the largest coefficient, and
  with the first word (from 1) of the window that has it; ties go to the first.
* Rows that repeat an id are one document; null ids are one group.
* An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import ascii_lower, let, split_words

THRESHOLD = 0.8
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices, headers and full texts of common licences, each as its licence states it.
_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
_ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_GNU_HEADER = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
TEMPLATES = [
    ("AGPL-3.0", _GNU_HEADER.format("This program", "Affero General Public License", 3)),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Released under the BSD License."),
    ("BSD", _BSD[0]),
    ("BSD", " ".join([_BSD[0], _BSD[1], _BSD[2], _BSD[4]])),
    ("BSD", " ".join(_BSD)),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU_HEADER.format("This program", "General Public License", 3)),
    ("ISC", _ISC[0]),
    ("ISC", " ".join(_ISC)),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", _GNU_HEADER.format("This library", "Lesser General Public License", 3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT[0]),
    ("MIT", " ".join(_MIT)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", _ZLIB),
]


def bigrams(lowered: Column) -> Column:
    """Hashes of neighbouring words of a lower-cased text, in order."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))

    return let(split_words(lowered, NO_WORD), pairs)


def _template_array(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> tuple[Column, Column, int]:
    """(license, length, need, grams) of each template, all their bigrams, and the least ``need``, for use in a plan."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    found = []
    for r in rows.select("template", "license", bigrams(ascii_lower(F.col("text"))).alias("g")).orderBy("template").collect():
        grams = sorted(set(r["g"]))
        if grams:
            found.append({"license": r["license"], "length": len(r["g"]), "need": math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9), "grams": grams})
    known = F.from_json(F.lit(json.dumps(found)), "array<struct<license: string, length: int, need: int, grams: array<bigint>>>")
    every = F.from_json(F.lit(json.dumps(sorted({g for t in found for g in t["grams"]}))), "array<bigint>")
    return known, every, min((t["need"] for t in found), default=1)


def _best_window(g: Column, t: Column) -> Column:
    """(dice, -start) of the best window of a text's bigrams for a template."""

    def window(near: Column) -> Column:
        start = F.element_at(near, 1)
        return let(F.array_distinct(F.slice(g, start, F.element_at(near, -1) - start + 1)), lambda a: F.struct(
            F.round(2 * F.size(F.array_intersect(a, t["grams"])) / (F.size(a) + F.size(t["grams"])), 6).alias("dice"), (-start).alias("before")))

    def windows(places: Column) -> Column:
        reach = lambda s, i: F.filter(F.slice(places, i + 1, t["length"]), lambda p: p < s + t["length"])
        return F.array_max(F.transform(F.transform(places, reach), window))

    return let(F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(t["grams"], F.element_at(g, i))), windows)


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id_col, license, dice (of the best window), first_word (of that window) of every document with a licence."""
    known, every, least = _template_array(docs.sparkSession, templates, threshold)

    def hits(g: Column) -> Column:
        def of(common: Column) -> Column:
            able = F.filter(known, lambda t: F.size(F.array_intersect(common, t["grams"])) >= t["need"])
            return F.transform(able, lambda t: F.struct(t["license"].alias("license"), _best_window(g, t).alias("best")))

        none = F.filter(F.transform(F.array(known[0]), lambda t: F.struct(t["license"].alias("license"), F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("before")).alias("best"))), lambda x: F.lit(False))
        return let(F.array_intersect(g, every), lambda common: F.when(F.size(common) >= least, of(common)).otherwise(none))

    # all inside the generator: nothing in it can be evaluated a second time for a filter before it
    lowered = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.select(F.col(id_col).alias("id"), F.explode(let(bigrams(lowered), hits)).alias("x")).select("id", "x.*")
    best = found.filter(F.col("best.dice") >= threshold).groupBy("id", "license").agg(F.max("best").alias("best"))
    return best.select(F.col("id").alias(id_col), "license", "best.dice", (-F.col("best.before")).alias("first_word"))
