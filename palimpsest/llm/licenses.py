"""Licence scan: text units against licence templates by Dice coefficient over word bigrams.

Units are the lines of a document, the sentences of lines that have several, its paragraphs of several lines and, where it
has several paragraphs, the whole text. A unit and a template are reduced to lower-cased ASCII words and to the set of their
bigrams (of words, if there is one word only). 2 |A and B| / (|A| + |B|) can reach t only if |B| is between |A| t/(2-t) and
|A| (2-t)/t, so a unit meets only the templates of such sizes. It also asks for t/(2-t) of the template's bigrams; words
of which the others are too few make a list for all templates, and a text without any of these is not cut into units.
Everything is SQL functions in one pass over the documents, without a shuffle; templates are a parameter, bounded in
number and size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds on what is broadcast: templates, their bigrams, and the rows of the table of templates by size.
MOST_TEMPLATES, MOST_BIGRAMS, MOST_SIZES = 500, 2_000_000, 2_000_000


@dataclass(frozen=True)
class Template:
    license_id: str
    name: str
    text: str


_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_CONDITIONS = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

#: Wordings of public licences and notices; fixed values.
TEMPLATES = (
    Template("MIT", "notice", "Released under the MIT License."),
    Template("MIT", "licensed", "This project is licensed under the terms of the MIT license."),
    Template("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("MIT", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    Template("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    Template("BSD-3-Clause", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    Template("CC-BY-4.0", "work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    Template("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    Template("proprietary", "reserved", "All rights reserved."),
    Template("BSD-2-Clause", "notice", "Released under the BSD 2-Clause License."),
    Template("BSD-2-Clause", "warranty", _BSD_WARRANTY),
    Template("GPL-2.0", "header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    Template("GPL-3.0", "warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("LGPL-2.1", "header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("AGPL-3.0", "header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("EPL-2.0", "header", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    Template("BSL-1.0", "notice", "Distributed under the Boost Software License, Version 1.0."),
    Template("Zlib", "warranty", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    Template("ISC", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
)
_TEXT = {f"{t.license_id} {t.name}": t.text for t in TEMPLATES}
#: Whole licences, put together from their parts.
TEMPLATES += (
    Template("MIT", "text", " ".join([_TEXT["MIT grant"], _MIT_NOTICE, _TEXT["MIT warranty"]])),
    Template("ISC", "text", " ".join([_TEXT["ISC grant"], _TEXT["ISC warranty"]])),
    Template("BSD-2-Clause", "text", " ".join([_TEXT["BSD-3-Clause grant"], _BSD_CONDITIONS, _BSD_WARRANTY])),
    Template("BSD-3-Clause", "text", " ".join([_TEXT["BSD-3-Clause grant"], _BSD_CONDITIONS, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", _BSD_WARRANTY])),
)


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams in order of first occurrence, as the column expression makes them."""
    words = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys([f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] if len(words) > 1 else words))


#: Common words, which tell little; they are taken last.
COMMON = frozenset("a all an and any are as at be been by can for free from has have if in is it its may must no not of on one or other such that the their there these this to under was were which will with without work you your".split())


def telling_words(templates: Sequence[Template], threshold: float) -> list[str]:
    """Words of which every unit that matches a template has one: of each template its longest words, common ones last,
    until fewer bigrams are without them than a match needs, threshold / (2 - threshold) of all."""
    out: set[str] = set()
    for t in templates:
        grams = [set(g.split(" ")) for g in template_bigrams(t.text)]
        needed = math.ceil(len(grams) * (threshold - 1e-6) / (2 - threshold) - 1e-9)
        for word in sorted({w for g in grams for w in g}, key=lambda w: (w in COMMON, -len(w), w)):
            if len(grams) < needed or not grams:
                break
            out.add(word)
            grams = [g for g in grams if word not in g]
    return sorted(out)


def plain_words(text: Column) -> Column:
    """The lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(text: Column) -> Column:
    """Distinct bigrams of the words. One-element arrays bind what is used more than once."""
    words = plain_words(text)
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))
    return F.array_distinct(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(w))[0])


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit and template whose Dice coefficient reaches the threshold: doc_id, unit (line, sentence, paragraph
    or document), unit_no (from 0, among units of its kind; a document is 0), license_id, template, dice. Ties all stay.
    Null, empty and wordless texts match nothing; repeated rows are reported each, null ids stay null; other columns are not
    read.

    Each template's number is listed under every size it can match, so that the size bounds are an equality, and its
    bigrams stand once beside it: both joins are broadcast hash joins with bounded tables, and a licence of thousands of
    words is a template like others."""
    by_size: dict[int, list[int]] = {}
    own = [template_bigrams(t.text) for t in templates]
    for k, grams in enumerate(own):
        low, high = len(grams) * threshold / (2 - threshold), len(grams) * (2 - threshold) / threshold
        for n in range(math.ceil(low - 1e-9), math.floor(high + 1e-9) + 1) if grams else ():
            by_size.setdefault(n, []).append(k)
    if len(templates) > MOST_TEMPLATES or sum(map(len, own)) > MOST_BIGRAMS or sum(map(len, by_size.values())) > MOST_SIZES:
        raise ValueError("too many or too long templates for a broadcast")
    spark = docs.sparkSession
    sizes = spark.createDataFrame([(n, ks) for n, ks in by_size.items() if n], "size int, numbers array<int>")
    table = spark.createDataFrame([(k, t.license_id, t.name, grams) for k, (t, grams) in enumerate(zip(templates, own, strict=True))], "number int, license_id string, template string, grams array<string>")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("unit_no"), x.alias("piece")))
    marked = F.filter(F.split(F.regexp_replace("text", "([.!?])[ \t]+", "$1\x1e"), "\n"), lambda x: F.contains(x, F.lit("\x1e")))
    sentences = F.transform(F.flatten(F.transform(marked, lambda x: F.split(x, "\x1e"))), lambda x, i: F.struct(F.lit("sentence").alias("unit"), i.alias("unit_no"), x.alias("piece")))
    parts = F.split("text", "\n[ \t]*\n")
    paragraphs = F.filter(F.transform(parts, lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("unit_no"), x.alias("piece"))), lambda u: F.contains(u["piece"], F.lit("\n")))
    whole = F.when(F.size(parts) > 1, F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("unit_no"), F.col("text").alias("piece")))).otherwise(F.array())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")
    texts = texts.where(F.arrays_overlap(plain_words(F.col("text")), F.array(*map(F.lit, telling_words(templates, threshold)))))
    units = F.transform(F.concat(lines, sentences, paragraphs, whole), lambda u: F.struct(u["unit"].alias("unit"), u["unit_no"].alias("unit_no"), bigrams(u["piece"]).alias("own")))
    found = texts.select("doc_id", F.explode_outer(units).alias("u")).join(F.broadcast(sizes), F.size("u.own") == F.col("size"))
    found = found.select("doc_id", "u", "size", F.explode("numbers").alias("number")).join(F.broadcast(table), "number")
    dice = F.round(2.0 * F.size(F.array_intersect("u.own", "grams")) / (F.col("size") + F.size("grams")), 6)
    return found.select("doc_id", "u.unit", "u.unit_no", "license_id", "template", dice.alias("dice")).where(F.col("dice") >= threshold)


def scan_sql(templates: Sequence[Template] = TEMPLATES, threshold: float = 0.8) -> str:
    """The same for DuckDB over a view named documents."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quote(t.license_id)}, {quote(t.name)}, {quote(t.text)})" for t in templates)
    words = "[w FOR w IN regexp_split_to_array(lower({}), '[^a-z0-9]+') IF w <> '']"
    grams = "list_distinct(CASE WHEN len(words) > 1 THEN [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] ELSE words END)"
    return f"""
WITH t AS (
    SELECT license_id, template, {grams} AS grams FROM (
        SELECT license_id, template, {words.format("body")} AS words FROM (VALUES {rows}) v(license_id, template, body))
), u AS (
    SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no FROM documents
    UNION ALL
    SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS piece, generate_subscripts(regexp_split_to_array(text, '\\n[ \\t]*\\n'), 1) - 1 AS unit_no FROM documents) WHERE contains(piece, chr(10))
    UNION ALL
    SELECT doc_id, 'sentence', unnest(s), generate_subscripts(s, 1) - 1 FROM (
        SELECT doc_id, flatten([string_split(x, chr(30)) FOR x IN string_split(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(30), 'g'), chr(10)) IF contains(x, chr(30))]) AS s FROM documents)
    UNION ALL
    SELECT doc_id, 'document', text, 0 FROM documents WHERE len(regexp_split_to_array(text, '\\n[ \\t]*\\n')) > 1
), g AS (
    SELECT doc_id, unit, unit_no, {grams} AS own FROM (SELECT doc_id, unit, unit_no, {words.format("piece")} AS words FROM u WHERE piece <> '')
), d AS (
    SELECT doc_id, unit, unit_no, license_id, template,
           round(2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)), 6) AS dice
    FROM g JOIN t ON len(own) BETWEEN len(grams) * {threshold} / (2 - {threshold}) - 1e-9 AND len(grams) * (2 - {threshold}) / {threshold} + 1e-9
)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, license_id, template, CAST(dice AS DOUBLE) AS dice FROM d WHERE dice >= {threshold}
"""
