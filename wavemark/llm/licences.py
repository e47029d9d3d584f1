"""Licence scan with DataFrame functions alone: Dice coefficient over word bigrams, size bounds before comparing.

Texts without any of the words that a match must have are done with where they are read. The lines of the others are
dealt to stretches of twice the longest unit. Only stretches that hold enough of a template's bigrams are put together,
and every run of their lines that can be a unit is compared with the templates whose size allows it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Table

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_GNU = "This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_GNU_END = " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. You should have received a copy of the GNU {name} General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Public licence notices, headers and the licences that are short enough to be put into a file whole.
TEMPLATES = {
    "0BSD-text": _ISC + "." + _ISC_END,
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": (_GNU + _GNU_END).format(what="program", sign=":", name="Affero", version=3),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause-text": _BSD + _BSD_NAME + _BSD_END,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": (_GNU + _GNU_END).format(what="program", sign=";", name="", version=2),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GNU.format(what="program", sign=":", name="", version=3),
    "GPL-3.0-header-long": (_GNU + _GNU_END).format(what="program", sign=":", name="", version=3),
    "ISC": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END,
    "LGPL-2.1-header": (_GNU + _GNU_END).format(what="library", sign=";", name="Lesser", version="2.1"),
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": (_GNU + _GNU_END).format(what="library", sign=":", name="Lesser", version=3),
    "MIT": "Released under the MIT License.",
    "MIT-grant": _MIT,
    "MIT-text": _MIT + " " + _AS_IS,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that a word needs to tell where a unit may begin and end.
EDGE_LETTERS = 6


def words_of(text: str) -> list[str]:
    """A-Z lower-cased, then runs of a-z and 0-9."""
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def longest_unit(templates: dict[str, str], threshold: float) -> int:
    """Words of the longest unit: what the longest template may be exceeded by at the threshold."""
    return int(max(len(words_of(t)) for t in templates.values()) * (2 - threshold) / threshold)


def edge_words(templates: dict[str, str]) -> list[str]:
    """The longer words of the templates; where a template has none, all of its words."""
    found: set[str] = set()
    for text in templates.values():
        words = set(words_of(text))
        found |= {w for w in words if len(w) >= EDGE_LETTERS} or words
    return sorted(found)


def needed_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every text with a match has one.

    A unit that reaches the threshold shares threshold / (2 - threshold) of a template's bigrams at least. Fewer than
    those are left without a word taken here. In each turn the longer word that helps most templates along is taken, a
    shorter one where no longer one helps.
    """
    left, spare, taken = {}, {}, []
    for name, text in templates.items():
        pairs = [frozenset(b.split(" ")) for b in bigrams_of(text)]
        left[name] = pairs
        spare[name] = fewest_shared(len(pairs), threshold) - 1
    while open_ones := [n for n in sorted(left) if len(left[n]) > spare[n]]:
        words = sorted({w for n in open_ones for p in left[n] for w in p})

        def gain(w: str, open_ones: list[str] = open_ones) -> tuple:
            return len(w) >= EDGE_LETTERS, sum(min(len(left[n]) - spare[n], sum(w in p for p in left[n])) / (len(left[n]) - spare[n]) for n in open_ones), w

        taken.append(max(words, key=gain))
        left = {n: [p for p in pairs if taken[-1] not in p] for n, pairs in left.items()}
    return [w for w in taken if not any(x != w and x in w and len(x) >= EDGE_LETTERS for x in taken)]  # a text with the longer one has the shorter one


def _has_one(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words: long ones anywhere, short ones as words of their own."""
    out, short = F.lit(False), [w for w in words if len(w) < EDGE_LETTERS]
    lower = F.lower(text)  # more than A-Z becomes small letters, which can't take a word away
    for word in words:
        found = F.contains(lower, F.lit(word))
        out = out | (found & text.rlike(f"(?i)(?<![a-z0-9]){word}(?![a-z0-9])") if word in short else found)
    return out


def fewest_shared(size: int, threshold: float) -> int:
    """Bigrams of a template with so many that a match shares at least."""
    return next(n for n in range(1, size + 1) if 2.0 * n >= threshold * (n + size))


def _likely(dealt: DataFrame, known: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """key, stretch of the stretches that hold as many of a template's bigrams as a match needs, wherever they stand.

    Each line's bigrams, with the one over its beginning, meet those of the templates in a join with a table of fixed size.
    """
    wanted = [(k, n, gram) for k, (_, grams) in enumerate(known) for n, gram in enumerate(grams)]
    least = F.array(*(F.lit(fewest_shared(len(grams), threshold)) for _, grams in known))
    table = dealt.sparkSession.createDataFrame(wanted, "template int, number int, gram string")
    words = F.when(F.col("word_before").isNotNull(), F.concat(F.array("word_before"), F.col("words"))).otherwise(F.col("words"))
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = dealt.where(F.size(words) > 1).select("key", "stretch", F.explode(pairs).alias("gram"))
    shared = grams.join(F.broadcast(table), "gram").groupBy("key", "stretch", "template").agg(F.size(F.collect_set("number")).alias("n"))
    return shared.where(F.col("n") >= F.get(least, F.col("template"))).select("key", "stretch").distinct()


def scan(docs: DataFrame, *, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, license, dice, licenses, n_matches.

    A unit is a run of lines (lines without a word don't count) of at most `longest_unit` words in all that begins and
    ends with a line holding one of `edge_words`: a line, a wrapped notice, paragraphs, a whole text. A unit and a
    template match when the Dice coefficient of their distinct word bigrams reaches the threshold. Only templates whose
    size allows it are compared: 2 min / (a + b) bounds the coefficient. `license` is the best match (the first name on
    ties), `licenses` all matched names in order, `n_matches` the lines that a matching unit begins with. Null and empty
    texts, and texts without two words, match nothing (null, null, empty, 0); an empty table gives no rows. Rows with
    null ids and repeated rows are answered each; other columns, whatever their names, are ignored. Texts are read whole:
    a line of a very long one meets only lines near it.
    """
    given = templates or TEMPLATES
    known = [(name, bigrams_of(text)) for name, text in sorted(given.items())]
    if not all(b for _, b in known):
        raise ValueError("a template needs two words or more")
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("grams")) for name, b in known))
    most, edges = longest_unit(given, threshold), F.array(*map(F.lit, edge_words(given)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    there = _has_one(F.col("text"), needed_words(given, threshold))
    plain = F.regexp_replace(F.translate("text", UPPER, LOWER), "[^a-z0-9\n]+", " ")
    held = Table(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.when(there, plain).alias("plain")), "licence-candidates").read()

    lines = held.where("plain is not null").select("key", F.posexplode(F.split("plain", "\n")).alias("line", "words")).withColumn("words", F.trim("words")).where("words <> ''")
    lines = lines.withColumn("words", F.split("words", " ")).withColumn("n", F.size("words"))
    order = Window.partitionBy("key").orderBy("line")
    lines = lines.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("word_before", F.lag(F.element_at("words", -1)).over(order))
    lines = lines.withColumn("first", F.col("upto") - F.col("n")).where(F.col("n") <= most).withColumn("edge", F.arrays_overlap("words", edges))
    # a unit that begins in one stretch of `most` words ends in it or the next
    at = F.floor(F.col("first") / most)
    dealt = lines.withColumn("stretch", F.explode(F.array(at, at - 1)))
    likely = _likely(dealt, known, threshold)
    one = F.struct("line", "first", "upto", "edge", (at == F.col("stretch")).alias("own"), "words")
    near = dealt.join(likely, ["key", "stretch"], "left_semi").groupBy("key", "stretch").agg(F.array_sort(F.collect_list(one)).alias("a"), F.max((at == F.col("stretch")) & F.col("edge")).alias("any")).where("any")

    def ends_of(s: Column) -> Column:
        return F.filter("a", lambda t: t["edge"] & (t["line"] >= s["line"]) & (t["upto"] - s["first"] <= most))

    def grams_of(s: Column, t: Column) -> Column:
        words = F.flatten(F.transform(F.filter("a", lambda x: (x["line"] >= s["line"]) & (x["line"] <= t["line"])), lambda x: x["words"]))
        pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))

    units = F.transform(ends_of(F.col("s")), lambda t: F.struct(F.col("s.line").alias("line"), grams_of(F.col("s"), t).alias("grams")))

    def compare(u: Column) -> Column:
        n = F.size(u["grams"])
        fits = F.filter(table, lambda t: (n > 0) & (2.0 * F.least(n, F.size(t["grams"])) >= threshold * (n + F.size(t["grams"]))))
        scored = F.transform(fits, lambda t: F.struct((-(2.0 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + F.size(t["grams"])))).alias("less"), t["name"].alias("name"), u["line"].alias("line")))
        return F.filter(scored, lambda s: s["less"] <= -threshold)

    begun = near.select("key", "a", F.explode(F.filter("a", lambda s: s["own"] & s["edge"])).alias("s"))  # a row holds the units of one line
    found = begun.select("key", F.explode(units).alias("u")).select("key", F.explode(compare(F.col("u"))).alias("m"))
    best = found.groupBy("key").agg(F.min(F.struct("m.less", "m.name")).alias("best"), F.array_join(F.array_sort(F.collect_set("m.name")), ",").alias("names"), F.count_distinct("m.line").cast("int").alias("n"))
    matched = held.select("key", "doc_id").join(best, "key", "left")
    return matched.select("doc_id", F.col("best.name").alias("license"), (-F.col("best.less")).alias("dice"), F.coalesce("names", F.lit("")).alias("licenses"), F.coalesce("n", F.lit(0)).alias("n_matches"))


def oracle_sql(threshold: float = 0.8) -> str:
    """The same scan of `documents` in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(n)}, [{', '.join(map(quote, bigrams_of(t)))}])" for n, t in sorted(TEMPLATES.items()))
    most, edges = longest_unit(TEMPLATES, threshold), ", ".join(map(quote, edge_words(TEMPLATES)))
    return f"""
    WITH templates(name, grams) AS (VALUES {values}),
    plain AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'), '') AS t FROM documents),
    parts AS (SELECT k, unnest(list_zip(range(1, len(string_split(t, chr(10))) + 1), string_split(t, chr(10)))) AS p FROM plain),
    lines AS (SELECT k, p[1] AS i, string_split(trim(p[2]), ' ') AS w FROM parts WHERE trim(p[2]) <> ''),
    counted AS (SELECT *, sum(len(w)) OVER (PARTITION BY k ORDER BY i) AS upto, list_has_any(w, [{edges}]) AS edge FROM lines),
    bounds AS (SELECT a.k, a.i AS i, b.i AS j FROM counted a JOIN counted b ON a.k = b.k AND b.i >= a.i AND b.upto - a.upto + len(a.w) <= {most} WHERE a.edge AND b.edge),
    units AS (SELECT b.k, b.i, b.j, flatten(list(c.w ORDER BY c.i)) AS w FROM bounds b JOIN counted c ON c.k = b.k AND c.i BETWEEN b.i AND b.j GROUP BY b.k, b.i, b.j),
    grams AS (SELECT k, i, list_distinct(list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1])) AS g FROM units WHERE len(w) > 1),
    scored AS (
        SELECT k, i, name, CAST(2 * len(list_intersect(g, grams)) AS DOUBLE) / (len(g) + len(grams)) AS dice
        FROM grams JOIN templates ON CAST(2 * least(len(g), len(grams)) AS DOUBLE) >= {threshold} * (len(g) + len(grams))),
    hits AS (
        SELECT k, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(DISTINCT i) AS n
        FROM scored WHERE dice >= {threshold} GROUP BY k)
    SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses, CAST(coalesce(n, 0) AS INTEGER) AS n_matches FROM plain LEFT JOIN hits USING (k)
    """
