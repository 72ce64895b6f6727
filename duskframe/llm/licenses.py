"""License scans: texts, their lines and passages against license templates by Dice's coefficient over word bigrams.

A unit (a whole text, one of its lines, or a passage) is normalised to lower-case words; its distinct bigrams
are met with those of the templates. Dice >= t needs a unit of between t/(2-t) and (2-t)/t times the template's
number of bigrams, so every template is listed under the sizes it can match and whole texts and lines find
their templates by an equi join on size. Long prose finds none and costs nothing more.

A passage is a license inside a longer text, however it is wrapped. A text that holds a passage of Dice >= t
holds t/(2-t) of the template's bigrams, which few texts do. In those each bigram of the template votes for
the place where the template would begin, and as many words as the template has, from the place with most
votes on, are compared.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The notices and short license texts that are searched for, as published.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
THRESHOLD = 0.8


#: ASCII characters that part words, as blanks do.
_MARKS = "".join(chr(c) for c in (*range(9, 14), *range(33, 127)) if not chr(c).isalnum())


def unit_words(text: Column) -> Column:
    """Lower-case words; white space and ASCII marks separate."""
    return F.filter(F.split(F.translate(F.lower(text), _MARKS, " " * len(_MARKS)), " "), lambda w: w != "")


def text_bigrams(text: Column) -> Column:
    """Pairs of neighbouring words in their order, hashed to 64 bits; never null."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    none = F.array().cast("array<bigint>")
    # The words are bound once, as a lambda variable.
    bound = F.transform(F.array(unit_words(text)), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(none))
    return F.coalesce(F.get(bound, 0), none)


def unit_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words of a unit, hashed to 64 bits; never null."""
    return F.array_distinct(text_bigrams(text))


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def _once(value: Column) -> Column:
    """The value, computed once however many filters, join keys and lambdas read it."""
    return F.explode(F.array(value))


def _template_tables(spark, templates: Mapping[str, str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(n, license: a row for each size that a template can match; license, grams): as long as the templates together."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, line string").select("license", unit_bigrams(F.col("line")).alias("grams"))
    low, high = F.ceil(F.size("grams") * threshold / (2 - threshold) - 1e-9), F.floor(F.size("grams") * (2 - threshold) / threshold + 1e-9)
    return rows.select(F.explode(F.sequence(F.greatest(low, F.lit(1)).cast("int"), high.cast("int"))).alias("n"), "license"), rows


def _dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def _most_votes(places: Column) -> Column:
    """The most frequent of some whole numbers, the least of several; null without any."""
    state = lambda best, votes, at, run: F.struct(best.alias("best"), votes.alias("votes"), at.alias("at"), run.alias("run"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["at"] == x, s["run"] + 1).otherwise(1)
        more = run > s["votes"]
        return state(F.when(more, x).otherwise(s["best"]), F.when(more, run).otherwise(s["votes"]), x, run)

    nothing = F.lit(None).cast("int")
    return F.aggregate(F.array_sort(places), state(nothing, F.lit(0), nothing, F.lit(0)), step, lambda s: s["best"])


def scan_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, unmatched: bool = False) -> DataFrame:
    """Every passage that matches: doc_id, unit (-k: it begins with the k-th word), license, dice, line (its words).

    A text has at most one passage for each template: the one most of the template's bigrams point at, the
    first of several. Of passages that overlap in a text only the best stays, by name of the license in a tie.
    Texts with fewer than two words match nothing, nor do null or empty texts; repeated rows match each on
    its own. With `unmatched`, only licenses that neither the whole of the row's text nor a line of it matches.
    The work stays within a row, without a shuffle.
    """
    rows = df.sparkSession.createDataFrame(sorted(templates.items()), "license string, line string")
    known_rows = [r for r in rows.select("license", text_bigrams(F.col("line")).alias("grams")).collect() if r["grams"]]
    if not known_rows:
        return df.sparkSession.createDataFrame([], df.select(F.col(doc_id).alias("doc_id"), F.lit(0).alias("unit"), F.lit("").alias("license"), F.lit(0.0).alias("dice"), F.lit("").alias("line")).schema)
    need = {r["license"]: math.ceil(len(set(r["grams"])) * threshold / (2 - threshold) - 1e-9) for r in known_rows}
    # Literals, as many as the templates have words.
    table = F.array(*(F.struct(F.lit(r["license"]).alias("license"), F.lit(r["grams"]).alias("grams"), F.lit(sorted(set(r["grams"]))).alias("own"), F.lit(need[r["license"]]).alias("need")) for r in known_rows))
    every = F.lit(sorted({g for r in known_rows for g in r["grams"]}))
    held = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _once(text_bigrams(F.col(text))).alias("grams"))
    held = held.select("*", _once(F.array_intersect("grams", every)).alias("hits")).filter(F.size("hits") >= min(need.values()))
    known = F.filter(table, lambda t: F.size(F.array_intersect("hits", t["own"])) >= t["need"])

    def place(t: Column) -> Column:
        votes = F.transform("grams", lambda g, i: F.struct((i + 1).alias("at"), F.array_position(t["grams"], g).cast("int").alias("of")))
        start = _most_votes(F.transform(F.filter(votes, lambda v: v["of"] > 0), lambda v: v["at"] - v["of"] + 1))
        return F.struct(t["license"].alias("license"), t["own"].alias("own"), F.greatest(start, F.lit(1)).alias("first"), (start + F.size(t["grams"]) - 1).alias("last"))

    def compare(t: Column) -> Column:
        window = F.array_distinct(F.slice("grams", t["first"], t["last"] - t["first"] + 1))
        return F.struct(t["license"].alias("license"), t["first"].alias("first"), t["last"].alias("last"), _dice(window, t["own"]).alias("dice"), t["own"].alias("own"))

    def better(o: Column, m: Column) -> Column:
        return (o["first"] <= m["last"]) & (m["first"] <= o["last"]) & ((o["dice"] > m["dice"]) | ((o["dice"] == m["dice"]) & (o["license"] < m["license"])))

    met = F.filter(F.transform(F.transform(known, place), compare), lambda m: m["dice"] >= threshold - 1e-12)
    held = held.select("doc_id", "text", "grams", _once(met).alias("met")).filter(F.size("met") > 0)
    units = F.concat(F.array(F.array_distinct("grams")), F.transform(_lines(F.col("text")), unit_bigrams)) if unmatched else F.array().cast("array<array<bigint>>")
    held = held.select("doc_id", "text", "met", _once(units).alias("units"))
    stays = lambda m: ~F.exists("met", lambda o: better(o, m)) & ~F.exists("units", lambda u: _dice(u, m["own"]) >= threshold - 1e-12)
    held = held.select("doc_id", "text", F.inline(F.filter("met", stays)))
    words = F.array_join(F.slice(unit_words(F.col("text")), F.col("first"), F.col("last") - F.col("first") + 2), " ")
    return held.select("doc_id", (-F.col("first")).alias("unit"), "license", "dice", words.alias("line"))


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every match: doc_id, unit (0 the whole text, k its k-th line, -k a passage from its k-th word on), license, dice, line.

    Units with fewer than two words match nothing, nor do null or empty texts. Repeated rows match each on
    its own. A text of one line is met once, as its line. A passage is given only for a license that neither the
    whole text nor a line of it matches; see `scan_passages`.
    """
    lines = _lines(F.col(text))
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("unit"), F.col(text).alias("line"))))
    units = F.concat(F.transform(lines, lambda x, i: F.struct((i + 1).alias("unit"), x.alias("line"))), F.coalesce(whole, F.array().cast("array<struct<unit:int,line:string>>")))
    rows = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.inline(units)).filter("line != ''")
    rows = rows.select("*", _once(unit_bigrams(F.col("line"))).alias("own")).withColumn("n", F.size("own"))
    # Both are bounded by the lengths of the templates: sizes find names, names find bigrams.
    sizes, grams = _template_tables(df.sparkSession, templates, threshold)
    met = rows.join(F.broadcast(sizes), "n").join(F.broadcast(grams), "license").withColumn("dice", _dice(F.col("own"), F.col("grams")))
    met = met.filter(F.col("dice") >= threshold - 1e-12).select("doc_id", "unit", "license", "dice", "line")
    return met.unionByName(scan_passages(df, doc_id, text, templates, threshold, unmatched=True))


def license_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_units matched, n_licenses, license (best, then by name), dice.

    Documents without a match have 0, 0, null and null. Rows that share an id are reported together.
    """
    found = scan_licenses(df, doc_id, text, templates, threshold)
    per = found.groupBy("doc_id", "unit").agg(F.max("dice").alias("dice"), F.min_by("license", F.struct(-F.col("dice"), "license")).alias("license"))
    per = per.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.count_distinct("license").alias("n_licenses"), F.min_by("license", F.struct(-F.col("dice"), "license")).alias("license"), F.max("dice").alias("dice"))
    ids = df.select(F.col(doc_id).alias("doc_id")).distinct()
    out = ids.alias("i").join(per.alias("p"), F.col("i.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
    return out.select("i.doc_id", F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), F.coalesce("n_licenses", F.lit(0).cast("long")).alias("n_licenses"), "license", "dice")
