"""Licence scans by the Dice coefficient over word bigrams, in DataFrame operations alone.

The units compared are each whole text and each of its lines: lower-case ASCII words and numbers, their distinct bigrams.
Passages are compared as well, wherever they begin and end: a notice wrapped over lines, or within a line of other text.
A template is a candidate for a unit only where the sizes allow the threshold: with t the threshold, a unit of a bigrams
and a template of b can reach it only if t / (2 - t) <= a / b <= (2 - t) / t. Before that, a unit must contain an anchor
word: a template's anchors touch so many of its bigrams that a unit without any of them cannot share enough.

Defined cases: a null or empty text matches nothing; a unit of fewer than two words has no bigrams; of equal scores the
first template by name wins; equal rows give equal rows; texts of any length are whole; an empty table gives an empty result;
other columns do not matter. Of passages that overlap, the one that shares most bigrams with its template stays.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm.shared import ascii_lower, documents, stored

THRESHOLD = 0.8

#: Licence notices as their authors recommend them, and under /short one line that names the licence, as files
#: and pages often do; the latter are no author's words.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD/short": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0/short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause/short": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause/short": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0/short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC/short": "Released under the ISC License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT/short": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: The words of a unit: a fixed value, used by Spark and by the templates alike.
WORDS = "[a-z0-9]+"


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, "".join(c.lower() if c.isascii() else c for c in text))


def bigrams(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


@dataclass(frozen=True)
class Index:
    """Templates prepared for a threshold: name, bigrams and size; anchor words; least and largest unit size."""

    templates: tuple[tuple[str, tuple[str, ...]], ...]
    anchors: tuple[str, ...]
    least: int
    most: int
    threshold: float


@cache
def index(threshold: float = THRESHOLD) -> Index:
    """Anchors are chosen greedily: the word that touches most bigrams still needed, over all templates.

    A unit that reaches the threshold shares at least t / (2 - t) of a template's bigrams, so anchors must touch more
    than the rest of them.
    """
    templates = tuple((k, tuple(sorted(bigrams(v)))) for k, v in sorted(TEMPLATES.items()))
    share = threshold / (2 - threshold)
    open_ = [({*b}, int(len(b) * (1 - share)) + 1) for _, b in templates]
    anchors: list[str] = []
    while any(n > 0 for _, n in open_):
        words = {w for b, n in open_ if n > 0 for g in b for w in g.split()}
        gain = lambda w: sum(min(n, sum(w in g.split() for g in b)) for b, n in open_ if n > 0)
        word = max(sorted(words), key=lambda w: (len(w) >= 5, gain(w) * (len(w) - 1), w))
        anchors.append(word)
        open_ = [({g for g in b if word not in g.split()}, n - sum(word in g.split() for g in b)) for b, n in open_]
    sizes = [len(b) for _, b in templates]
    return Index(templates, tuple(anchors), max(1, int(min(sizes) * share)), int(max(sizes) / share) + 1, threshold)


def _once(c: Column, name: str) -> Column:
    """c computed once a row: no filter on a column that explode makes moves below it."""
    return F.explode(F.array(c)).alias(name)


def _has_anchor(text: Column, own: Index) -> Column:
    out = F.lit(False)
    for a in own.anchors:
        out = out | F.contains(text, F.lit(a))
    return out


def anchored(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row and low, the ASCII-lower-cased text, of the documents with an anchor word. No anchor has a letter that only
    full lower-casing gives, so the cheaper one finds them."""
    own = index(threshold)
    held = docs.where("text is not null").select("doc_id", "text", _once(F.lower("text"), "all_low")).where(_has_anchor(F.col("all_low"), own))
    return held.select("doc_id", F.monotonically_increasing_id().alias("row"), ascii_lower(F.col("text")).alias("low"))


def _words() -> Column:
    return F.regexp_extract_all("words", F.lit(WORDS), F.lit(0))


def _bigrams(w: str) -> Column:
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))


def _every(own: Index) -> list[str]:
    return sorted({g for _, grams in own.templates for g in grams})


def matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, licence, dice) of every unit that reaches the threshold with its best template. docs: as anchored() gives.

    unit: the line's number from 0, or -1 for the whole text. A unit of a bigrams that reaches t with a template of b shares
    at least t (a + b) / 2 of them, and b is at least a t / (2 - t): so that share of its own bigrams are a template's.
    """
    own = index(threshold)
    share = threshold / (2 - threshold)
    lines = F.split("low", "\n")
    # a text of one line is its line
    units = docs.select("doc_id", "row", F.explode(F.concat(F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("unit"), F.col("low").alias("words")))).otherwise(F.array()), F.transform(lines, lambda s, i: F.struct(i.alias("unit"), s.alias("words"))))).alias("u"))
    # each bigram takes at least four characters of its unit, whatever repeats
    units = units.select("doc_id", "row", "u.unit", "u.words").where(_has_anchor(F.col("words"), own) & (F.length("words") >= 3 * own.least))
    units = units.select("doc_id", "row", "unit", _once(_words(), "w")).where(F.size("w") > own.least)
    units = units.select("doc_id", "row", "unit", _once(F.array_distinct(_bigrams("w")), "b")).where(F.size("b").between(own.least, own.most))
    every = _every(own)
    units = units.select("doc_id", "row", "unit", F.size("b").alias("a"), _once(F.filter("b", lambda g: g.isin(every)), "hits")).where(F.size("hits") >= share * F.col("a") - 1e-9)
    known = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in own.templates])
    fits = F.filter(known, lambda t: (F.col("a") >= share * t["n"]) & (F.col("a") <= t["n"] / share))
    # the largest by score, then the first by name: templates are in the order of their names
    score = F.transform(fits, lambda t, i: F.struct((2 * F.size(F.array_intersect("hits", t["grams"])) / (F.col("a") + t["n"])).alias("dice"), (-i).alias("order"), t["licence"].alias("licence")))
    units = units.select("doc_id", "row", "unit", _once(F.array_max(score), "best")).where(F.col("best.dice") >= threshold)
    return units.select("doc_id", "row", "unit", "best.licence", "best.dice")


def passages(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, last, licence, dice) of the passages that reach the threshold; unit and last: their first and last line.

    Of one template, the best passages begin and end with runs of its bigrams, for a run's next bigram only adds to the
    score. So each two runs that are near enough are compared. What the line or text as a whole reaches is not repeated.
    docs: as anchored() gives.
    """
    own = index(threshold)
    share = threshold / (2 - threshold)
    known = []
    for name, grams in own.templates:
        n = len(grams)
        values = {"licence": F.lit(name), "n": F.lit(n), "need": F.lit(math.ceil(share * n - 1e-9)), "most": F.lit(int(max(n, len(words_of(TEMPLATES[name]))) / share) + 1), "grams": F.array(*map(F.lit, grams))}
        known.append(F.struct(*(v.alias(k) for k, v in values.items())))
    every = _every(own)
    least = math.ceil(share * min(len(grams) for _, grams in own.templates) - 1e-9)
    texts = docs.select("doc_id", _once(F.regexp_extract_all("low", F.lit(f"{WORDS}|\n"), F.lit(0)), "tokens"))
    texts = texts.select("doc_id", "tokens", _once(F.filter("tokens", lambda x: x != "\n"), "w"))
    texts = texts.select("doc_id", "tokens", _once(_bigrams("w"), "b"))
    hits = F.filter(F.transform("b", lambda g, i: F.when(g.isin(every), F.struct(i.alias("at"), g.alias("gram")))), lambda x: x.isNotNull())
    texts = texts.select("doc_id", "tokens", "b", _once(hits, "hits")).where(F.size("hits") >= least)
    likely = F.filter(F.array(*known), lambda t: F.size(F.array_intersect(t["grams"], F.col("hits.gram"))) >= t["need"])
    texts = texts.select("doc_id", "tokens", "b", "hits", _once(likely, "likely")).where(F.size("likely") > 0)
    positions = lambda t: F.transform(F.filter("hits", lambda h: F.array_contains(t["grams"], h["gram"])), lambda h: h["at"])
    texts = texts.select("doc_id", "tokens", "b", _once(F.transform("likely", lambda t: t.withField("at", positions(t))), "likely"))
    first = lambda t: F.filter(t["at"], lambda p, i: (i == 0) | (F.get(t["at"], i - 1) < p - 1))
    last = lambda t: F.filter(t["at"], lambda p, i: (i == F.size(t["at"]) - 1) | (F.get(t["at"], i + 1) > p + 1))
    texts = texts.select("doc_id", "tokens", "b", _once(F.transform("likely", lambda t: t.withField("first", first(t)).withField("last", last(t))), "likely"))

    def dice(shared: Column, size: Column, t: Column) -> Column:
        return 2 * shared / (size + t["n"])

    def within(t: Column, a: Column, b: Column) -> Column:
        part = F.slice("b", a + 1, b - a + 1)
        shared, size = F.size(F.array_intersect(part, t["grams"])), F.size(F.array_distinct(part))
        return F.struct(shared.alias("shared"), dice(shared, size, t).alias("dice"), t["licence"].alias("licence"), a.alias("a"), b.alias("b"))

    def of_template(t: Column) -> Column:
        ends = lambda a, k: F.filter(F.slice(t["last"], k + 1, t["most"]), lambda b, j: ((j == 0) | (b - a < t["most"])) & (b - a + 1 >= t["need"]))
        return F.flatten(F.transform(t["first"], lambda a, k: F.filter(F.transform(ends(a, k), lambda b: within(t, a, b)), lambda x: x["dice"] >= threshold)))

    texts = texts.select("doc_id", "tokens", "b", _once(F.flatten(F.transform("likely", of_template)), "found")).where(F.size("found") > 0)
    order = F.array_sort("found", lambda x, y: F.when(x["shared"] != y["shared"], y["shared"] - x["shared"]).when(x["dice"] != y["dice"], F.when(x["dice"] > y["dice"], -1).otherwise(1)).when(x["licence"] != y["licence"], F.when(x["licence"] < y["licence"], -1).otherwise(1)).otherwise(x["a"] - y["a"]))
    texts = texts.select("doc_id", "tokens", "b", _once(order, "found"))
    none = F.slice("found", 1, 0)
    kept = F.aggregate("found", none, lambda out, x: F.when(F.exists(out, lambda y: (x["a"] <= y["b"] + 1) & (y["a"] <= x["b"] + 1)), out).otherwise(F.concat(out, F.array(x))))
    texts = texts.select("doc_id", "tokens", "b", _once(kept, "kept"))
    # the k-th word stands on line i - k where it is the i-th token, as all other tokens before it are line breaks
    line_of = F.transform(F.filter(F.transform("tokens", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: x["x"] != "\n"), lambda x, k: x["i"] - k)
    texts = texts.select("doc_id", "b", "kept", _once(line_of, "line_of"))
    found = texts.select("doc_id", "b", "line_of", F.explode("kept").alias("p"))
    found = found.select("doc_id", "b", "line_of", "p", F.get("line_of", F.col("p.a")).alias("unit"), F.get("line_of", F.col("p.b") + 1).alias("last"))
    grams = F.create_map(*(x for name, g in own.templates for x in (F.lit(name), F.array(*map(F.lit, g)))))[F.col("p.licence")]
    start, end = F.array_position("line_of", F.col("unit")), F.size("line_of") - F.array_position(F.reverse("line_of"), F.col("unit")) + 1
    line = F.slice("b", start.cast("int"), (end - start).cast("int"))
    reaches = lambda part: 2 * F.size(F.array_intersect(part, grams)) / (F.size(F.array_distinct(part)) + F.size(grams)) >= threshold
    found = found.where(~reaches(F.col("b")) & ((F.col("unit") < F.col("last")) | ~reaches(line)))
    return found.select("doc_id", "unit", "last", "p.licence", "p.dice")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, last, licence, dice) of lines and texts as a whole, where last is unit, and of passages."""
    docs = stored(anchored(docs.select("doc_id", "text"), threshold), "anchored")
    whole = matches(docs, threshold).select("doc_id", "unit", F.col("unit").alias("last"), "licence", "dice")
    return whole.unionByName(passages(docs, threshold))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, unit, last, licence and dice (rounded to 6 places) of every match in every document."""
    return scan(documents(spark, sf_dir)).select("doc_id", "unit", "last", "licence", F.round("dice", 6).alias("dice"))
