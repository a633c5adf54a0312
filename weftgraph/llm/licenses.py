"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Native: only built-in expressions. Every line and every whole text is a unit. A unit is lower-cased,
and what isn't a letter or digit becomes a space. Dice of distinct bigrams needs sizes within
[d / (2 - d), (2 - d) / d] of each other, so the word count alone prunes most units before any
bigram is made, and each template is compared only where its own bounds allow. Templates are a list that
the caller may replace, so one pass and no shuffle.

In both functions a text of any length is one row's work, held in memory while it is compared; an empty
table gives an empty result; extra columns, whatever their names, aren't read.

One result per matching unit and template: doc_id, unit (line number from 1; 0 is the whole text of
more than one line), license, dice. Null or empty text: no result. Repeated rows give repeated
results. Equal lines are all reported.

`find_notices` looks for what scan_licenses can't see: a notice that is wrapped over several lines of a
longer document, or stands on a line with other words. Its units are runs of words of any place and
length, lines or not; holders and years around a notice stay outside its run. A document goes on only
with templates of which it holds so many bigrams that a run can reach the threshold, which loses
nothing. A run begins and ends with bigrams of its template; for each begin the end is the one with the
best Dice when repeats are counted as they stand, and the Dice of distinct bigrams decides. Of runs of
one template that overlap, the best is kept. One result per run: doc_id, license, first_line, last_line
(from 1), n_words, dice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Usual notices. A template is what stands in files, without holders and years.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}

#: Complete licences, for find_notices besides TEMPLATES. Those of Apache, GNU and MPL end with a notice that is a template.
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
FULL_TEXTS = {
    "MIT-full": TEMPLATES["MIT-text"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-full": f"{_BSD} {_AS_IS}",
    "BSD-3-Clause-full": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}",
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _size_bounds(n: int, threshold: float) -> tuple[float, float]:
    return n * threshold / (2 - threshold), n * (2 - threshold) / threshold


def _dice(own: Column, template: list[str]) -> Column:
    return 2.0 * F.size(F.array_intersect(own, F.array(*map(F.lit, template)))) / (F.size(own) + len(template))


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    grams = {k: g for k, t in (templates or TEMPLATES).items() if (g := bigrams_of(t))}
    bounds = {k: _size_bounds(len(g), threshold) for k, g in grams.items()}
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n")
    units = df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array(t), lines)).otherwise(F.concat(F.array(F.lit("")), lines))).alias("unit", "raw"))
    # a unit of distinct bigrams b has more than b words: a cheap bound on the characters first
    least = min((b[0] for b in bounds.values()), default=0)
    units = units.where(F.length("raw") >= 2 * least)
    units = units.withColumn("words", F.array_remove(F.split(F.lower("raw"), "[^a-z0-9]+"), "")).drop("raw")
    n = F.size("words")
    units = units.where(n - 1 >= least)
    pairs = F.transform(F.slice("words", 1, n - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1)))
    units = units.select("doc_id", "unit", F.array_distinct(pairs).alias("own"))
    size = F.size("own")
    found = F.array(*[F.when((size >= lo) & (size <= hi) & F.arrays_overlap("own", F.array(*map(F.lit, grams[k]))), F.struct(F.lit(k).alias("license"), _dice(F.col("own"), grams[k]).alias("dice"))) for k, (lo, hi) in bounds.items()])
    out = units.select("doc_id", "unit", F.inline(F.filter(found, lambda x: x.isNotNull() & (x["dice"] >= threshold))))
    return out.select("doc_id", F.col("unit").cast("long").alias("unit"), "license", F.round("dice", 6).alias("dice"))


def _let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _pairs(words: Column) -> Column:
    n = F.size(words) - 1
    return F.when(n > 0, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _runs(pairs: Column, hits: Column, grams: Column, whole: Column, threshold: float) -> Column:
    """first, last (numbers of words), dice of the runs; hits: where `pairs` has one of `grams`; whole: the
    template's bigrams with repeats."""
    least, most = F.ceil(F.size(grams) * (threshold / 2) / (1 - threshold / 2)).cast("int"), F.ceil(whole * (2 - threshold) / threshold).cast("int")

    def end_of(j: Column) -> Column:
        begin = F.get(hits, j)
        ends = F.filter(F.sequence(j + least - 1, F.least(F.size(hits), j + most) - 1), lambda e: F.get(hits, e) - begin < most)
        return -F.array_max(F.transform(ends, lambda e: F.struct((2.0 * (e - j + 1) / (F.get(hits, e) - begin + 1 + whole)).alias("x"), (-e).alias("e"))))["e"]

    def run_of(j: Column) -> Column:
        first = F.get(hits, j)
        return _let(F.get(hits, end_of(j)), lambda last: _let(F.array_distinct(F.slice(pairs, first + 1, last - first + 1)), lambda own: F.struct(first.alias("first"), (last + 1).alias("last"), (2.0 * F.size(F.array_intersect(own, grams)) / (F.size(own) + F.size(grams))).alias("dice"))))

    starts = F.when(F.size(hits) >= least, F.filter(F.sequence(F.lit(0), F.size(hits) - least), lambda j: F.get(hits, j + least - 1) - F.get(hits, j) < most)).otherwise(F.array().cast("array<int>"))
    runs = F.filter(F.transform(starts, run_of), lambda r: r["dice"] >= threshold)

    def best(kept: Column, r: Column) -> Column:
        old = F.get(kept, F.size(kept) - 1)
        apart = F.size(kept) == 0
        return F.when(apart | (r["first"] > old["last"]), F.concat(kept, F.array(r))).when(r["dice"] > old["dice"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(r))).otherwise(kept)

    return F.aggregate(runs, F.array().cast("array<struct<first:int,last:int,dice:double>>"), best)


def find_notices(df: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    texts = {k: t for k, t in (templates or TEMPLATES | FULL_TEXTS).items() if bigrams_of(t)}
    grams = {k: F.array(*map(F.lit, bigrams_of(t))) for k, t in texts.items()}
    # a run of Dice x holds a share of x / (2 - x) of the template's bigrams
    least = {k: _size_bounds(len(bigrams_of(t)), threshold)[0] for k, t in texts.items()}
    every = F.array(*map(F.lit, sorted({g for t in texts.values() for g in bigrams_of(t)})))
    t = F.coalesce(F.col(text), F.lit(""))
    some = lambda held: F.filter(F.array(*[F.when(F.size(F.array_intersect(held, g)) >= least[k] - 1e-9, F.struct(F.lit(k).alias("license"), g.alias("grams"), F.lit(len(words_of(texts[k])) - 1).alias("whole"))) for k, g in grams.items()]), lambda x: x.isNotNull())
    held = F.array_intersect(_let(_split(t), _pairs), every)
    found = F.flatten(F.transform(F.filter(F.array(held), lambda h: F.size(h) >= min(least.values()) - 1e-9), some))
    docs = df.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.inline(found))
    spots = lambda pairs: F.filter(F.transform(pairs, lambda x, i: F.when(F.array_contains("grams", x), i)), lambda i: i.isNotNull())
    runs = _let(_let(_split(F.col("text")), _pairs), lambda pairs: _let(spots(pairs), lambda hits: _runs(pairs, hits, F.col("grams"), F.col("whole"), threshold)))
    line_of = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.array_repeat(i + 1, F.size(_split(x)))))
    lined = _let(line_of, lambda at: F.transform(runs, lambda r: F.struct(F.get(at, r["first"]).cast("long").alias("first_line"), F.get(at, r["last"]).cast("long").alias("last_line"), (r["last"] - r["first"] + 1).cast("long").alias("n_words"), F.round(r["dice"], 6).alias("dice"))))
    return docs.select("doc_id", "license", F.inline(lined))
