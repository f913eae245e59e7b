"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A document's units are its whole text, its paragraphs (runs of lines between blank ones) and its lines. A unit is
normalised (lower case, only a-z and 0-9 in words) and its distinct bigrams compared with each template's. With a threshold t a template of m
bigrams can only match a unit of t / (2 - t) * m to (2 - t) / t * m, so other templates are not looked at, and a unit
outside all templates' bounds is not even parted into bigrams.

Built-in functions only, within each row: nothing is shuffled. The templates are a fixed table of a few dozen rows.

Nulls: a null text matches nothing. Null ids are carried, repeated rows scanned each. Ties go to the template that comes first
in the table. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Template name, SPDX identifier and text. Public licence texts, notices and headers.
TEMPLATES = [
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "This project is licensed under the MIT License."),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl3-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl2-notice", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl3-notice", "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl3-notice", "AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-notice", "MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("cc-by-notice", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-notice", "CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa-notice", "CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-work", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-work", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-notice", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("apache-header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl3-header", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc", "ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("bsd-2", "BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("bsd-3", "BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("zlib", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense-whole", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>"),
]


def template_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(m: int, t: float) -> tuple[int, int]:
    """The fewest and most bigrams of a unit that can match a template of m."""
    return math.ceil(m * t / (2 - t) - 1e-9), math.floor(m * (2 - t) / t + 1e-9)


def units(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.concat(F.array(whole), F.split(whole, r"\n[\x20\x09-\x0D]*\n", -1), F.split(whole, "\n", -1)))


def best_match(unit: Column, threshold: float) -> Column:
    """struct of score, negated place in the table, template and licence: the best template at or above the threshold; null if none."""
    own = [(name, spdx, template_bigrams(text)) for name, spdx, text in TEMPLATES]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("template"), F.lit(spdx).alias("licence"), F.lit(len(b)).alias("m"), F.lit(bounds(len(b), threshold)[0]).alias("lo"), F.lit(bounds(len(b), threshold)[1]).alias("hi"), F.array(*map(F.lit, b)).alias("b")) for i, (name, spdx, b) in enumerate(own)])
    least, most = min(bounds(len(b), threshold)[0] for *_, b in own), max(bounds(len(b), threshold)[1] for *_, b in own)

    def compare(bigrams: Column) -> Column:
        fit = F.filter(table, lambda t: (F.size(bigrams) >= t["lo"]) & (F.size(bigrams) <= t["hi"]))
        scored = F.transform(fit, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(bigrams, t["b"])) / (F.size(bigrams) + t["m"])).alias("score"), (-t["i"]).alias("place"), t["template"].alias("template"), t["licence"].alias("licence")))
        return F.array_max(F.filter(scored, lambda x: x["score"] >= threshold))

    def bigrams(words: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))

    words = F.split(F.btrim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " ")), " ")
    return let(words, lambda w: F.when(F.size(w) > least, let(bigrams(w), lambda b: F.when(F.size(b) <= most, compare(b)))))


def scan(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, template and score of the best match of any unit (null and 0 if none), n_units that match and
    licences, all that match, sorted and joined by a comma."""
    found = F.filter(F.transform(units(F.col(text_col)), lambda u: best_match(u, threshold)), lambda x: x.isNotNull())
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), let(found, lambda f: F.struct(F.array_max(f).alias("best"), F.size(f).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.transform(f, lambda x: x["licence"]))), ",").alias("all"))).alias("f"))
    return each.select("doc_id", F.col("f.best.licence").alias("licence"), F.col("f.best.template").alias("template"), F.coalesce(F.col("f.best.score"), F.lit(0.0)).alias("score"), F.col("f.n").cast("long").alias("n_units"), F.col("f.all").alias("licences"))


def window_matches(text: Column, threshold: float) -> Column:
    """Where templates stand in the words of the whole text, best first: struct of score, place, before (negated first word), template,
    licence and after (the word behind it).

    A template of n words is compared with every run of n words that begins with one of its bigrams; of runs that overlap the best
    stays. A match has `bounds`' fewest of the template's bigrams, so a text without any of the longest that can't all be missing is left at once.
    """
    own = [(i, name, spdx, len(re.findall("[a-z0-9]+", t.lower())), template_bigrams(t)) for i, (name, spdx, t) in enumerate(TEMPLATES)]
    gate = {x for *_, b in own for x in sorted(b, key=lambda x: (-len(x), x))[: len(b) - bounds(len(b), threshold)[0] + 1]}
    words = F.split(F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    shape = "array<struct<score:double,place:int,before:int,template:string,licence:string,after:int>>"

    def of_template(bigrams: Column, i: int, name: str, spdx: str, n: int, b: list[str]) -> Column:
        m, need = len(b), bounds(len(b), threshold)[0]
        hits = F.filter(F.sequence(F.lit(0), F.size(bigrams) - 1), lambda at: F.get(bigrams, at).isin(b))

        def scored(hits: Column) -> Column:
            full = F.filter(hits, lambda at, j: F.coalesce(F.get(hits, j + (need - 1)) <= at + (n - 2), F.lit(False)))
            return F.transform(full, lambda at: let(F.array_distinct(F.slice(bigrams, at + 1, n - 1)), lambda x: F.struct((F.lit(2.0) * F.size(F.filter(x, lambda y: y.isin(b))) / (F.size(x) + m)).alias("score"), F.lit(-i).alias("place"), (-at).alias("before"), F.lit(name).alias("template"), F.lit(spdx).alias("licence"), F.least(at + n, F.size(bigrams) + 1).alias("after"))))

        return let(hits, lambda h: F.when(F.size(h) >= need, F.filter(scored(h), lambda x: x["score"] >= threshold)).otherwise(F.array().cast(shape)))

    def apart(found: Column) -> Column:
        meets = lambda x, y: (-x["before"] < y["after"]) & (-y["before"] < x["after"])
        return F.aggregate(F.sort_array(found, asc=False), F.array().cast(shape), lambda kept, x: F.when(F.exists(kept, lambda y: meets(x, y)), kept).otherwise(F.concat(kept, F.array(x)).cast(shape)))

    def places(bigrams: Column) -> Column:
        some = F.exists(bigrams, lambda x: x.isin(list(gate)))
        return F.when(some, let(F.concat(*[of_template(bigrams, *t) for t in own]).cast(shape), apart)).otherwise(F.array().cast(shape))

    def pairs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))

    return let(words, lambda w: F.when(F.size(w) > 1, let(pairs(w), places)).otherwise(F.array().cast(shape)))


def scan_all(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`scan` with the templates that stand anywhere in the text: the best match of units and places, n_units and n_places that
    match, and the licences of both."""
    text = F.col(text_col)
    plain = lambda x: F.struct(x["score"].alias("score"), x["place"].alias("place"), x["template"].alias("template"), x["licence"].alias("licence"))
    found = F.filter(F.transform(units(text), lambda u: best_match(u, threshold)), lambda x: x.isNotNull())
    both = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(found.alias("u"), F.transform(window_matches(text, threshold), plain).alias("w")).alias("f"))
    told = let(F.col("f"), lambda f: let(F.concat(f["u"], f["w"]), lambda x: F.struct(F.array_max(x).alias("best"), F.size(f["u"]).alias("n"), F.size(f["w"]).alias("p"), F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["licence"]))), ",").alias("all"))))
    each = both.select("doc_id", told.alias("f"))
    return each.select("doc_id", F.col("f.best.licence").alias("licence"), F.col("f.best.template").alias("template"), F.coalesce(F.col("f.best.score"), F.lit(0.0)).alias("score"), F.col("f.n").cast("long").alias("n_units"), F.col("f.p").cast("long").alias("n_places"), F.col("f.all").alias("licences"))
