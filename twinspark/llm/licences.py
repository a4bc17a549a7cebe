"""License scans: texts against licence templates by the Dice coefficient over word bigrams.

Units of a document are its lines, its blocks between empty lines and the whole text, each in lower
case with only letters and digits kept. A unit of n distinct bigrams can reach a coefficient t only
with templates of n*t/(2-t) to n*(2-t)/t bigrams, so it meets just the templates of its size.

Defined results: a null, empty or unlicensed text has licence null, coefficient 0.0 and no hits; ties
go to the template first in order of names; rows that repeat an id are scanned each alone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read

#: Least coefficient of a hit.
LEAST = 0.8

#: The disclaimers that end the texts, as published.
MIT_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Licence notices and texts, as published.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
]
_TEXT = {name: max((t for n, t in TEMPLATES if n == name), key=len) for name in ("BSD-3-Clause", "ISC", "MIT")}
# whole texts: what is granted, and the disclaimer
TEMPLATES += [
    ("BSD-2-Clause", _TEXT["BSD-3-Clause"][: _TEXT["BSD-3-Clause"].index(" 3. ")] + " " + BSD_DISCLAIMER),
    ("BSD-3-Clause", _TEXT["BSD-3-Clause"] + " " + BSD_DISCLAIMER),
    ("ISC", _TEXT["ISC"] + " " + ISC_DISCLAIMER),
    ("MIT", _TEXT["MIT"] + " " + MIT_DISCLAIMER),
]


def _plain(text: str) -> list[str]:
    return [w for w in re.split(r"[^0-9a-z\u0080-￿]+", text.lower()) if w]


def _bigrams(text: str) -> list[str]:
    w = _plain(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(n: int, least: float) -> tuple[int, int]:
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """Per document: id, best licence, its coefficient, and the number of units with a hit."""
    sets = [(name, _bigrams(text)) for name, text in templates]
    ranges = [bounds(len(b), least) for _, b in sets]
    least_chars = 2 * min(a for a, _ in ranges) + 1
    literal = F.array(*[F.array(*[F.xxhash64(F.lit(x)) for x in b]) for _, b in sets])

    # n bigrams take n + 1 words of a character at least and n separators; there is no such bound above, as bigrams can repeat
    def rough(x: Column) -> Column:
        return F.length(x) >= least_chars

    def grams(x: Column) -> Column:
        w = F.array_remove(F.split(F.lower(x), r"[^0-9a-z\x{80}-\x{ffff}]+", -1), "")
        return let(w, lambda w: F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, i: F.xxhash64(F.concat(a, F.lit(" "), F.get(w, i + 1)))))))

    def best(g: Column) -> Column:
        def dice(k: int) -> Column:
            low, high = ranges[k]
            return F.when(F.size(g).between(low, high), 2.0 * F.size(F.array_intersect(g, F.array(*[F.xxhash64(F.lit(x)) for x in sets[k][1]]))) / (F.size(g) + len(sets[k][1])))

        scores = [F.struct(F.coalesce(dice(k), F.lit(0.0)).alias("dice"), F.lit(-k).alias("k")) for k in range(len(sets))]
        fits = F.lit(False)
        for low, high in ranges:
            fits = fits | F.size(g).between(low, high)
        return F.when(fits, F.array_max(F.array(*scores))).otherwise(F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("k")))

    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n", -1), F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda x: F.contains(x, F.lit("\n"))), F.array(text)))
    hits = F.filter(F.transform(F.filter(units, rough), lambda x: let(grams(x), best)), lambda h: h["dice"] >= least)
    d = docs.select(F.col(id_col).alias("doc_id"), hits.alias("hits"))
    names = F.array(*[F.lit(n) for n, _ in sets])
    top = F.array_max("hits")
    return d.select("doc_id", F.get(names, -top["k"]).alias("licence"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), F.size("hits").cast("long").alias("n_hits"))


def op3_licences(spark, sf_dir: str) -> DataFrame:
    return scanned(read(spark, sf_dir))


def sql(least: float = LEAST, templates=TEMPLATES) -> str:
    sets = [(name, _bigrams(text)) for name, text in templates]
    rows = ", ".join(f"({k}, '{n}', [{', '.join(chr(39) + x + chr(39) for x in b)}])" for k, (n, b) in enumerate(sets))
    return rf"""
WITH t(k, licence, g) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
u AS (SELECT DISTINCT doc_id, u FROM (SELECT doc_id, unnest(list_concat(string_split(x, chr(10)), [b FOR b IN regexp_split_to_array(x, '\n[ \t\r]*\n') IF contains(b, chr(10))], [x])) AS u FROM d)),
w AS (SELECT doc_id, u, [v FOR v IN regexp_split_to_array(lower(u), '[^0-9a-z\x{{80}}-\x{{ffff}}]+') IF v <> ''] AS w FROM u),
g AS (SELECT doc_id, u, list_distinct([a || ' ' || b FOR a, b IN w]) AS g FROM w WHERE FALSE UNION ALL
  SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, u, k, licence, 2.0::DOUBLE * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t ON len(g.g) <= 2 * len(t.g) AND len(t.g) <= 2 * len(g.g)),
h AS (SELECT doc_id, u, max(dice) AS dice, arg_max(licence, (dice, -k)) AS licence, arg_max(k, (dice, -k)) AS k FROM s WHERE dice >= {least} GROUP BY doc_id, u),
b AS (SELECT doc_id, arg_max(licence, (dice, -k)) AS licence, max(dice) AS dice, count(*) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, b.licence, coalesce(b.dice, 0.0::DOUBLE) AS dice, CAST(coalesce(n, 0) AS BIGINT) AS n_hits FROM d LEFT JOIN b ON d.doc_id = b.doc_id
""".replace(r"list_distinct([a || ' ' || b FOR a, b IN w]) AS g FROM w WHERE FALSE UNION ALL", "g FROM (SELECT doc_id, u, NULL::VARCHAR[] AS g FROM u) WHERE FALSE UNION ALL")
