"""Licence scan: Dice coefficient over word bigrams between normalised text and licence templates, with DataFrame operations only.

A document's segments are its lines, sentences, paragraphs, runs of up to RUN paragraphs (licences have empty lines) and the whole text. Each is normalised (lower case, everything
but letters and digits as one blank) and becomes a set of word bigrams. A template with k bigrams can only reach the threshold t against a set of
k t / (2 - t) to k (2 - t) / t bigrams, so sizes prune templates before any intersection. By the same bound a match shares at least k t / (2 - t) of the template's
bigrams, so it has one of a few words (`keywords`) that together touch all but fewer of them: texts with none of these words have no segment to compare.
Everything happens inside a row: nothing is shuffled and the templates are constants of the plan.

Null or empty text matches nothing, and texts of any length are read whole; every row of the input gives a row, repeated rows equal ones, an empty table none. Equal coefficients go to the template that comes first in
TEMPLATES. Extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DICE, RUN = 0.8, 6
#: Words that most texts have: keywords only where nothing else is left.
COMMON = set("a all an and any are as at be but by can for from have has if in is it its may more no not of on or other out see shall so such that the their this to under use was will with without you your".split())
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_CLAUSES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "


def _gnu(what: str, name: str, version: str) -> str:
    """The notice that a program under a GNU licence carries."""
    return f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."


# Texts of licences, or of the whole notices of those with long texts (identifier, text).
FULL = [
    ("AGPL-3.0", _gnu("This program", "GNU Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD + _CLAUSES + _AS_IS),
    ("BSD-2-Clause", _BSD + _CLAUSES),
    ("BSD-3-Clause", _BSD + _CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("BSD-3-Clause", _BSD + _CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", _BSD),
    ("GPL-2.0", _gnu("This program", "GNU General Public License", "2")),
    ("GPL-3.0", _gnu("This program", "GNU General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", _gnu("This library", "GNU Lesser General Public License", "3")),
    ("MIT", _MIT + "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", _MIT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
# Licence notices (identifier, text).
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *FULL,
]


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(k: int, least: float) -> tuple[int, int]:
    """The least and most bigrams of a set that can reach the threshold against k bigrams."""
    return -int(-(k * least / (2 - least) - 1e-9) // 1), int(k * (2 - least) / least + 1e-9)


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs_of(paragraphs: Column, k: int) -> Column:
    """All runs of k paragraphs."""
    first = F.filter(F.sequence(F.lit(0), F.size(paragraphs)), lambda i: i + k <= F.size(paragraphs))
    return F.transform(first, lambda i: F.array_join(F.slice(paragraphs, i + 1, F.lit(k)), "\n"))


def _bigrams(normal: Column) -> Column:
    words = F.split(normal, " ")
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    return F.flatten(F.transform(F.array(words), pairs))  # binds words once


def keywords(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which every match of a template has one: for each template, those chosen touch so many bigrams that fewer than a match shares are left. Long
    words that many templates still need are chosen first."""
    open_ = []
    for _, t in templates:
        own = [set(b.split(" ")) for b in template_bigrams(t)]
        open_.append((own, bounds(len(own), least)[0]))
    chosen: list[str] = []
    while open_:
        gain: dict[str, float] = {}
        for own, need in open_:
            for w in sorted(set().union(*own)):
                gain[w] = gain.get(w, 0.0) + min(1.0, sum(w in b for b in own) / (len(own) - need + 1)) * (0.01 if w in COMMON else min(len(w), 7))
        chosen.append(max(gain, key=lambda w: (gain[w], w)))
        open_ = [(left, need) for own, need in open_ for left in [[b for b in own if chosen[-1] not in b]] if len(left) >= need]
    return chosen


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, license (the best template's, or null), dice, n_segments (different ones that match), licenses (of all matches, in order, comma-joined)."""
    text = F.coalesce("text", F.lit(""))
    all_bounds = [bounds(len(template_bigrams(t)), least) for _, t in templates]
    fewest, most = min(low for low, _ in all_bounds), max(high for _, high in all_bounds)

    def runs(paragraphs: Column) -> Column:
        return F.concat(*(_runs_of(paragraphs, k) for k in range(1, RUN + 1)))

    paragraphs = F.split(text, r"\n[ \t\r]*\n")
    segments = F.concat(F.split(text, "\n"), F.split(text, r"[.!?]+[ \t\r\n]+"), _let(paragraphs, runs), F.array(text))
    normal = F.array_distinct(F.transform(segments, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))))
    words = keywords(templates, least)
    words = [w for w in words if not any(k in w and k != w and len(k) > 3 for k in words)]
    normal = F.when(F.lower(text).rlike("|".join(w if len(w) > 3 else f"(?<![a-z0-9]){w}(?![a-z0-9])" for w in words)), normal).otherwise(F.array().cast("array<string>"))

    def best(bigrams: Column) -> Column:
        found = []
        for i, (_, t) in enumerate(templates):
            own = template_bigrams(t)
            low, high = bounds(len(own), least)
            dice = F.size(F.array_intersect(bigrams, F.lit(own))) * 2.0 / (F.size(bigrams) + len(own))
            found.append(F.when(F.size(bigrams).between(low, high), F.struct(dice.alias("dice"), F.lit(-i).alias("i"))))
        return F.array_max(F.array(*found))

    scored = docs.select("doc_id", F.transform(normal, _bigrams).alias("b"))
    scored = scored.select("doc_id", F.filter(F.transform(F.filter("b", lambda b: F.size(b).between(fewest, most)), best), lambda m: m.dice >= least).alias("m"))
    names = F.lit([n for n, _ in templates])
    top = F.array_max("m")
    return scored.select(
        "doc_id",
        F.get(names, -top.i).alias("license"),
        F.round(top.dice, 6).alias("dice"),
        F.size("m").cast("bigint").alias("n_segments"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: F.get(names, -m.i)))), ",").alias("licenses"),
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH templates(i, name, own) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, [{', '.join(map(_quoted, template_bigrams(t)))}])" for i, (n, t) in enumerate(TEMPLATES))}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, text, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM d),
segments AS (
  SELECT r, unnest(string_split(text, chr(10))) AS s FROM d
  UNION ALL
  SELECT r, unnest(regexp_split_to_array(text, '[.!?]+[ \\t\\r\\n]+')) FROM d
  UNION ALL
  SELECT r, text FROM d
  UNION ALL
  SELECT r, array_to_string(list_slice(p, i, i + k - 1), chr(10)) FROM p, (SELECT unnest(range(1, {RUN + 1})) AS k), LATERAL (SELECT unnest(range(1, len(p) - k + 2)) AS i)
),
words AS (SELECT r, string_split(s, ' ') AS w FROM (SELECT DISTINCT r, trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS s FROM segments)),
sets AS (
  SELECT r, row_number() OVER () AS s, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS b FROM words WHERE len(w) > 1
),
dice AS (
  SELECT r, s, i, name, 2.0::DOUBLE * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice FROM sets, templates
  WHERE len(b) <= len(own) * {(2 - LEAST_DICE) / LEAST_DICE} + 1e-9 AND len(own) <= len(b) * {(2 - LEAST_DICE) / LEAST_DICE} + 1e-9
),
best AS (SELECT * FROM dice WHERE dice >= {LEAST_DICE} QUALIFY row_number() OVER (PARTITION BY r, s ORDER BY dice DESC, i) = 1),
per_doc AS (
  SELECT r, arg_min(name, struct_pack(a := -dice, b := i)) AS license, max(dice) AS dice, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM best GROUP BY r
)
SELECT doc_id, license, round(dice, 6) AS dice, coalesce(n, 0)::BIGINT AS n_segments, coalesce(names, '') AS licenses FROM d LEFT JOIN per_doc USING (r)
"""
