"""Operator 5: licence scans by Dice coefficient over word bigrams, in DataFrame functions.

What is compared to a licence template matches if twice the number of bigrams
they share is at least ``least`` times the sum of their numbers of bigrams. Two
kinds of parts of a text are compared:

* segments: lines, paragraphs, the whole text, with all templates of a fitting
  size: neither of two that match has more than ``(2 - least) / least`` times as
  many bigrams as the other, which rules out most templates by size alone.
* windows, wherever they are in a line or across lines: as many words as a
  template has, beginning where one of the template's first bigrams puts its
  start. They find notices inside of sentences, wrapped or commented texts,
  and the notices that whole licence texts quote.

Texts without any anchor word are not looked at: the anchors of a template
touch so many of its bigrams that the rest are too few for a match, so nothing
is lost. It is all one projection, without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, pick

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_LIABLE = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(what: str, name: str, version: str) -> str:
    return (
        f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


def _gnu_title(name: str, date: str) -> str:
    return f"{name} {date} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


# Short forms in which texts name their licences, standard notices, and whole texts of short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
     "See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_WARRANTY} {_MIT_LIABLE}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", _gnu("This program", "General Public License", "3")),
    ("GPL-3.0", _gnu_title("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Copyright (C) 2007")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu("This program", "General Public License", "2").replace(": you", "; you")),
    ("GPL-2.0", _gnu_title("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "Copyright (C) 1989, 1991")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu("This program", "Lesser General Public License", "3")),
    ("LGPL-3.0", _gnu_title("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Copyright (C) 2007")),
    ("LGPL-2.1", _gnu("This library", "Lesser General Public License", "2.1").replace(": you", "; you")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu("This program", "Affero General Public License", "3")),
    ("AGPL-3.0", _gnu_title("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "Copyright (C) 2007")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAME} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", _ISC_GRANT),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_WARRANTY}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
     "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved. Reproduction without permission is prohibited."),
)
TOKEN = r"[\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def anchors(templates=TEMPLATES, least: float = 0.8) -> list[str]:
    """Words, one of which is in each segment that can match a template: most telling first, by length."""
    out: set[str] = set()
    for _, text in templates:
        grams = bigrams(text)
        need = least * len(grams) / (2 - least)  # fewest bigrams in common with a match
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w not in out, len(w) < 3, -len(w), w))
        mine: set[str] = set()
        while sum(not mine & set(g.split()) for g in grams) >= need:
            mine.add(words.pop(0))
        out |= mine
    return sorted(out)


#: So many first bigrams of a template can start a window.
HEADS = 4


def heads(templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """First bigrams of the templates: in which template they are, and at which word."""
    out: dict[str, list[tuple[int, int]]] = {}
    for i, (_, text) in enumerate(templates):
        w, seen = words_of(text), set()
        for o, g in enumerate(f"{a} {b}" for a, b in list(zip(w, w[1:]))[:HEADS]):
            if g not in seen:
                out.setdefault(g, []).append((i, o))
                seen.add(g)
    return out


def licences(docs: DataFrame, templates=TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, matches, windows, licence and dice of the best match (null without one).

    matches: licence, dice and segment of the segments that match, each with
    its best template; windows: the same of the windows, with the number of
    words before it (start), once for each template that it matches. The best
    match has the highest coefficient, then the first template. Texts are
    compared lower-cased, as runs of letters and digits. Null, empty and
    one-word texts match nothing. Rows that repeat an id are scanned one by
    one, null ids stay, an empty table gives no rows, extra columns are ignored.
    """
    t, anchor = F.col("text"), rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(anchors(templates, least))})(?![\p{{L}}\p{{N}}])"
    known = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(name).alias("licence"), F.lit(len(g)).alias("n"), F.lit(len(words_of(text))).alias("m"), F.split(F.lit("|".join(g)), r"\|").alias("grams"))
        for i, (name, text) in enumerate(templates) if (g := bigrams(text))
    ])
    at = {i: k for k, i in enumerate(i for i, (_, text) in enumerate(templates) if bigrams(text))}
    df = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string")).withColumn("hit", F.coalesce(t.rlike(anchor), F.lit(False)))
    segments = F.array_distinct(F.concat(F.split(t, r"\R", -1), F.split(t, r"\R\s*\R", -1), F.array(t)))
    df = df.withColumn("segments", F.when(F.col("hit"), F.filter(segments, lambda s: s.rlike(anchor))))
    df = df.withColumn("words", F.when(F.col("hit"), F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(0))))

    def paired(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.filter(pairs, lambda g: g.isNotNull())

    def dice(n: Column, grams: Column, k: Column) -> Column:
        return F.lit(2.0) * F.size(F.array_intersect(grams, k["grams"])) / (n + k["n"])

    fits = lambda n, k: (n >= k["n"] * (least / (2 - least)) - 1e-9) & (n <= k["n"] * ((2 - least) / least) + 1e-9)

    df = df.withColumn("segments", F.transform("segments", lambda s: F.struct(s.alias("segment"), F.array_distinct(paired(F.regexp_extract_all(F.lower(s), F.lit(TOKEN), F.lit(0)))).alias("grams"))))

    def compared(s: Column) -> Column:
        n = F.size(s["grams"])
        each = F.transform(F.filter(known, lambda k: fits(n, k)), lambda k: F.struct(dice(n, s["grams"], k).alias("dice"), (-k["i"]).alias("order"), k["licence"].alias("licence")))
        best = F.array_max(F.filter(each, lambda d: d["dice"] >= least))
        return F.struct(best["licence"].alias("licence"), best["dice"].alias("dice"), best["order"].alias("order"), s["segment"].alias("segment"))

    df = df.withColumn("matches", F.filter(F.transform("segments", compared), lambda m: m["licence"].isNotNull()))

    first = heads(templates)
    places = F.create_map(*[x for g, where in first.items() for x in (F.lit(g), F.array(*[F.struct(F.lit(at[i]).alias("k"), F.lit(o).alias("o")) for i, o in where]))])
    df = df.withColumn("grams", paired(F.col("words")))
    met = F.filter(F.transform("grams", lambda g, p: F.when(g.isin(list(first)), F.struct(p.alias("p"), g.alias("g")))), lambda x: x.isNotNull())
    starts = F.flatten(F.transform(met, lambda x: F.transform(F.element_at(places, x["g"]), lambda h: F.struct((x["p"] - h["o"]).alias("start"), h["k"].alias("k")))))
    df = df.withColumn("starts", F.array_distinct(F.filter(starts, lambda x: x["start"] >= 0)))

    def placed(x: Column) -> Column:
        k = F.get(known, x["k"])
        own = F.array_distinct(F.slice(F.col("grams"), x["start"] + 1, k["m"] - 1))
        return F.struct(k["licence"].alias("licence"), F.when(fits(F.size(own), k), dice(F.size(own), own, k)).otherwise(0.0).alias("dice"), (-k["i"]).alias("order"), x["start"].alias("start"), k["m"].alias("m"))

    df = df.withColumn("windows", F.filter(F.transform("starts", placed), lambda m: m["dice"] >= least))
    rank = lambda m: F.struct(m["dice"].alias("dice"), m["order"].alias("order"), m["licence"].alias("licence"))
    top = F.array_max(F.concat(F.transform("matches", rank), F.transform("windows", rank)))
    plain = F.transform("matches", lambda m: F.struct(m["licence"].alias("licence"), m["dice"].alias("dice"), m["segment"].alias("segment")))
    inner = F.transform("windows", lambda m: F.struct(m["licence"].alias("licence"), m["dice"].alias("dice"), F.array_join(F.slice("words", m["start"] + 1, m["m"]), " ").alias("segment"), m["start"].alias("start")))
    kind = "struct<licence:string,dice:double,segment:string"
    return df.withColumn("top", top).select(
        "doc_id", F.coalesce(plain, F.array().cast(f"array<{kind}>>")).alias("matches"), F.coalesce(inner, F.array().cast(f"array<{kind},start:int>>")).alias("windows"),
        F.col("top")["licence"].alias("licence"), F.round(F.col("top")["dice"], 6).alias("dice"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(documents(spark, sf_dir))
    n_windows = F.size(F.array_distinct(F.transform("windows", lambda w: w["start"])))
    return found.select("doc_id", "licence", "dice", F.size("matches").cast("long").alias("n_segments"), n_windows.cast("long").alias("n_windows"))


def _sql() -> str:
    rows = ",\n  ".join("({}, '{}', {}, [{}])".format(i, name, len(words_of(text)), ", ".join(f"'{g}'" for g in bigrams(text))) for i, (name, text) in enumerate(TEMPLATES))
    starts = ", ".join(f"('{g}', {i}, {o})" for g, where in heads().items() for i, o in where)
    return f"""
WITH t(i, licence, m, grams) AS (VALUES
  {rows}
), h(gram, i, o) AS (VALUES {starts}), d AS (
  SELECT row_number() OVER () AS row, doc_id, text FROM documents
), s AS (
  SELECT DISTINCT row, doc_id, segment FROM (
    SELECT row, doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n\\s*\\n'), [text])) AS segment FROM d)
), w AS (
  SELECT row, segment, regexp_extract_all(lower(segment), '[\\p{{L}}\\p{{N}}]+') AS w FROM s
), g AS (
  SELECT row, segment, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS grams FROM w WHERE len(w) > 1
), m AS (
  SELECT row, segment, i, licence, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON len(g.grams) BETWEEN len(t.grams) / 2 AND len(t.grams) * 2
), b AS (
  SELECT row, segment, max(dice) AS dice, arg_max(licence, dice * 1e9 - i) AS licence, arg_max(i, dice * 1e9 - i) AS i FROM m WHERE dice >= 0.8 GROUP BY row, segment
), hw AS (
  SELECT row, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM d
), hg AS (
  SELECT row, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS grams FROM hw WHERE len(w) > 1
), hp AS (
  SELECT row, unnest(grams) AS gram, generate_subscripts(grams, 1) AS p FROM hg
), c AS (
  SELECT DISTINCT row, h.i, p - o AS start FROM hp JOIN h USING (gram) WHERE p - o >= 1
), x AS (
  SELECT c.row, c.i, c.start, t.licence, t.grams AS theirs, list_distinct(list_slice(hg.grams, c.start, c.start + t.m - 2)) AS own FROM c JOIN t ON t.i = c.i JOIN hg ON hg.row = c.row
), y AS (
  SELECT row, i, start, licence, 2.0::DOUBLE * len(list_intersect(own, theirs)) / (len(own) + len(theirs)) AS dice FROM x
), k AS (
  SELECT row, dice, licence, i, NULL AS start FROM b UNION ALL SELECT row, dice, licence, i, start FROM y WHERE dice >= 0.8
), r AS (
  SELECT row, max(dice) AS dice, arg_max(licence, dice * 1e9 - i) AS licence, count(*) FILTER (start IS NULL) AS n, count(DISTINCT start) AS n_windows FROM k GROUP BY row
)
SELECT d.doc_id, r.licence, round(r.dice, 6) AS dice, coalesce(r.n, 0)::BIGINT AS n_segments, coalesce(r.n_windows, 0)::BIGINT AS n_windows FROM d LEFT JOIN r USING (row)
"""


OP5_SQL = _sql()
